"""Stylesheets as tables: nodes, errors, search, filtering and rendering as table and column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "sheet_id string, node_no int, parent_no int, role string, kind string, name string, text string, from_idx int, to_idx int, is_valid boolean, has_error boolean, ord int"


def css_nodes(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """A row per node of each sheet (one parse per sheet, in Arrow batches); ``sheet_id`` is the key as text."""

    def parse(frames):
        from bindery.css import parser

        columns = [x.split()[0] for x in NODES.split(", ")]
        for frame in frames:
            rows = [(k, *r) for k, text in zip(frame.k, frame.css) for r in parser.rows(text)]
            out = pd.DataFrame(rows, columns=columns)
            out["parent_no"] = out["parent_no"].astype("Int32")
            yield out

    return sheets.select(F.col(key).cast("string").alias("k"), F.col(css).alias("css")).mapInPandas(parse, NODES)


def css_errors(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """(sheet_id, err_no, code, details, at, around)."""

    def parse(frames):
        from bindery.css import parser

        for frame in frames:
            rows = [(k, i, e.code, e.details, e.at, e.around) for k, text in zip(frame.k, frame.css) for i, e in enumerate(parser.parse(text).errors)]
            yield pd.DataFrame(rows, columns=["sheet_id", "err_no", "code", "details", "at", "around"])

    return sheets.select(F.col(key).cast("string").alias("k"), F.col(css).alias("css")).mapInPandas(parse, "sheet_id string, err_no int, code string, details string, at int, around string")


def css_find(nodes: DataFrame, predicate, kinds: tuple[str, ...], roles: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of ``kinds`` that satisfy a column predicate and aren't below another match.

    Nodes are numbered depth first, so what lies below a node is the run of numbers up to its last descendant.
    Kinds nest at most a few levels; the nearest match before a node decides, by a window in node order.
    """
    hit = nodes.where(F.col("kind").isin(*kinds) & predicate)
    if roles:
        hit = hit.where(F.col("role").isin(*roles))
    order = Window.partitionBy("sheet_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("to_idx").over(order)
    first = F.max(F.struct("to_idx", "from_idx")).over(order)
    inside = (reach >= F.col("to_idx")) & (first["from_idx"] <= F.col("from_idx")) & (reach > F.col("from_idx"))
    return hit.withColumn("_inside", F.coalesce(inside, F.lit(False))).where("not _inside").drop("_inside")


def css_render(css, mode: str = "understood"):
    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        from bindery.css import parser

        return texts.map(lambda x: None if x is None else parser.parse(x).render(mode))

    return render(css)


def css_edit(css, kind: str, name: str, new: str | None = None):
    """Nodes of a kind with the given name or text replaced by ``new``, or removed."""

    @F.pandas_udf("string")
    def edit(texts: pd.Series) -> pd.Series:
        from bindery.css import parser

        def one(x):
            if x is None:
                return None
            sheet = parser.parse(x)
            for found in parser.find(sheet, kind, lambda n: name in (n.name, str(n))):
                found.remove() if new is None else found.replace(new)
            return str(sheet)

        return texts.map(one)

    return edit(css)


def css_filter(css, selector: str):
    """Only the rules whose selectors have ``selector`` in them."""

    @F.pandas_udf("string")
    def keep(texts: pd.Series) -> pd.Series:
        from bindery.css import parser

        return texts.map(lambda x: None if x is None else str(parser.clone(parser.parse(x), lambda n: str(n) == selector)))

    return keep(css)


def css_rules(nodes: DataFrame) -> DataFrame:
    """(sheet_id, rule_no, selector, prop_no, property, value): a row per property and member of a selector list."""
    rule = nodes.where("kind = 'class_rule'").select("sheet_id", F.col("node_no").alias("rule_no"))
    heads = nodes.where("role = 'selector'").select("sheet_id", F.col("node_no").alias("head_no"), F.col("parent_no").alias("rule_no"), "kind", "text").join(rule, ["sheet_id", "rule_no"])
    members = nodes.where("role = 'selector'").select("sheet_id", F.col("parent_no").alias("head_no"), F.col("text").alias("member"))
    lists = heads.where("kind = 'selector_list'").join(members, ["sheet_id", "head_no"]).select("sheet_id", "rule_no", F.col("member").alias("selector"))
    selectors = heads.where("kind <> 'selector_list'").select("sheet_id", "rule_no", F.col("text").alias("selector")).unionByName(lists)
    value = F.regexp_replace(F.expr("substring(text, instr(text, ':') + 1)"), ";$", "")
    properties = nodes.where("kind = 'property'").select("sheet_id", F.col("parent_no").alias("rule_no"), F.col("ord").alias("prop_no"), F.col("name").alias("property"), value.alias("value"))
    return selectors.join(properties, ["sheet_id", "rule_no"])


def register(spark: SparkSession) -> None:
    """``css_nodes(css)`` and ``css_errors(css)`` as SQL table functions."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=NODES.replace("sheet_id string, ", ""))
    class Nodes:
        def eval(self, css: str):
            from bindery.css import parser

            yield from parser.rows(css)

    @udtf(returnType="err_no int, code string, details string, at int, around string")
    class Errors:
        def eval(self, css: str):
            from bindery.css import parser

            for i, e in enumerate(parser.parse(css).errors):
                yield i, e.code, e.details, e.at, e.around

    spark.udtf.register("css_nodes", Nodes)
    spark.udtf.register("css_errors", Errors)
