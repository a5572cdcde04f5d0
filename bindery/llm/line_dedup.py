"""Operator 6: line deduplication over overlapping windows of consecutive lines, in DataFrame operations only.

Each window of ``lines`` consecutive lines is hashed (two 64-bit hashes). Of the places of a window in
the corpus the first, by doc_id and line, stays; the lines of every later place are covered, and
covered lines are removed. Windows are judged on the input, not on what is left.

Nulls: a null text stays null and has no lines. A null doc_id comes before all others. Rows of equal
doc_id and text hold the same places, so neither is the later. Texts of fewer lines than a window,
and windows without a visible character, are left alone. An empty table gives no rows. A very long text
takes time in proportion to its lines. Columns named as results give way to them; all others are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, small, table

_FIRST = -(2**63)


def line_dedup(docs: DataFrame, lines: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with text without later repeats, and n_lines, n_removed, kept."""
    scratch = Scratch(docs.sparkSession, "lines")
    d, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)), F.xxhash64("text")
    split = docs.where("text is not null").select(d.alias("d"), t.alias("t"), F.split("text", "\n").alias("ls"))
    many = split.where(F.size("ls") >= lines)

    def window(i):
        return [F.get("ls", i + k) for k in range(lines)]

    hashes = F.transform(
        F.sequence(F.lit(0), F.size("ls") - lines),
        lambda i: F.when(F.concat(*window(i)).rlike(r"\S"), F.struct(F.xxhash64(*window(i)).alias("a"), F.xxhash64(F.lit("line window"), *window(i)).alias("b"))),
    )
    windows = many.select("d", "t", F.posexplode(hashes).alias("p", "h")).where("h is not null").select("d", "t", "p", "h.a", "h.b")
    windows = scratch.table(windows, "windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("d", "p")).alias("f"), F.count("*").alias("n")).where("n > 1").select("a", "b", "f")
    later = windows.join(small(scratch.table(first, "first")), ["a", "b"]).where(F.struct("d", "p") > F.col("f"))
    covered = later.groupBy("d", "t").agg(F.collect_set("p").alias("ps"))
    covered = small(scratch.table(covered, "covered"))

    names = docs.columns
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), d.alias("d"), t.alias("t"))
    joined = full.join(covered, ["d", "t"], "left")
    joined = joined.withColumn("ls", F.split("row.text", "\n"))
    removed = F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(p, p + lines - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), removed)
    joined = joined.withColumn("left", F.when(F.col("ps").isNotNull() & F.col("row.text").isNotNull(), left))
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("ls", i)), "\n"))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("ls")).cast("long")
    names = [c for c in names if c not in ("n_lines", "n_removed", "kept")]  # which give way to the results
    columns = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names]
    joined = joined.withColumn("_n", n).withColumn("_gone", F.when(F.col("left").isNull(), F.lit(0).cast("long")).otherwise(F.col("_n") - F.size("left")))
    return joined.select(*columns, F.col("_n").alias("n_lines"), F.col("_gone").alias("n_removed"), ((F.col("_gone") == 0) | (F.col("_gone") < F.col("_n"))).alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, p, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS win
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM w
                         WHERE win IS NOT NULL AND regexp_matches(win, '\S')) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) AS s(k)
), marked AS (
  SELECT l.doc_id, l.p, l.line, g.p IS NOT NULL AS gone FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
