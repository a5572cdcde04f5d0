"""Ordered computations over chapters, records and markup: slices, offsets, folding, numbering, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.operators.reconcile import allocate_ids


def slice_ends(df: DataFrame, group: str, start: str, total: str | None = None) -> DataFrame:
    """``end`` of each slice: the next start of its group, or ``total`` for the last."""
    following = F.lead(start).over(Window.partitionBy(group).orderBy(start))
    return df.withColumn("end", F.coalesce(following, F.col(total)) if total else following)


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    return F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))


def content_slices(starts: DataFrame, contents: DataFrame, group: str, start: str, content: str) -> DataFrame:
    """(group, start, slice): each group's content cut at its starts. The content meets them once, in one row, and is cut there."""
    places = starts.groupBy(group).agg(F.sort_array(F.collect_set(F.col(start).cast("long"))).alias("_starts"))
    joined = contents.join(places, group)
    following = lambda i: F.coalesce(F.get("_starts", i + 1), F.octet_length(content).cast("long"))
    cut = F.transform("_starts", lambda a, i: F.struct(a.alias("start"), F.substring(F.col(content), (a + 1).cast("int"), (following(i) - a).cast("int")).alias("slice")))
    return joined.select(group, F.explode(cut).alias("_s")).select(group, F.col("_s.start").alias(start), F.col("_s.slice").alias("slice"))


def running_offset(df: DataFrame, group: str | list[str], order: str | list[str], length: Column, base=0, name: str = "offset") -> DataFrame:
    """Where each row starts if the rows of a group stand end to end from ``base``."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.lit(base) + F.coalesce(F.sum(length).over(w), F.lit(0)))


def chunk_rows(df: DataFrame, data: str, size: int = 4096) -> DataFrame:
    """A row (chunk_no, chunk) for each ``size`` bytes of a binary column; none for empty data."""
    n = F.octet_length(data)
    chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    return df.select("*", F.explode(chunks).alias("chunk_no")).withColumn("chunk", F.substring(F.col(data), F.col("chunk_no") * size + 1, F.lit(size)))


def fold_unnamed(df: DataFrame, group: str, order: str, name: str, content: str, leading: str = "Begin Reading", separator: str = "") -> DataFrame:
    """(group, chapter_no, name, content): unnamed parts join the named one before; leading ones get a name of their own."""
    w = Window.partitionBy(group).orderBy(order)
    named = F.col(name).isNotNull() & (F.col(name) != "")
    islands = df.withColumn("_island", F.sum(named.cast("int")).over(w))
    out = islands.groupBy(group, "_island").agg(F.max(F.when(named, F.col(name))).alias("_name"), F.sort_array(F.collect_list(F.struct(order, content))).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda x: x[content]), separator)
    number = F.row_number().over(Window.partitionBy(group).orderBy("_island"))
    return out.select(group, number.alias("chapter_no"), F.coalesce("_name", F.lit(leading)).alias(name), text.alias(content))


def renumber(df: DataFrame, group: str | None, order: str | list[str], width: int = 10, prefix: str = "", suffix: str = "", name: str = "new_id", start: int = 1) -> DataFrame:
    """Numbers in order within each group, or over all rows (then by ranges), padded with zeros to ``width``."""
    if group is None:
        numbered = allocate_ids(df, start - 1, *([order] if isinstance(order, str) else order), key="_number")
        number = F.col("_number")
    else:
        numbered, number = df, F.row_number().over(Window.partitionBy(group).orderBy(order)) + start - 1
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"), F.lit(suffix))).drop("_number")


def toc_asof(lookups: DataFrame, elements: DataFrame, group: str, position: str, at: str, payload: list[str]) -> DataFrame:
    """(group, position, payload) of the element before the first one that starts after each distinct position.

    If the first element starts after it, that one is taken; a position at or beyond the last element gives no row.
    One union and one window per group, rather than a join on inequality.
    """
    wanted = lookups.select(group, position).distinct()
    value = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in payload])
    rows = elements.select(group, F.col(at).alias("_pos"), F.lit(0).alias("_kind"), value.alias("_value"))
    rows = rows.unionByName(wanted.select(group, F.col(position).alias("_pos"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    by_place = Window.partitionBy(group).orderBy("_pos", "_kind", F.col("_value._at"))
    whole = Window.partitionBy(group)
    rows = rows.withColumn("_found", F.last("_value", ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_head", F.min("_value").over(whole)).withColumn("_last", F.max(F.col("_value._at")).over(whole))
    rows = rows.where((F.col("_kind") == 1) & (F.col("_pos") < F.col("_last"))).withColumn("_found", F.coalesce("_found", "_head"))
    return rows.select(group, F.col("_pos").alias(position), *[F.col(f"_found.{c}").alias(c) for c in payload])


def spine_chapters(spine: DataFrame, manifest: DataFrame, ncx: DataFrame, group: str = "book_id") -> DataFrame:
    """Spine (pos, idref) joined with the manifest (id, href) and, where there is one, its label (src, label), in order of pos."""
    docs = spine.join(manifest.withColumnRenamed("id", "idref"), [group, "idref"])
    labels = ncx.select(group, F.col("src").alias("href"), "label", "play_order")
    w = Window.partitionBy(group, "href").orderBy("play_order")
    labels = labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "play_order")
    return docs.join(labels, [group, "href"], "left")


def nav_points(points: DataFrame) -> DataFrame:
    """Points (play_order text, src, label) that have a number and a source, with fragments cut off, in order."""
    order = F.col("play_order").try_cast("int")
    kept = points.where(order.isNotNull() & F.col("src").isNotNull() & (F.col("src") != "")).withColumn("play_order", order)
    return kept.withColumn("src", F.substring_index("src", "#", 1)).orderBy("play_order")


def suffix_match(names: DataFrame, suffixes: DataFrame, name: str, suffix: str, order: str, group: str | None = None) -> DataFrame:
    """For each suffix the first name, by ``order``, that ends with it; of the same ``group`` if one is given.

    Names are exploded to their endings of the lengths that occur among the suffixes, so the join is on equality.
    """
    by = [group] if group else []
    kinds = suffixes.agg(F.sort_array(F.collect_set(F.length(suffix))).alias("_lengths"))  # a number for each length that occurs
    endings = names.join(F.broadcast(kinds)).select(*by, name, order, F.explode(F.filter("_lengths", lambda n: n <= F.length(name))).alias("_n"))
    endings = endings.withColumn("_end", F.when(F.col("_n") > 0, F.expr(f"right({name}, _n)")).otherwise(F.lit("")))
    first = endings.groupBy(*by, "_end").agg(F.min_by(name, order).alias(name))
    return suffixes.withColumn("_end", F.col(suffix)).join(first, [*by, "_end"], "left").drop("_end")


def chapter_offsets(chapters: DataFrame, group: str, order: str, html: str, base: int = 0) -> DataFrame:
    """Byte offset and length of each chapter in the joined text, and a last row of the end of all."""
    sized = running_offset(chapters.withColumn("length", F.octet_length(html)), group, order, F.col("length"), base)
    ends = sized.groupBy(group).agg((F.max(F.col("offset") + F.col("length"))).alias("offset")).withColumn("length", F.lit(0))
    return sized.select(group, order, "offset", "length").unionByName(ends.withColumn(order, F.lit(None).cast(chapters.schema[order].dataType)).select(group, order, "offset", "length"))


def record_table(files: DataFrame, group: str, records: str, length: str) -> DataFrame:
    """(group, rec_no, offset, length) from an array of record offsets; the last record ends with the file."""
    rows = files.select(group, length, F.posexplode(records).alias("rec_no", "offset"))
    following = F.lead("offset").over(Window.partitionBy(group).orderBy("rec_no"))
    return rows.select(group, "rec_no", "offset", (F.coalesce(following, F.col(length)) - F.col("offset")).alias("length"), (F.col("rec_no") * 2).alias("uid"))
