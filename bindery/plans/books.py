"""Queries over e-book files, plans and scalars: files are built from the driver's tables, read back and compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import binary as B
from bindery.functions import scalars as S
from bindery.operators import chapters as C
from bindery.operators import html as H
from bindery.operators import reconcile as R
from bindery.plans.catalog import query
from bindery.sinks import ebooks as sink
from bindery.sources import ebooks as source

# ------------------------------------------------------------------ books and their files

_BOOKS = """
SELECT s_suppkey AS id, s_name AS title, 'N' || s_nationkey || ' ' || s_suppkey AS author, 'house ' || s_nationkey AS publisher, 'en' AS language,
       9780000000000 + s_suppkey AS isbn, ['a' || s_nationkey, 'b'] AS subject FROM supplier
"""


def _books(t) -> DataFrame:
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return t("supplier").select(
        k.alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("N"), n, F.lit(" "), k).alias("author"), F.concat(F.lit("house "), n).alias("publisher"), F.lit("en").alias("language"),
        (F.lit(9780000000000) + k).cast("decimal(20,0)").alias("isbn"), F.array(F.concat(F.lit("a"), n), F.lit("b")).alias("subject"),
    )


_CHAPTERS = "SELECT ps.doc_id % (SELECT count(*) FROM supplier) + 1 AS id, doc_id AS chapter_no, 'part ' || doc_id AS title, '<p>' || replace(replace(left(text, 9000), '<', ' '), '&', ' ') || '</p>' AS html FROM documents ps WHERE text IS NOT NULL"


def _chapters(t) -> DataFrame:
    """Some documents of moderate length as chapters; the books of a few have several."""
    html = F.concat(F.lit("<p>"), F.translate(F.expr("left(text, 9000)"), "<&", "  "), F.lit("</p>"))
    own = t("documents").where("text is not null").crossJoin(F.broadcast(t("supplier").agg(F.count("*").alias("n"))))
    return own.select((F.col("doc_id") % F.col("n") + 1).alias("id"), F.col("doc_id").cast("int").alias("chapter_no"), F.concat(F.lit("part "), "doc_id").alias("title"), html.alias("html"))


_IMAGES = "SELECT s_suppkey AS id, i AS image_no, 'picture ' || i || ' of ' || s_name AS content FROM supplier, range(3) AS r(i) WHERE i < s_suppkey % 4"


def _images(t) -> DataFrame:
    rows = t("supplier").select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).where("i < s_suppkey % 4")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("i").cast("int").alias("image_no"), F.encode(F.concat(F.lit("picture "), "i", F.lit(" of "), "s_name"), "UTF-8").alias("content"))


def _files(t, form: str) -> DataFrame:
    built = sink.build(_books(t), _chapters(t), _images(t), form)
    return built.select(F.concat(F.col("id").cast("string"), F.lit("." + form)).alias("path"), "content")


def _id(path: str = "path"):
    return F.substring_index(path, ".", 1).cast("long")


_WITH_TEXT = f"SELECT b.* FROM ({_BOOKS}) b WHERE b.id IN (SELECT id FROM ({_CHAPTERS}))"
_METADATA = f"SELECT id, title, author, publisher, language, isbn::VARCHAR AS isbn, array_to_string(subject, '|') AS subject FROM ({_WITH_TEXT})"


def _metadata(files: DataFrame) -> DataFrame:
    return source.book_metadata(files).select(_id().alias("id"), "title", "author", "publisher", "language", F.col("isbn").cast("string").alias("isbn"), F.array_join("subject", "|").alias("subject"))


@query(_METADATA)
def mobi_metadata(t):
    return _metadata(_files(t, "mobi"))


@query(_METADATA.replace("array_to_string(subject, '|')", "array_to_string(subject, '|')"))
def epub_metadata(t):
    return _metadata(_files(t, "epub"))


@query(f"""
SELECT id, sha256('<html><head></head><body>' || string_agg(html, '' ORDER BY chapter_no) || '</body></html>') AS digest FROM ({_CHAPTERS}) WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY id
""")
def mobi_text(t):
    parts = source.book_chapters(_files(t, "mobi"))
    whole = parts.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter_no", "html"))), lambda x: x["html"]), "").alias("html"))
    return whole.select(_id().alias("id"), F.sha2("html", 256).alias("digest"))


_PICTURES = f"SELECT id, image_no, sha256(content) AS digest FROM ({_IMAGES}) WHERE id IN (SELECT id FROM ({_CHAPTERS}))"


def _pictures(files: DataFrame) -> DataFrame:
    return source.book_images(files).where("image_no is not null").select(_id().alias("id"), "image_no", F.sha2("content", 256).alias("digest"))


@query(_PICTURES)
def mobi_images(t):
    return _pictures(_files(t, "mobi"))


@query(_PICTURES)
def epub_images(t):
    return _pictures(_files(t, "epub"))


@query(f"""
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY chapter_no) - 1)::INT AS pos, title AS label FROM ({_CHAPTERS}) WHERE id IN (SELECT s_suppkey FROM supplier)
""")
def epub_spine(t):
    return source.book_chapters(_files(t, "epub")).select(_id().alias("id"), F.col("chapter_no").alias("pos"), F.col("title").alias("label"))


@query(f"""
WITH c AS (SELECT id, sum(strlen(html)) + 39 AS n FROM ({_CHAPTERS}) WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY id),
p AS (SELECT id, count(*) AS k FROM ({_IMAGES}) GROUP BY id)
SELECT c.id, (1 + (n + 4095) // 4096 + 3 + coalesce(k, 0) + 3)::BIGINT AS records, true AS gapless FROM c LEFT JOIN p ON c.id = p.id
""")
def mobi_records(t):
    rows = source.book_records(_files(t, "mobi"))
    sums = rows.groupBy("path").agg(F.count("*").alias("records"), (F.sum("length") == F.max(F.col("offset") + F.col("length")) - F.min("offset")).alias("gapless"))
    return sums.select(_id().alias("id"), "records", "gapless")


@query(f"""
WITH c AS (SELECT id, sum(strlen(html)) + 39 AS n FROM ({_CHAPTERS}) WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY id)
SELECT c.id, k AS field, CASE k WHEN 'compression' THEN 2 WHEN 'text_length' THEN n WHEN 'record_size' THEN 4096 WHEN 'text_records' THEN (n + 4095) // 4096
       WHEN 'encoding' THEN 65001 WHEN 'version' THEN 6 WHEN 'has_exth' THEN 1 WHEN 'has_drm' THEN 0 WHEN 'unique_id' THEN c.id END::BIGINT AS value
FROM c, (VALUES ('compression'), ('text_length'), ('record_size'), ('text_records'), ('encoding'), ('version'), ('has_exth'), ('has_drm'), ('unique_id')) AS f(k)
""")
def mobi_headers(t):
    names = ["compression", "text_length", "record_size", "text_records", "encoding", "version", "has_exth", "has_drm", "unique_id"]
    return source.book_headers(_files(t, "mobi")).where(F.col("field").isin(names)).select(_id().alias("id"), "field", "value")


@query(f"SELECT id, k AS type, CASE k WHEN 100 THEN author WHEN 101 THEN publisher WHEN 104 THEN isbn::VARCHAR WHEN 105 THEN array_to_string(subject, ', ') WHEN 503 THEN title WHEN 524 THEN language END AS value FROM ({_WITH_TEXT}), (VALUES (100), (101), (104), (105), (503), (524)) AS f(k)")
def exth_fields(t):
    return source.exth_records(_files(t, "mobi")).select(_id().alias("id"), "type", F.decode("value", "UTF-8").alias("value"))


@query(f"SELECT id, 'new ' || title AS title, author, 'x' AS publisher FROM ({_WITH_TEXT})")
def mobi_rewritten_metadata(t):
    updates = _books(t).select(F.concat(F.col("id").cast("string"), F.lit(".mobi")).alias("path"), F.concat(F.lit("new "), "title").alias("title"), "author", F.lit("x").alias("publisher"), "isbn")
    return source.book_metadata(sink.with_metadata(_files(t, "mobi"), updates)).select(_id().alias("id"), "title", "author", "publisher")


# ------------------------------------------------------------------ plans


def _paths(t) -> DataFrame:
    return t("part").select(F.concat(F.lit("lib/"), "p_name", F.lit("."), F.element_at(F.array(*map(F.lit, ("mobi", "epub", "txt", "azw3"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("path"), "p_partkey")


_PATHS = "SELECT 'lib/' || p_name || '.' || (['mobi', 'epub', 'txt', 'azw3'])[p_partkey % 4 + 1] AS path, p_partkey FROM part"


@query(f"""
WITH f AS ({_PATHS}), c AS (SELECT DISTINCT path FROM f WHERE p_partkey % 5 = 0)
SELECT path, CASE WHEN path LIKE '%.txt' THEN 'no reader for .txt' WHEN path IN (SELECT path FROM c) THEN 'the path is in the library' WHEN path LIKE '%.epub' THEN 'convert' ELSE 'copy' END AS outcome FROM f
""")
def bulk_import(t):
    files = _paths(t)
    plan, errors = R.bulk_import_plan(files.select("path"), files.where("p_partkey % 5 = 0").select("path"))
    return plan.select("path", F.col("action").alias("outcome")).unionByName(errors.select(F.col("item").alias("path"), F.col("error").alias("outcome")))


@query(f"WITH f AS ({_PATHS}), b AS (SELECT p_partkey AS id, path AS src_path, CASE WHEN p_partkey % 3 = 0 THEN path ELSE 'new/' || path END AS dst_path FROM f) SELECT id, 'move' AS action, src_path, dst_path FROM b WHERE src_path <> dst_path")
def reorganize(t):
    books = _paths(t).select(F.col("p_partkey").alias("id"), F.col("path").alias("file_path"))
    return R.reorganize_plan(books, F.when(F.col("id") % 3 == 0, F.col("file_path")).otherwise(F.concat(F.lit("new/"), "file_path")))


@query(f"""
SELECT p_partkey::VARCHAR AS item, path AS outcome FROM ({_PATHS}) WHERE p_partkey % 6 = 0
UNION ALL SELECT (-1 - s_suppkey)::VARCHAR, 'no such id' FROM supplier
""")
def delete_books(t):
    library = _paths(t).select(F.col("p_partkey").alias("id"), F.col("path").alias("file_path"))
    ids = library.where("id % 6 = 0").select("id").unionByName(t("supplier").select((-1 - F.col("s_suppkey")).alias("id")))
    gone, errors = R.delete_plan(library, ids)
    return gone.select(F.col("id").cast("string").alias("item"), F.col("src_path").alias("outcome")).unionByName(errors.select("item", F.col("error").alias("outcome")))


@query(f"SELECT p_partkey AS id, 'author ' || p_partkey % 9 AS author, path AS file_path FROM ({_PATHS}) WHERE p_partkey % 4 = 1")
def update_from_donors(t):
    books = _paths(t).select(F.col("p_partkey").alias("id"), F.lit("old").alias("author"), F.col("path").alias("file_path"))
    donors = books.where("id % 4 = 1").select("id", F.concat(F.lit("author "), F.col("id") % 9).alias("author"))
    return R.update_metadata_plan(books, donors, ["author"], F.col("file_path"))[0].select("id", "author", "file_path")


@query(f"WITH f AS ({_PATHS}) SELECT CASE WHEN path LIKE '%.txt' THEN 'no reader for .txt' ELSE 'the path is in the library' END AS error, count(*) AS n, min(path) AS first_item FROM f WHERE path LIKE '%.txt' OR path IN (SELECT path FROM f WHERE p_partkey % 5 = 0) GROUP BY 1")
def import_errors(t):
    files = _paths(t)
    return R.error_summary(R.bulk_import_plan(files.select("path"), files.where("p_partkey % 5 = 0").select("path"))[1])


@query("""
SELECT r_regionkey AS disk_id, n_nationkey AS partition_id, s_suppkey AS volume FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name LIKE '%A%'
""")
def device_volumes(t):
    disks = t("region").select(F.col("r_regionkey").alias("disk_id"), F.col("r_name").alias("device_id"))
    links = t("nation").select(F.col("n_regionkey").alias("disk_id"), F.col("n_nationkey").alias("partition_id"))
    volumes = t("supplier").select(F.col("s_nationkey").alias("partition_id"), F.col("s_suppkey").alias("volume"))
    return R.device_volumes(disks, links, volumes, vendor="A").select("disk_id", "partition_id", "volume")


# ------------------------------------------------------------------ scalars


@query("""
SELECT doc_id, ([1, 2] || [7, 8] || [3, 4])::VARCHAR AS inserted, [2, 3]::VARCHAR AS sub, [1, 9, 9, 4]::VARCHAR AS replaced, left(lang, 1) AS cut,
       'x, y z' AS joined, replace(left(source, 32), ' ', '_') || repeat('#', 32 - length(left(source, 32))) AS pdb FROM documents
""")
def sequence_scalars(t):
    a = F.array(*map(F.lit, (1, 2, 3, 4)))
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return t("documents").select(
        "doc_id", text(S.insert_after(a, 1, F.array(F.lit(7), F.lit(8)))).alias("inserted"), text(S.sub_array(a, 1, 2)).alias("sub"), text(S.replace_at(a, F.array(F.lit(9), F.lit(9)), 1)).alias("replaced"),
        S.truncate(F.col("lang"), 1).alias("cut"), S.join_subjects(S.split_subjects(F.lit("x , y z"))).alias("joined"), F.translate(S.pdb_title(F.col("source")), "\0", "#").alias("pdb"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS u32, (l_partkey % 65536)::VARCHAR AS u16, (l_partkey % 256)::VARCHAR AS u8, l_partkey::VARCHAR AS u64,
       (CASE WHEN l_partkey % 65536 >= 32768 THEN l_partkey % 65536 - 65536 ELSE l_partkey % 65536 END)::VARCHAR AS s16, (-l_partkey)::VARCHAR AS s64 FROM lineitem
""")
def integer_widths(t):
    own = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("n"))
    read = lambda c, size, signed=False: S.big_endian(c, 0, size, signed).cast("string")
    b = {k: S.big_endian_bytes(F.col("n"), k) for k in (1, 2, 4)}
    eight, negative = (F.unhex(F.lpad(F.hex(c), 16, "0")) for c in (F.col("n"), -F.col("n")))
    return own.select(
        "l_orderkey", "l_linenumber", read(b[4], 4).alias("u32"), read(b[2], 2).alias("u16"), read(b[1], 1).alias("u8"), read(eight, 8).alias("u64"), read(b[2], 2, True).alias("s16"), read(negative, 8, True).alias("s64")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def iso_dates(t):
    return t("orders").select("o_orderkey", S.iso_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("iso"))


@query("SELECT doc_id, 'abcabcabc!x y' || lang AS text FROM documents WHERE lang IS NOT NULL")
def palmdoc_fixed_bytes(t):
    """Three literals, a reference three back of six, a literal, a run of two, a space pair; then the language."""
    fixed = F.unhex(F.lit("616263801B2102" + "7820" + "79"))
    return t("documents").where("lang is not null").select("doc_id", F.decode(B.palmdoc_decompressed(F.concat(fixed, F.encode("lang", "UTF-8"))), "UTF-8").alias("text"))


@query("""
SELECT p_partkey, '.' || (['mobi', 'epub', 'txt', 'azw3'])[p_partkey % 4 + 1] AS extension, p_name AS base, 'lib/' || p_name || '.fb2' AS changed, p_name || '.' || (['mobi', 'epub', 'txt', 'azw3'])[p_partkey % 4 + 1] AS relative FROM part
""")
def path_parts(t):
    p = F.col("path")
    return _paths(t).select("p_partkey", S.extension(p).alias("extension"), F.regexp_replace(S.basename(p), r"\.[^.]*$", "").alias("base"), S.change_extension(p, ".fb2").alias("changed"), F.ltrim(S.relative_path(p, "lib"), F.lit("/\\")).alias("relative"))


@query("""
WITH n AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY o_custkey)
SELECT o_custkey, (i - 1)::INT AS rec_no, ks[i]::BIGINT AS "offset", (coalesce(ks[i + 1], 10000000000) - ks[i])::BIGINT AS length, (2 * (i - 1))::INT AS uid FROM (SELECT o_custkey, ks, unnest(range(1, len(ks) + 1)) AS i FROM n)
""")
def record_offsets(t):
    files = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("long"))).alias("records")).withColumn("total", F.lit(10000000000))
    return C.record_table(files, "o_custkey", "records", "total")


@query("SELECT n.n_regionkey AS g, s.suffix, arg_min(n.n_name, n.n_nationkey) AS name FROM (SELECT DISTINCT n_regionkey AS g, right(n_name, 2) AS suffix FROM nation UNION SELECT r_regionkey, '' FROM region) s JOIN nation n ON n.n_regionkey = s.g AND n.n_name LIKE '%' || s.suffix GROUP BY 1, 2")
def suffix_match_by_book(t):
    names = t("nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("name"), "n_nationkey")
    suffixes = names.select("g", F.expr("right(name, 2)").alias("suffix")).union(t("region").select("r_regionkey", F.lit(""))).distinct()
    return C.suffix_match(names, suffixes, "name", "suffix", "n_nationkey", group="g").select("g", "suffix", "name")


# ------------------------------------------------------------------ markup written back


def _pages(t) -> DataFrame:
    """A page for each part. Parts are dealt out before: a file of few MB is one split, but holds many pages to parse."""
    html = F.concat(F.lit('<p id="a'), "p_partkey", F.lit('">x</p><mbp:pagebreak/><a href="#a'), "p_partkey", F.lit('">go</a><img src="img/'), "p_brand", F.lit('.jpg"><b id="z">y</b>'))
    part = t("part").select("p_partkey", "p_brand")
    spark = part.sparkSession
    part = part.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return part.select(F.col("p_partkey").cast("string").alias("doc_id"), html.alias("html"), "p_brand", "p_partkey")


@query("""
SELECT p_partkey::VARCHAR AS doc_id, '<p id="0000000001">x</p><a href="#0000000001">go</a><img src="' || lpad((p_partkey % 100)::VARCHAR, 5, '0') || '.jpg"><b id="0000000002">y</b>' AS html FROM part
""")
def html_written_back(t):
    pages = _pages(t)
    names = pages.select("doc_id", F.concat(F.lit("OPS/img/"), "p_brand", F.lit(".jpg")).alias("name"), (F.col("p_partkey") % 100).alias("ord"))
    return H.process_html(pages, "doc_id", "html", names)


@query("SELECT p_partkey::VARCHAR AS doc_id, 3 AS node_no, 'img/' || p_brand || '.jpg' AS src, lpad((p_partkey % 100)::VARCHAR, 5, '0') || '.jpg' AS new_src FROM part")
def image_names(t):
    pages = _pages(t)
    names = pages.select("doc_id", F.concat(F.lit("OPS/img/"), "p_brand", F.lit(".jpg")).alias("name"), (F.col("p_partkey") % 100).alias("ord"))
    return H.image_names(H.html_nodes(pages, "doc_id", "html"), names)


@query("SELECT p_partkey::VARCHAR AS doc_id, 2 AS node_no, '0000000000' AS filepos FROM part")
def mobi_filepos(t):
    return H.resolve_filepos(H.html_nodes(_pages(t), "doc_id", "html"))


@query(f"SELECT id, 'compression: 2\ntext_length: ' || n AS text FROM (SELECT id, sum(strlen(html)) + 39 AS n FROM ({_CHAPTERS}) WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY id)")
def mobi_header_text(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("compression:") | x.startswith("text_length:"))
    return source.header_text(_files(t, "mobi")).select(_id().alias("id"), F.array_join(lines, "\n").alias("text"))


# ------------------------------------------------------------------ trees and grids


@query(f"""
WITH f AS ({_PATHS}), a AS (SELECT path FROM f WHERE path NOT LIKE '%.txt') SELECT path, true AS is_file, 'lib' AS parent FROM a UNION ALL SELECT DISTINCT 'lib', false, '' FROM a
""")
def book_tree(t):
    return source.tree(_paths(t)).select("path", "is_file", "parent")


@query("""
WITH f AS (SELECT 'm' || p_partkey % 4 || '/' || p_brand || '/' || p_partkey || '.mobi' AS path, p_partkey FROM part)
SELECT path FROM f WHERE path LIKE 'm1/%' OR p_partkey % 10 = 0
""")
def selected_files(t):
    files = t("part").select(F.concat(F.lit("m"), F.col("p_partkey") % 4, F.lit("/"), "p_brand", F.lit("/"), "p_partkey", F.lit(".mobi")).alias("path"), "p_partkey")
    checked = files.where("p_partkey % 10 = 0").select("path").unionByName(t("region").select(F.lit("m1").alias("path")))
    return source.selected_files(source.tree(files), checked)


@query("SELECT doc_id AS \"Id\", CASE WHEN lang = 'en' THEN 'Visible' ELSE 'Collapsed' END AS \"Shown\", coalesce(lang = 'en', false) AS \"Back\" FROM documents")
def headed_columns(t):
    shown = S.visibility(F.col("lang") == "en")
    rows = t("documents").select("doc_id", "source", shown.alias("shown"), S.is_visible(shown).alias("back"))
    return R.headed_columns(rows, {"doc_id": "Id", "source": None, "shown": "Shown", "back": "Back"})
