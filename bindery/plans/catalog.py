"""The library's queries over the driver's tables, by name, with the same in DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.deploy import ship
from bindery.functions import binary as B
from bindery.functions import scalars as S
from bindery.operators import chapters as C
from bindery.operators import css_tables as css
from bindery.operators import html as H
from bindery.operators import reconcile as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


# ------------------------------------------------------------------ reconciliation


def _local(t):
    return t("documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "lang", "source")


def _remote(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return docs.join(t("labels").select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("source", F.concat(F.lit("device "), "source"))


_LOCAL = "SELECT doc_id AS id, lang, source FROM documents WHERE doc_id % 3 <> 0"
_REMOTE = "SELECT doc_id AS id, lang, 'device ' || source AS source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


@query(f"""
WITH l AS ({_LOCAL}), r AS ({_REMOTE})
SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.lang ELSE r.lang END AS lang,
       CASE WHEN l.id IS NOT NULL THEN l.source ELSE r.source END AS source,
       l.id IS NOT NULL AS is_local, r.id IS NOT NULL AS is_remote
FROM l FULL OUTER JOIN r ON l.id = r.id
""")
def combined_library(t):
    return R.combined_library(_local(t), _remote(t))


@query(f"SELECT id, lang, source, true AS is_local, false AS is_remote FROM ({_LOCAL})")
def detach_remote(t):
    return R.detach_remote(R.combined_library(_local(t), _remote(t)))


@query(f"WITH l AS ({_LOCAL}), r AS ({_REMOTE}) SELECT * FROM l UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)")
def merge_libraries(t):
    return R.merge_libraries(_local(t), _remote(t))


@query(f"SELECT * FROM ({_LOCAL}) WHERE id NOT IN (SELECT doc_id FROM labels)")
def sync_plan(t):
    return R.sync_plan(_local(t), _remote(t))


@query(f"SELECT * FROM ({_LOCAL}) WHERE id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr'")
def sync_plan_excluding(t):
    return R.sync_plan(_local(t), _remote(t), _local(t).where("lang = 'fr'"))


@query("SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS in_library FROM documents")
def in_library(t):
    return R.in_library(t("documents").select(F.col("doc_id").alias("id")), _remote(t))


@query(f"""
WITH l AS ({_LOCAL}), r AS ({_REMOTE})
SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN 0 WHEN r.id IS NOT NULL THEN 1 ELSE 2 END AS scope
FROM l FULL OUTER JOIN r ON l.id = r.id
""")
def delete_scope(t):
    combined = R.combined_library(_local(t), _remote(t))
    return combined.select("id", R.delete_scope(F.col("is_local"), F.col("is_remote")).alias("scope"))


@query(f"WITH l AS ({_LOCAL}) SELECT * FROM l WHERE id % 10 <> 1")
def remove_selected(t):
    selected = t("documents").where("doc_id % 5 = 1").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("scope"))
    return R.remove_selected(_local(t), _remote(t), selected)[0]


@query("SELECT DISTINCT source AS value FROM documents WHERE source <> '' UNION SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> ''")
def distinct_authors(t):
    a = t("documents").select(F.col("source").alias("value")).union(t("customer").select("c_mktsegment"))
    return R.distinct_values(a, "value", drop_blank=True)


@query(f"SELECT l.id, coalesce(u.lang, l.lang) AS lang, l.source FROM ({_LOCAL}) l LEFT JOIN (SELECT doc_id, 'x-' || lang AS lang FROM documents WHERE doc_id % 7 = 0) u ON l.id = u.doc_id")
def propagate_metadata(t):
    updates = t("documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("x-"), "lang").alias("lang"))
    return R.propagate_metadata(_local(t), updates, ["lang"])


@query("""
WITH scanned AS (SELECT p_name || '/' || p_partkey AS file_path, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey END AS isbn FROM part),
old AS (SELECT l_partkey AS isbn, min(l_orderkey) AS id FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey <> 0 GROUP BY l_partkey),
s AS (SELECT o.id, o.isbn AS series, s.file_path, s.isbn FROM scanned s LEFT JOIN old o ON s.isbn = o.isbn AND s.isbn <> 0)
SELECT id::INT AS id, file_path, isbn, series::VARCHAR AS series FROM s WHERE id IS NOT NULL
UNION ALL
SELECT (1000000 + row_number() OVER (ORDER BY file_path))::INT, file_path, isbn, '' FROM s WHERE id IS NULL
""")
def rescan_identity(t):
    scanned = t("part").select(F.concat_ws("/", "p_name", "p_partkey").alias("file_path"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_partkey")).alias("isbn"), F.lit("").alias("series"))
    old = t("lineitem").where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("isbn"), F.col("l_partkey").cast("string").alias("series"))
    return R.rescan_identity(scanned, old, 1000000, carry=("series",))


_ACTIONS = """
WITH incoming AS (SELECT o_orderkey AS id, 'c' || o_custkey AS path FROM orders),
catalog AS (SELECT o_orderkey AS id, 'c' || o_custkey AS path FROM orders WHERE o_orderkey % 5 = 0),
files AS (SELECT DISTINCT 'c' || c_custkey AS path FROM customer WHERE c_custkey % 2 = 0),
paths AS (SELECT path, min(id) AS path_id FROM catalog GROUP BY path),
j AS (SELECT i.id, i.path, p.path_id, c.id IS NOT NULL AS known, p.path IS NOT NULL AS path_known, f.path IS NOT NULL AS there
      FROM incoming i LEFT JOIN (SELECT DISTINCT id FROM catalog) c ON i.id = c.id LEFT JOIN paths p ON i.path = p.path LEFT JOIN files f ON i.path = f.path),
a AS (SELECT *, {case} AS action FROM j)
SELECT id, path, action, CASE WHEN action = 'rekey' THEN path_id ELSE id END AS target_id FROM a
"""


def _imports(t):
    incoming = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("path"))
    files = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("path"))
    return incoming, incoming.where("id % 5 = 0"), files


@query(_ACTIONS.format(case="CASE WHEN known THEN 'merge' WHEN there AND path_known THEN 'rekey' WHEN there THEN 'overwrite' ELSE 'insert' END"))
def import_actions(t):
    return R.import_actions(*_imports(t))


@query(_ACTIONS.format(case="CASE WHEN known THEN 'update' WHEN there AND NOT path_known THEN 'overwrite' WHEN path_known THEN 'rekey' ELSE 'copy' END"))
def device_import_actions(t):
    return R.import_actions(*_imports(t), device=True)


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part")
def display_grid(t):
    books = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), "p_size")
    return R.display_grid(books, ["p_size"], "title", descending=True)


# ------------------------------------------------------------------ scalars

_SAFE = r"""array_to_string(list_transform(list_zip(string_split({x}, '\'), range(len(string_split({x}, '\')))), lambda z: CASE WHEN z[2] = 0 THEN z[1]
  ELSE regexp_replace(regexp_replace(z[1], '(["<>|:*?\\/\x00-\x1F]*\.+$)|(["<>|:*?\\/\x00-\x1F]+)', '_', 'g'), '_{{2,}}', '_', 'g') END), '\')"""


@query("""
SELECT c_custkey AS id, trim(replace(replace(replace(regexp_replace('[' || n_name || '] ' || c_name || '  (' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END || ')', ' {2,}', ' ', 'g'), '[]', ''), '{}', ''), '()', '')) AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def template_path(t):
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    values = {"Series": F.col("n_name"), "Title": F.col("c_name"), "Author": F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))}
    return df.select(F.col("c_custkey").alias("id"), S.dict_format("[{Series}] {Title}  ({Author})", values).alias("path"))


@query(f"SELECT page_id, {_SAFE.format(x=r"('C:\lib\' || replace(url, '/', '\') || '::?.')")} AS path FROM pages")
def filesystem_safe(t):
    return t("pages").select("page_id", S.filesystem_safe(F.concat(F.lit("C:\\lib\\"), F.translate("url", "/", "\\"), F.lit("::?."))).alias("path"))


@query(r"""
SELECT p_partkey AS id, p_brand || '\' || p_name || ' (' || p_partkey || ')' || '.mobi' AS path FROM part
""")
def format_file_path(t):
    books = t("part").select(F.col("p_partkey").alias("isbn"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit("").alias("publisher"), F.lit("").alias("pub_date"), F.lit("").alias("series"), F.lit(0.0).alias("series_num"))
    template = S.file_path_template("{Author}", "{Title} ({ISBN})")
    return books.select(F.col("isbn").alias("id"), S.format_file_path(template, S.props(), F.lit("x/y.mobi")).alias("path"))


@query("""
SELECT p_partkey AS id, CASE WHEN len(w) = 1 THEN p_name ELSE w[-1] || ', ' || array_to_string(w[1:-2], ' ') END AS author
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
""")
def sort_author(t):
    return t("part").select(F.col("p_partkey").alias("id"), S.sort_author(F.col("p_name")).alias("author"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(date_trunc('year', o_orderdate), '%-m/%-d/%Y') WHEN 1 THEN strftime(date_trunc('month', o_orderdate), '%-m/%-d/%Y')
       WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS pub_date
FROM orders
""")
def normalize_date(t):
    k = F.col("o_orderkey") % 4
    form = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return t("orders").select(F.col("o_orderkey").alias("id"), S.normalize_date(form).alias("pub_date"))


@query("SELECT event_id, (epoch_us(ts) // 1000000 + 2082844800)::BIGINT AS seconds FROM events")
def mobi_timestamp(t):
    return t("events").select("event_id", S.mobi_timestamp(F.col("ts")).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '' ELSE printf('%.1f', l_discount * 10) END AS shown FROM lineitem")
def display_float(t):
    tenths = F.col("l_discount") * 10
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(S.float_to_text(F.col("l_discount")) == "", "").otherwise(S.one_decimal(tenths)).alias("shown"))


@query("""
SELECT doc_id, (doc_id * 32 + doc_id % 7)::DECIMAL(20,0) AS number, bit_count(doc_id)::INT AS bits, (doc_id % 65536)::DECIMAL(20,0) AS u16,
       CASE WHEN doc_id % 256 >= 128 THEN doc_id % 256 - 256 ELSE doc_id % 256 END::DECIMAL(20,0) AS s8 FROM documents
""")
def big_endian(t):
    data = S.big_endian_bytes(F.col("doc_id"), 4)
    text = F.concat(F.conv(F.col("doc_id").cast("string"), 10, 32), (F.col("doc_id") % 7).cast("string"))
    return t("documents").select("doc_id", S.base32(text).alias("number"), S.bit_count(F.col("doc_id")).alias("bits"), S.big_endian(data, 2, 2).alias("u16"), S.big_endian(data, 3, 1, signed=True).alias("s8"))


@query("SELECT doc_id, doc_id AS forward, doc_id * 3 AS backward FROM documents")
def vwi_round_trip(t):
    return t("documents").select("doc_id", B.vwi_decoded(B.vwi_encoded(F.col("doc_id"))).alias("forward"), B.vwi_decoded(B.vwi_encoded(F.col("doc_id") * 3, False), False).alias("backward"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def palmdoc_round_trip(t):
    back = B.palmdoc_decompressed(B.palmdoc_compressed(F.encode("text", "UTF-8")))
    return t("documents").select("doc_id", F.sha2(back, 256).alias("digest"))


@query("""
SELECT doc_id, len(string_split(text, ' '))::INT AS n, string_split(text, ' ')[-1] AS last_word, (string_split(text, ' ') || ['x'])[2] AS second, list_distinct(string_split(lang, '')).list_sort() AS letters FROM documents
""")
def array_functions(t):
    words = F.split("text", " ")
    return t("documents").select("doc_id", S.total_length(F.array(words)).alias("n"), S.last(words).alias("last_word"), F.get(S.append_item(words, F.lit("x")), 1).alias("second"), F.sort_array(F.array_distinct(F.split("lang", ""))).alias("letters"))


# ------------------------------------------------------------------ chapters and windows

_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


def _lines(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


@query(f"""
SELECT doc_id, line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       strlen(line)::INT AS length FROM ({_LINES})
""")
def running_offsets(t):
    rows = C.running_offset(_lines(t).withColumn("length", F.octet_length("line")), "doc_id", "line_no", F.octet_length("line") + 1)
    return rows.select("doc_id", "line_no", F.col("offset").cast("long").alias("offset"), "length")


@query(f"""
WITH s AS (SELECT doc_id, line_no, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ({_LINES}))
SELECT doc_id, place::BIGINT AS start, sha256(line || CASE WHEN lead(place) OVER (PARTITION BY doc_id ORDER BY line_no) IS NULL THEN '' ELSE chr(10) END) AS digest FROM s
""")
def chapter_slices(t):
    starts = C.running_offset(_lines(t).select("doc_id", "line_no", F.octet_length("line").alias("length")), "doc_id", "line_no", F.col("length") + 1, name="start")
    return C.content_slices(starts, t("documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id", "start", "content").select(
        "doc_id", "start", F.sha2("slice", 256).alias("digest")
    )


@query("""
SELECT doc_id, i::INT AS chunk_no, least(4096, strlen(text) - i * 4096)::INT AS length
FROM (SELECT doc_id, text, unnest(range((strlen(text) + 4095) // 4096)) AS i FROM documents)
""")
def chunk_4096(t):
    chunks = C.chunk_rows(t("documents").select("doc_id", F.encode("text", "UTF-8").alias("data")), "data")
    return chunks.select("doc_id", "chunk_no", F.octet_length("chunk").alias("length"))


@query("""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'turn ' || turn END AS name FROM conversations),
i AS (SELECT *, sum(CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY island)::INT AS chapter_no, coalesce(max(name), 'Begin Reading') AS name, string_agg(text, '' ORDER BY turn) AS text
FROM i GROUP BY conv_id, island
""")
def merge_unnamed_chapters(t):
    parts = t("conversations").withColumn("name", F.when(F.col("role") == "user", F.concat(F.lit("turn "), F.col("turn"))))
    return C.fold_unnamed(parts, "conv_id", "turn", "name", "text")


@query("SELECT page_id, url, lpad(row_number() OVER (PARTITION BY length(url) ORDER BY page_id)::VARCHAR, 10, '0') AS new_id FROM pages")
def renumber_ids(t):
    return C.renumber(t("pages").withColumn("g", F.length("url")), "g", "page_id").select("page_id", "url", "new_id")


@query("""
WITH look AS (SELECT DISTINCT user_id % 50 AS g, epoch_us(ts) // 1000000 AS pos FROM events WHERE event_type = 'click'),
el AS (SELECT user_id % 50 AS g, event_id, epoch_us(ts) // 1000000 AS "at" FROM events WHERE event_type = 'view'),
m AS (SELECT g, max("at") AS last_at FROM el GROUP BY g),
h AS (SELECT g, arg_min(event_id, ("at", event_id)) AS head FROM el GROUP BY g),
b AS (SELECT l.g, l.pos, arg_max(e.event_id, (e."at", e.event_id)) AS event_id FROM look l JOIN el e ON l.g = e.g AND e."at" <= l.pos GROUP BY l.g, l.pos)
SELECT l.g, l.pos, coalesce(b.event_id, h.head) AS event_id FROM look l JOIN m ON l.g = m.g JOIN h ON l.g = h.g LEFT JOIN b ON b.g = l.g AND b.pos = l.pos WHERE l.pos < m.last_at
""")
def toc_asof(t):
    e = t("events").select((F.col("user_id") % 50).alias("g"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"), "event_type")
    # elements in document order: of those at one place the last stands before what follows
    elements = e.where("event_type = 'view'").withColumnRenamed("pos", "at")
    return C.toc_asof(e.where("event_type = 'click'"), elements, "g", "pos", "at", ["event_id"])


@query("""
SELECT l_orderkey AS book_id, l_linenumber AS pos, p_name AS href, s_name AS label
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON l_suppkey = s_suppkey
""")
def spine_manifest_ncx(t):
    spine = t("lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("idref"), "l_suppkey")
    docs = spine.join(t("part").select(F.col("p_partkey").alias("idref"), F.col("p_name").alias("href")), "idref")
    labels = t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("label"))
    return docs.join(labels, "l_suppkey", "left").select("book_id", "pos", "href", "label")


@query("""
WITH ncx AS (SELECT l_orderkey AS book_id, p_name AS src, min_by(s_name, l_linenumber) AS label
             FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 2 = 0 GROUP BY l_orderkey, p_name)
SELECT l_orderkey AS book_id, l_linenumber AS pos, p_name AS href, label
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN ncx ON l_orderkey = ncx.book_id AND p_name = ncx.src
""")
def spine_labels(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("idref"), "l_suppkey", F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("play_order"))  # of equal lines, the first of the file
    part = t("part").select(F.col("p_partkey").alias("idref"), F.col("p_name").alias("href"))
    manifest = lines.select("book_id", "idref").distinct().join(part, "idref").select("book_id", F.col("idref").alias("id"), "href")
    ncx = lines.join(part, "idref").join(t("supplier").where("s_suppkey % 2 = 0"), F.col("l_suppkey") == F.col("s_suppkey")).select("book_id", F.col("href").alias("src"), F.col("s_name").alias("label"), "play_order")
    return C.spine_chapters(lines.select("book_id", "pos", "idref"), manifest, ncx).select("book_id", "pos", "href", "label")


@query("""
WITH s AS (SELECT DISTINCT right(p_name, 6) AS suffix FROM part)
SELECT suffix, (SELECT arg_min(p_name, p_partkey) FROM part WHERE p_name LIKE '%' || suffix) AS name FROM s
""")
def suffix_match(t):
    suffixes = t("part").select(F.expr("right(p_name, 6)").alias("suffix")).distinct()
    return C.suffix_match(t("part"), suffixes, "p_name", "suffix", "p_partkey").select("suffix", F.col("p_name").alias("name"))


# ------------------------------------------------------------------ markup


@query("SELECT page_id::VARCHAR AS page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_anchors(t):
    return H.anchors(H.html_nodes(t("pages"), "page_id", "html")).select(F.col("doc_id").alias("page_id"), "href")


@query("SELECT page_id::VARCHAR AS page_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages WHERE html LIKE '%<title>%'")
def html_titles(t):
    return H.titles(H.html_nodes(t("pages"), "page_id", "html")).select(F.col("doc_id").alias("page_id"), "title")


#: The pages' start tags in order; their scripts and comments hold none.
_TAGS = """
SELECT doc_id, node_no, tag, lower(regexp_extract(tag, '<([a-zA-Z0-9:]+)', 1)) AS name, string_split(regexp_extract(tag, ' class="([^"]*)"', 1), ' ') AS classes, regexp_extract(tag, ' id="([^"]*)"', 1) AS own
FROM (SELECT page_id::VARCHAR AS doc_id, unnest(tags) AS tag, (generate_subscripts(tags, 1) - 1)::INT AS node_no FROM (SELECT page_id, regexp_extract_all(html, '<[a-zA-Z][^>]*>') AS tags FROM pages))
"""
_SELECTORS = f"""
WITH g AS ({_TAGS}), c AS (SELECT doc_id, node_no, name, unnest(classes) AS c FROM g)
SELECT doc_id, node_no, name AS selector FROM g UNION SELECT doc_id, node_no, name || '#' || own FROM g WHERE own <> '' UNION SELECT doc_id, node_no, '#' || own FROM g WHERE own <> ''
UNION SELECT doc_id, node_no, name || '.' || c FROM c WHERE c <> '' UNION SELECT doc_id, node_no, '.' || c FROM c WHERE c <> ''
"""


@query(_SELECTORS)
def html_candidate_selectors(t):
    return H.candidate_selectors(H.html_nodes(t("pages"), "page_id", "html"))


def _sheets(t):
    nodes = H.html_nodes(t("pages"), "page_id", "html").where("tag = 'style'")
    return nodes.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("css"))


@query()
def css_nodes(t):
    return css.css_nodes(_sheets(t), "doc_id", "css")


#: The pages' sheets hold one rule of one property each, which SQL can take apart.
_ONE_RULE = r"""
SELECT page_id::VARCHAR AS id, regexp_extract(html, '<style>([^{]*)\{', 1) AS selector, regexp_extract(html, '<style>[^{]*\{([^:}]*):', 1) AS property,
       regexp_extract(html, '<style>[^{]*\{[^:}]*:([^;}]*)', 1) AS value FROM pages WHERE regexp_matches(html, '<style>[^{]*\{[^:}]*:')
"""


@query(f"SELECT id AS sheet_id, 1 AS rule_no, selector, 0 AS prop_no, property, value FROM ({_ONE_RULE})")
def css_rules(t):
    return css.css_rules(css.css_nodes(_sheets(t), "doc_id", "css"))


@query(r"""
SELECT page_id::VARCHAR AS sheet_id, regexp_extract(html, '<style>[^{]*\{(margin:[^;}]*)', 1) || ';' AS text FROM pages WHERE regexp_matches(html, '<style>[^{]*\{margin:')
""")
def css_find_property(t):
    nodes = css.css_nodes(_sheets(t), "doc_id", "css")
    return css.css_find(nodes, F.col("name") == "margin", ("property",)).select("sheet_id", "text")


@query(f"""
SELECT id AS doc_id, rule || '.x{{a:#ffff;}}' AS understood, rule || '.x{{a:#ffff;}}' AS remove_errors, rule || '.x{{}}' AS remove_invalid, rule || '}}.x{{a:#ffff;b}}' AS original
FROM (SELECT id, selector || '{{' || property || ':' || value || ';}}' AS rule FROM ({_ONE_RULE}))
""")
def css_sanitize(t):
    return _sheets(t).select("doc_id", *[css.css_render(F.concat("css", F.lit("}.x{a:#ffff;b}")), m).alias(m) for m in ("understood", "remove_errors", "remove_invalid", "original")])


@query(f"SELECT s.doc_id, s.node_no, r.property, r.value FROM ({_SELECTORS}) s JOIN ({_ONE_RULE}) r ON r.id = s.doc_id AND r.selector = s.selector")
def style_apply(t):
    return H.page_styles(t("pages"), "page_id", "html")


# ------------------------------------------------------------------ change feed

_FEED = """
WITH f AS (SELECT event_id AS seq, user_id AS id, CASE WHEN user_id % 2 = event_id % 2 THEN 'local' ELSE 'remote' END AS source,
                  CASE event_type WHEN 'error' THEN 'R' WHEN 'click' THEN 'U' ELSE 'A' END AS op, event_type AS title FROM events)
"""


def feed(t):
    e = t("events")
    source = F.when(F.col("user_id") % 2 == F.col("event_id") % 2, "local").otherwise("remote")
    op = F.when(F.col("event_type") == "error", "R").when(F.col("event_type") == "click", "U").otherwise("A")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), source.alias("source"), op.alias("op"), F.col("event_type").alias("title"))


@query(_FEED + """
, flags AS (SELECT id, source, arg_max(op, seq) = 'A' AS present, max(seq) AS last_seq FROM f WHERE op <> 'U' GROUP BY id, source),
here AS (SELECT id, bool_or(present AND source = 'local') AS is_local, bool_or(present AND source = 'remote') AS is_remote FROM flags GROUP BY id)
SELECT id, is_local, is_remote FROM here WHERE is_local OR is_remote
""")
def change_feed_state(t):
    from bindery.streaming.changefeed import replay

    return replay(feed(t), ["title"]).select("id", "is_local", "is_remote")
