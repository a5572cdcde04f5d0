"""Operator 7: quality rules by document and by host, in DataFrame operations only.

Each document is measured against rules. Failures are summed by host; a host's failure rate is shrunk
towards the rate of all with a beta prior fitted to the hosts (method of moments), so that a host of
few documents isn't judged by chance; documents of hosts whose shrunk rate exceeds ``max_rate`` are
dropped, as are documents that fail the base rules themselves.

Words are runs of characters other than space and \\x09-\\x0D. Measures: n_words; word_chars (code
points in words); n_symbols (characters of #*$%&|<>); n_dup_lines (lines with a word that equal an
earlier line); n_repeat_words (words in three-word windows found twice or more in the text).
Base rules: at least 50 words; at most half of them in repeated windows. Further rules, for the
host's rate only: mean word length from 2 to 15; at most one symbol to five words; at most half of the
lines repeated.

Nulls: a null text has no words, so it fails; a null host is a host of its own. Equal rows count each.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, small, table

SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the measures of each row's text."""
    df = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_w", F.filter(F.split("_text", SPACE), lambda x: x != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_w")
    grams = F.transform(F.slice("_w", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_g"),
    )
    # places of windows found twice or more, by sorting (hash, place); most texts have none
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    near = lambda k, x: F.coalesce(F.get("_p", k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_p", lambda x, k: near(k - 1, x) | near(k + 1, x)), lambda x: x["i"]))
    df = df.withColumn("_d", F.when(F.col("_p").isNotNull(), places))
    steps = F.transform("_d", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("_d", k + 1) - v, F.lit(3))))
    covered = F.when(F.col("_d").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_g", "_p", "_d")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def any_failed():
    n = F.col("n_words")
    more = (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n) | (5 * F.col("n_symbols") > n) | (2 * F.col("n_dup_lines") > F.col("n_lines"))
    return base_failed() | more


def host_verdicts(measured: DataFrame, host: str = "host", max_rate: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, rejected) from ``measured``, a written table."""
    hosts = measured.groupBy(host).agg(F.count("*").alias("n"), F.sum(any_failed().cast("long")).alias("failed"))
    x = hosts.agg(F.count("*"), F.sum("n"), F.sum("failed"), F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n"), F.lit(2)))).first()
    alpha = beta = 0.0
    if x[0]:
        mean = x[2] / x[1]
        between = max(x[3] / x[1] - mean * mean, 0.0)
        spread = mean * (1 - mean)
        # hosts that differ no more than they must have a narrow prior, bounded to keep it finite
        weight = min(max(spread / between - 1, 1.0), 1000.0) if between > 0 else 1000.0
        alpha, beta = mean * weight, (1 - mean) * weight
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def host_quality(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """(doc_id, measures, base_failed, kept) of each row."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = docs.select(F.col("doc_id").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    measured = scratch.table(few(measures(measured, ["doc_id", "host"])), "measures")
    bad = scratch.table(host_verdicts(measured, "host", max_rate).where("rejected").select(F.col("host").alias("_host"), "rejected"), "hosts")
    out = measured.join(small(bad), F.col("host").eqNullSafe(F.col("_host")), "left").withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rejected").isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1
), s AS (
  SELECT rid, sum(step) AS covered FROM (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS step FROM r) GROUP BY rid
), m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(s.covered, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN s USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS any_failed FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS k FROM f GROUP BY source
), t AS (
  SELECT sum(k) / sum(n) AS mean, greatest(sum(n * (k / n) ** 2) / sum(n) - (sum(k) / sum(n)) ** 2, 0) AS v FROM h
), p AS (
  SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1), 1000) ELSE 1000 END AS weight FROM t
), bad AS (
  SELECT source FROM h, p WHERE (k + mean * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
