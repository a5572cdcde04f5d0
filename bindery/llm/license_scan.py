"""Operator 2: license scans by diagonal voting, in DataFrame operations only.

Documents and license templates are word sequences. All rolling word pairs of the documents are
hashed and joined to the places of the templates' pairs. A hit of document word i and template word
j votes for the diagonal i - j. Diagonals a few words apart, as insertions and omissions make them,
are merged to spans, and a span is verified by the share of the template's words that stand in place.

The three base phrases must match whole, on one diagonal; the further templates give labels of their
own where at least ``coverage`` of their words match. All pairs of a template vote.

Nulls: a null text has no words. Rows of one doc_id and text are scanned alike, each with a row of
the result; a null doc_id is kept. A text without a phrase has empty labels, null places and score 0.
An empty table gives no rows. A very long text takes time in proportion to its words. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, small, table

BASE = {"mit": ["mit license"], "apache": ["apache license"], "gpl": ["general public license"]}

#: Phrases of well-known licenses, by the label that they give.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "licensed under the gnu general public license version",
    ],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "bsd": ["bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that"],
    "mpl": ["mozilla public license"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "cc": ["licensed under cc by", "creative commons attribution", "creative commons license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

WORD_ENDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Words of a text with A-Z in lower case. The Kelvin sign, whose lower case is k, becomes another letter first."""
    return F.filter(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), WORD_ENDS), lambda w: w != "")


_PHRASE_LIST = [(label, base, phrase.split()) for base, kinds in ((True, BASE), (False, TEMPLATES)) for label, phrases in kinds.items() for phrase in phrases]
#: Phrases of fewer words must stand whole on one diagonal; longer ones may change diagonals.
SHORT = 6
#: Bytes of candidate places that may be broadcast to the texts, which else are dealt out once.
PLACES_BYTES = 64 << 20


def _templates(spark: SparkSession) -> DataFrame:
    """(g, j, template, size): places of all word pairs of the templates; a few hundred rows."""
    df = spark.createDataFrame([(n, words) for n, (_, _, words) in enumerate(_PHRASE_LIST)], "template int, tw array<string>")
    df = df.select("template", F.size("tw").alias("size"), F.posexplode(F.transform(F.slice("tw", F.lit(1), F.size("tw") - 1), lambda w, i: F.struct(w.alias("a"), F.get("tw", i + 1).alias("b")))).alias("j", "pair"))
    return df.select(F.xxhash64("pair.a", "pair.b").alias("g"), "j", "template", "size")


def license_spans(docs: DataFrame, scratch: Scratch, coverage: float = 0.75, gap: int = 3) -> DataFrame:
    """(doc_id, t, template, label, base, first_word, coverage) of each verified span of ``docs``."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), words(F.col("text")).alias("w"))
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1)))
    grams = df.select("doc_id", "t", F.posexplode(pairs).alias("i", "g"))
    hits = grams.join(F.broadcast(_templates(docs.sparkSession)), "g").select("doc_id", "t", "template", "size", (F.col("i") - F.col("j")).alias("diagonal"), "j")
    voted = hits.groupBy("doc_id", "t", "template", "size", "diagonal").agg(F.countDistinct("j").alias("votes"))
    order = Window.partitionBy("doc_id", "t", "template").orderBy("diagonal")
    apart = (F.col("size") < SHORT) | (F.col("diagonal") - F.lag("diagonal").over(order) > gap)
    # a lone diagonal with few votes can't pass: words in place that cast no vote have a gap between each two
    alone = apart & (F.lead("diagonal").over(order) - F.col("diagonal") > gap)
    hopeless = F.when(F.col("size") < SHORT, F.col("votes") < F.col("size") - 1).otherwise(F.coalesce(alone, F.lit(False)) & ((F.col("votes") + F.col("size") + 1) / 2 < coverage * F.col("size")))
    spans = voted.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(order)).withColumn("hopeless", hopeless)
    spans = scratch.table(few(spans.where("not hopeless").select("doc_id", "t", "template", "size", "span", "diagonal")), "candidates")
    # all pairs of a short phrase on one diagonal are the phrase; words are compared for the longer ones
    whole = spans.where(F.col("size") < SHORT).select("doc_id", "t", "template", F.col("diagonal").alias("first_word"), F.lit(1.0).alias("coverage"))
    places = spans.where(F.col("size") >= SHORT).groupBy("doc_id", "t").agg(F.collect_list(F.struct("template", "span", "diagonal")).alias("places"))
    places = small(scratch.table(few(places), "places"), PLACES_BYTES).withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    # the text comes back once for each document, and its words stay in one row while its diagonals are compared
    phrases = F.array(*[F.array(*map(F.lit, words)) for _, _, words in _PHRASE_LIST])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    back = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", "places", words(F.col("text")).alias("w"))

    def matched(p):
        return F.filter(F.sequence(F.lit(0), F.size(F.get(phrases, p["template"])) - 1), lambda j: F.when(p["diagonal"] + j >= 0, F.get("w", F.greatest(p["diagonal"] + j, F.lit(0))) == F.get(F.get(phrases, p["template"]), j)))

    # rows of one doc_id and text hold the same places
    each = back.select("doc_id", "t", F.explode(F.transform("places", lambda p: F.struct(p["template"].alias("template"), p["span"].alias("span"), p["diagonal"].alias("diagonal"), matched(p).alias("matched")))).alias("p"))
    spans = each.select("doc_id", "t", "p.*").groupBy("doc_id", "t", "template", "span").agg(F.min("diagonal").alias("first_word"), F.array_distinct(F.flatten(F.collect_set("matched"))).alias("matched"))
    labels, bases, sizes = (F.get(F.array(*map(F.lit, x)), F.col("template")) for x in ([p[0] for p in _PHRASE_LIST], [p[1] for p in _PHRASE_LIST], [len(p[2]) for p in _PHRASE_LIST]))
    spans = spans.select("doc_id", "t", "template", "first_word", (F.size("matched") / sizes).alias("coverage")).where(F.col("coverage") >= coverage)
    return whole.unionByName(spans).select("doc_id", "t", "template", labels.alias("label"), bases.alias("base"), "first_word", "coverage")


def scan_licenses(docs: DataFrame, coverage: float = 0.75) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    scratch = Scratch(docs.sparkSession, "licenses")
    spans = scratch.table(few(license_spans(docs, scratch, coverage)), "spans")
    base = F.when(F.col("base"), F.col("first_word")).cast("long")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "t").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score")
    )
    found = small(scratch.table(found, "found")).withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return few(out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", blank("base_labels"), blank("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_PHRASES = ", ".join(f"({n}, '{label}', {str(base).lower()}, '{' '.join(words)}')" for n, (label, base, words) in enumerate(_PHRASE_LIST))

OP2_SQL = rf"""
WITH t AS (
  SELECT template, label, base, string_split(phrase, ' ') AS tw FROM (VALUES {_PHRASES}) AS v(template, label, base, phrase)
), tw AS (
  SELECT template, label, base, len(tw) AS size, unnest(tw) AS word, generate_subscripts(tw, 1) - 1 AS j FROM t
), seeds AS (
  SELECT a.template, a.j, a.word AS a, b.word AS b FROM tw a JOIN tw b ON a.template = b.template AND b.j = a.j + 1
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), w AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
), votes AS (
  SELECT DISTINCT w.doc_id, seeds.template, w.i - seeds.j AS diagonal
  FROM (SELECT doc_id, i, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM w) w JOIN seeds ON seeds.a = w.word AND seeds.b = w.following
), islands AS (
  SELECT *, sum(CASE WHEN size >= 6 AND step <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM (SELECT v.*, s.size, s.label, s.base, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS step
        FROM votes v JOIN (SELECT DISTINCT template, label, base, size FROM tw) s USING (template))
), spans AS (
  SELECT i.doc_id, i.template, i.span, any_value(i.label) AS label, any_value(i.base) AS base, min(i.diagonal) AS first_word, count(DISTINCT tw.j) / any_value(i.size) AS coverage, any_value(i.size) AS size
  FROM islands i JOIN tw ON tw.template = i.template JOIN w ON w.doc_id = i.doc_id AND w.i = i.diagonal + tw.j AND w.word = tw.word GROUP BY i.doc_id, i.template, i.span
), found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans WHERE coverage = 1 OR size >= 6 AND coverage >= 0.75 GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
