"""Operator 3: language identification, family first, then one-versus-one within the family.

Texts become hashed counts of byte trigrams of letters (A-Z in lower case, other ASCII as spaces),
square-rooted and scaled to length 1. Linear support vector machines (squared hinge loss, dual
coordinate descent) choose the language family, one against the rest, and then between each two
languages of the family, which vote; ties go to the larger sum of margins, then to the name.

Fitting uses at most ``PER_LANGUAGE`` labelled rows of each language, those with the least hash of
id and text, so that what the driver holds is bounded however large the corpus is. Predictions cover
whole texts of all rows, very long ones too.

Nulls: a text that is null or has no letter is ``und`` with score 0; rows with a null lang, text or
doc_id aren't fitted. Equal rows are predicted alike, and fitted once. With a single language in the fitted rows all
texts are of it; with none, or an empty table, all are ``und``. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, lean, small, table
from bindery.llm.words import text_blocks

#: Language families; a language of none of them is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}

PER_LANGUAGE, DIMENSIONS = 400, 8192
#: Texts whose features are held at a time.
ROWS = 128
#: Letters, and some numerals that aren't.
LETTER = re.compile(r"[^\W\d_]")

_TABLE = np.full(256, 32, np.uint8)
_TABLE[128:] = np.arange(128, 256)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``DIMENSIONS`` values for each text."""
    b = _TABLE[data].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    if len(b) < 3:
        return out
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)
    blank = b[1:-1] == 32  # a trigram around a space tells more of word order than of spelling
    h[blank] = 0
    for i in range(len(out)):
        own = h[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        if len(own):
            out[i] = np.sqrt(np.bincount(own, minlength=DIMENSIONS))
            out[i, 0] = 0
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1e-9)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, passes: int = 30) -> np.ndarray:
    """Weights, the last of which is the bias, for y of +1 and -1; rows have (places, values) of what isn't 0."""
    w = np.zeros(DIMENSIONS + 1)
    alpha = np.zeros(len(rows))
    diagonal = np.array([(v * v).sum() + 1 for _, v in rows]) + 1 / (2 * cost)
    rng = np.random.default_rng(3)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (v @ w[at] + w[-1]) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - g / diagonal[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # a column per family
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each row; the score is the product of both steps' margins, squashed to 0..1."""
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if len(self.families) > 1:
            margins = x1 @ self.family_weights
            best = margins.argmax(axis=1)
            score = _squash(margins[np.arange(len(x)), best])
        else:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        langs = np.empty(len(x), object)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            names = self.members[family]
            if len(names) == 1 or not len(rows):
                langs[rows] = names[0]
                continue
            m = x1[rows] @ self.pair_weights[family]
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for c, (a, b) in enumerate(self.pairs[family]):
                votes[:, a] += m[:, c] >= 0
                votes[:, b] += m[:, c] < 0
                sums[:, a] += m[:, c]
                sums[:, b] -= m[:, c]
            order = np.lexsort((np.tile(-np.arange(len(names)), (len(rows), 1)), sums, votes), axis=1)[:, -1]
            langs[rows] = np.array(names, object)[order]
            score[rows] *= _squash(sums[np.arange(len(rows)), order] / (len(names) - 1))
        return langs.tolist(), score


def _squash(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from ``labelled`` (doc_id, text, lang), all of which may be used; null if there is none."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").withColumn("t", F.xxhash64("text"))
    # a hash lets about four times as many through as are wanted, of which those with the least hash stay
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "t")).alias("n")).withColumnRenamed("lang", "_lang")
    counts = small(Scratch(labelled.sparkSession, "language").table(few(counts), "counts"))
    part = F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keys = rows.select("doc_id", "lang", "t").join(counts, F.col("lang") == F.col("_lang")).where(part * F.col("n") <= 4 * per_language + 100).select("doc_id", "lang", "t").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 40)), "doc_id", "t")
    keys = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).drop("r")

    @lean
    def count(batches):
        for batch in batches:
            langs = batch.column("lang")
            for i, j, data, offsets in text_blocks(batch.column("text"), rows=ROWS):
                x = features(data, offsets)
                at = [np.flatnonzero(r) for r in x]
                yield pa.record_batch([langs.slice(i, j - i), pa.array([a.astype(np.int16).tobytes() for a in at]), pa.array([r[a].astype(np.float16).tobytes() for r, a in zip(x, at)])], names=["lang", "at", "x"])

    # at most per_language rows a language, so the keys may be broadcast; equal rows count once
    some = rows.join(F.broadcast(keys), ["doc_id", "lang", "t"]).groupBy("doc_id", "lang", "t").agg(F.first("text").alias("text")).mapInArrow(count, "lang string, at binary, x binary").toArrow()
    if not some.num_rows:
        return None
    langs = np.array(some.column("lang").to_pylist(), object)
    x = [(np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(v, np.float16).astype(np.float64)) for a, v in zip(some.column("at").to_pylist(), some.column("x").to_pylist())]
    by_row = sorted(range(len(x)), key=lambda i: (langs[i], x[i][0].tolist(), x[i][1].tolist()))
    langs, x = langs[by_row], [x[i] for i in by_row]
    family = np.array([family_of(v) for v in langs], object)
    families = sorted(set(family))
    members = {f: sorted(set(langs[family == f])) for f in families}
    family_weights = np.stack([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in families], axis=1) if len(families) > 1 else np.zeros((DIMENSIONS + 1, 1))
    pairs = {f: [(a, b) for a in range(len(m)) for b in range(a + 1, len(m))] for f, m in members.items()}
    pair_weights = {}
    for f, m in members.items():
        if pairs[f]:
            own = [np.flatnonzero(np.isin(langs, [m[a], m[b]])) for a, b in pairs[f]]
            pair_weights[f] = np.stack([fit_svm([x[i] for i in o], np.where(langs[o] == m[a], 1.0, -1.0)) for o, (a, _) in zip(own, pairs[f])], axis=1)
    return Model(families, family_weights, members, pairs, pair_weights)


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score, from text alone."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]  # which give way to the results
    names = [*keep, *(["text"] if "text" not in keep else [])]

    @lean
    def predict(batches):
        for batch in batches:
            text = batch.column("text")
            for i, j, data, offsets in text_blocks(text, rows=ROWS):
                langs, scores = model.predict(features(data, offsets)) if model else (["und"] * (j - i), np.zeros(j - i))
                for k, value in enumerate(text.slice(i, j - i).to_pylist()):
                    if not value or not any(m.group().isalpha() for m in LETTER.finditer(value)):
                        langs[k], scores[k] = "und", 0.0
                scores = np.where([v == "und" for v in langs], 0.0, scores)
                yield pa.record_batch([batch.column(c).slice(i, j - i) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema.fields)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(predict, f"{fields}, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
    return few(out.select("doc_id", "held_out", "lang_pred", "score"))
