"""Operator 9: removal of repeated passages with sharded Aho-Corasick automata.

A window is ``window`` consecutive words. Each word covered by a window whose word sequence also
starts earlier (smaller doc_id, or same document and earlier start) is removed.

1. Anchors: of the phrases in each window, those with the least hash. Equal windows have equal
   anchors, so only windows with an anchor that recurs in the corpus can recur.
2. Confirmation: hashes of just these windows are counted; those seen twice or more recur, each with
   its first place. Runs of first places in a document are the recurring passages.
3. Automata: the windows of an anchor belong to one shard, by the anchor's hash. A shard's automaton
   (pyahocorasick, over word numbers) holds the first words of its anchors' phrases, one of which every
   window contains, and beside it the shard's passages give its windows and their first places.
4. Streaming: each document sends each shard the runs of windows around the shard's anchors (no others
   can recur), so a window goes to one shard however many there are. Where the automaton finds a
   phrase, the windows that hold it are confirmed, and count unless they are at the first place.

Documents stream past an automaton one by one, so a task holds one shard and one batch; a shard that
many documents share is dealt out again by salt. Word and window hashes have 64 bits.

Nulls: a null text has no words. A null doc_id comes before all others. Rows of equal doc_id hold the
same places, so a copy under the same doc_id isn't an earlier one. An empty table gives no rows.
Texts of fewer words than a window stay whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, lean, small, table
from bindery.llm.tokens import ragged
from bindery.llm.words import Words, gram_counts, gram_hashes, text_blocks

#: Windows of passages in a shard, and anchors of the documents that stream past one copy of its automaton, about.
SHARD_WINDOWS, STREAM_ANCHORS = 200_000, 400_000
#: Words of an anchor's phrase that the automaton looks for.
PATTERN_WORDS = 4
_FIRST = -(2**63)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive values."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = f(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def window_anchors(w: Words, hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, anchor hash of each)."""
    starts = ragged(w.first[:-1], gram_counts(w.first, window))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    return starts, _sliding(gram_hashes(hashes, phrase), window - phrase + 1, np.minimum)[starts]


def _rows(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(carry)], F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))


def _anchors(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(h, d, t, n): anchors of each document, and in how many places."""

    @lean
    def find(batches):
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                w = Words(data, offsets)
                hashes = w.hashes()
                starts, anchor = window_anchors(w, hashes, window, phrase)
                if not len(starts):
                    continue
                # a phrase is an anchor if the largest of the minima over the windows that hold it is its hash
                grams = gram_hashes(hashes, phrase)
                span = window - phrase + 1
                minima = np.zeros(len(grams) + span - 1, np.uint64)
                minima[starts + span - 1] = anchor
                chosen = np.flatnonzero(_sliding(minima, span, np.maximum)[: len(grams)] == grams)
                doc = np.searchsorted(w.first, chosen, "right") - 1
                value = grams[chosen]
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(doc)))
                own = pa.array(doc[at] + i)
                yield pa.record_batch(
                    [pa.array(value[at].astype(np.int64)), batch.column("d").take(own), batch.column("t").take(own), pa.array(n.astype(np.int32))],
                    names=["h", "d", "t", "n"],
                )

    return rows.mapInArrow(find, "h long, d long, t long, n int")


def _candidate_windows(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(w, d, t, p): hash and start of each window whose anchor is in the row's list hs."""

    @lean
    def find(batches):
        for batch in batches:
            lists = batch.column("hs")
            for i, j, data, offsets in text_blocks(batch.column("text")):
                w = Words(data, offsets)
                hashes = w.hashes()
                starts, anchor = window_anchors(w, hashes, window, phrase)
                if not len(starts):
                    continue
                counts = gram_counts(w.first, window)
                hit, at = np.zeros(len(starts), bool), 0
                for k, n in enumerate(counts):
                    hit[at : at + n] = np.isin(anchor[at : at + n], lists[i + k].values.to_numpy().view(np.uint64))
                    at += n
                starts = starts[hit]
                doc = np.searchsorted(w.first, starts, "right") - 1
                own = pa.array(doc + i)
                yield pa.record_batch(
                    [pa.array(gram_hashes(hashes, window)[starts].astype(np.int64)), batch.column("d").take(own), batch.column("t").take(own), pa.array((starts - w.first[doc]).astype(np.int32))],
                    names=["w", "d", "t", "p"],
                )

    return rows.mapInArrow(find, "w long, d long, t long, p int")


def _runs(rows: DataFrame, window: int, phrase: int, shards: int, first: bool) -> DataFrame:
    """(shard, d, t, start, text): each run of windows with one anchor, by the shard of the anchor.

    The windows are those that start in the row's places a to b (``first``), or have an anchor of its list hs.
    """
    columns = ["a", "b"] if first else ["hs"]

    @lean
    def find(batches):
        for batch in batches:
            lists = [batch.column(c) for c in columns]
            for i, j, data, offsets in text_blocks(batch.column("text")):
                w = Words(data, offsets)
                starts, anchor = window_anchors(w, w.hashes(), window, phrase)
                at = np.concatenate([[0], np.cumsum(gram_counts(w.first, window))])
                hit = np.zeros(len(starts), bool)
                for k in range(j - i):
                    if first:
                        for x, y in zip(lists[0][i + k].values.to_numpy(), lists[1][i + k].values.to_numpy()):
                            hit[at[k] + x : at[k] + y + 1] = True
                    else:
                        hit[at[k] : at[k + 1]] = np.isin(anchor[at[k] : at[k + 1]], lists[0][i + k].values.to_numpy().view(np.uint64))
                starts, anchor = starts[hit], anchor[hit]
                if not len(starts):
                    continue
                new = np.ones(len(starts), bool)
                new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])
                new |= np.isin(starts, w.first[:-1])
                x = np.flatnonzero(new)
                y = np.append(x[1:], len(starts)) - 1
                doc = np.searchsorted(w.first, starts[x], "right") - 1
                own = pa.array(doc + i)
                begin, end = w.starts[starts[x]].tolist(), w.ends[starts[y] + window - 1].tolist()
                whole = data.tobytes()
                yield pa.record_batch(
                    [
                        pa.array((anchor[x] % np.uint64(shards)).astype(np.int64)),
                        batch.column("d").take(own),
                        batch.column("t").take(own),
                        pa.array((starts[x] - w.first[doc]).astype(np.int32)),
                        pa.array([whole[m:n] for m, n in zip(begin, end)], pa.binary()).cast(pa.string()),
                    ],
                    names=["shard", "d", "t", "start", "text"],
                )

    return rows.select("d", "t", "text", *columns).mapInArrow(find, "shard long, d long, t long, start int, text string")


class _Shard:
    """The automaton of a shard's anchors, and its windows with their first places."""

    def __init__(self, passages: list[tuple[int, int, str]], window: int, phrase: int):
        import ahocorasick

        data = np.frombuffer("\n".join(x[2] for x in passages).encode(), np.uint8)
        sizes = np.array([len(x[2].encode()) + 1 for x in passages])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        offsets[-1] -= 1
        w = Words(data, offsets)
        hashes = w.hashes()
        self.words, numbers = np.unique(hashes, return_inverse=True)
        self.width = max(1, -(-int(len(self.words)).bit_length() // 5))
        text = self._text(numbers.astype(np.int64) + 1)
        own = gram_counts(w.first, window)
        starts, anchor = window_anchors(w, hashes, window, phrase)
        self.windows = gram_hashes(hashes, window)[starts]
        order = np.argsort(self.windows, kind="stable")
        self.windows = self.windows[order]
        self.d = np.repeat(np.array([x[0] for x in passages], np.int64), own)[order]
        self.p = (np.repeat(np.array([x[1] for x in passages], np.int64), own) + starts - np.repeat(w.first[:-1], own))[order]
        self.window, self.size = window, min(phrase, PATTERN_WORDS)
        # the place of its anchor in the last window of each passage, which all its windows hold
        last = np.cumsum(own) - 1
        grams = gram_hashes(hashes, phrase)
        near = starts[last - own + 1][:, None] + np.arange(window - phrase + 1)
        same = grams[near] == anchor[last][:, None]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for k in (near[same] * self.width).tolist():
            self.automaton.add_word(text[k : k + self.size * self.width])
        self.automaton.make_automaton()

    def _text(self, numbers: np.ndarray) -> str:
        """Words as characters: the digits of their numbers to the base 32, each place with digits of its own.

        Nodes of the automaton so have few children, which it searches one by one, and matches end with words.
        """
        out = np.empty((len(numbers), self.width), np.uint32)
        for j in range(self.width):
            out[:, j] = np.where(numbers > 0, 64 + 32 * j + (numbers >> 5 * j & 31), 32)
        return out.tobytes().decode("utf-32-le")

    def repeats(self, hashes: np.ndarray, first: np.ndarray, ds: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, start in its document) of the windows that a passage holds at another, first place.

        Text k has the words first[k] to first[k + 1] of ``hashes`` and is word base[k] on of document ds[k].
        """
        starts = ragged(first[:-1], gram_counts(first, self.window))
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        numbers = np.where(self.words[k] == hashes, k + 1, 0)
        last = np.fromiter((e for e, _ in self.automaton.iter(self._text(numbers))), np.int64) // self.width
        # windows that hold a phrase ending at word e start from e - window + 1 to e - size + 1
        near = np.zeros(len(hashes) + 2, np.int64)
        np.add.at(near, np.maximum(last - self.window + 1, 0), 1)
        np.add.at(near, np.maximum(last - self.size + 2, 0), -1)
        starts = starts[np.cumsum(near)[starts] > 0]
        found = gram_hashes(hashes, self.window)[starts]
        k = np.minimum(np.searchsorted(self.windows, found), len(self.windows) - 1)
        same = self.windows[k] == found
        k, starts = k[same], starts[same]
        text = np.searchsorted(first, starts, "right") - 1
        place = starts - first[text] + base[text]
        later = (self.d[k] != ds[text]) | (self.p[k] != place)
        return text[later], place[later]


def _stream(dealt: DataFrame, window: int, phrase: int) -> DataFrame:
    """(d, t, runs): dealt has, for each group, its passages (kind 0) before its documents (kind 1)."""

    @lean
    def find(batches):
        group, held, shard = None, [], None
        for batch in batches:
            shards, salts, kinds, ds, ts, starts = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind", "d", "t", "start"))
            for i, j, data, offsets in text_blocks(batch.column("text")):
                edge = np.flatnonzero((np.diff(shards[i:j]) != 0) | (np.diff(salts[i:j]) != 0) | (np.diff(kinds[i:j]) != 0)) + 1
                for x, y in zip(np.append(0, edge).tolist(), np.append(edge, j - i).tolist()):
                    if group != (shards[i + x], salts[i + x]):
                        group, held, shard = (shards[i + x], salts[i + x]), [], None
                    if kinds[i + x] == 0:
                        own = data.tobytes()
                        held += [(int(ds[i + k]), int(starts[i + k]), own[offsets[k] : offsets[k + 1]].decode()) for k in range(x, y)]
                        continue
                    if shard is None:
                        if not held:
                            continue
                        shard, held = _Shard(held, window, phrase), []
                    w = Words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    text, place = shard.repeats(w.hashes(), w.first, ds[i + x : i + y], starts[i + x : i + y])
                    if len(text):
                        # runs of covered words, [first, end)
                        cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(place) > window))
                        a, b = np.append(0, cut + 1), np.append(cut, len(text) - 1)
                        runs = np.stack([place[a], place[b] + window], axis=1).astype(np.int32)
                        own = text[a] + i + x
                        yield pa.record_batch([pa.array(ds[own]), pa.array(ts[own]), pa.array([r.tobytes() for r in runs], pa.binary())], names=["d", "t", "runs"])

    return dealt.mapInArrow(find, "d long, t long, runs binary")


def repeated_windows(docs: DataFrame, window: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """(d, t, runs): words of each document in windows that also start earlier, as packed 32-bit [first, end)."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    phrase = max(1, window // 2)
    rows = _rows(docs)
    anchors = scratch.table(_anchors(rows, window, phrase), "anchors")
    recurring = scratch.table(few(anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")), "recurring")
    scratch.release()
    own = anchors.join(recurring, "h").groupBy("d", "t").agg(F.collect_set("h").alias("hs"))
    candidates = scratch.table(few(own), "candidates")
    scratch.drop("anchors")
    scratch.release()
    # the texts that hold a recurring anchor are dealt out once, and read three times
    texts = scratch.table(rows.join(candidates, ["d", "t"]), "texts")
    scratch.release()
    windows = _candidate_windows(texts, window, phrase)
    places = windows.groupBy("w").agg(F.min(F.struct("d", "p", "t")).alias("f"), F.count("*").alias("n")).where("n > 1").select("f.*")
    places = places.groupBy("d", "t").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    begin = F.filter("ps", lambda x, i: F.coalesce(F.get("ps", i - 1) < x - 1, F.lit(True)))
    end = F.filter("ps", lambda x, i: F.coalesce(F.get("ps", i + 1) > x + 1, F.lit(True)))
    places = scratch.table(few(places.select("d", "t", F.size("ps").alias("n"), begin.alias("a"), end.alias("b"))), "places")
    scratch.release()
    shards = max(1, -(-(places.agg(F.sum("n")).first()[0] or 0) // SHARD_WINDOWS))
    passages = _runs(texts.drop("hs").join(small(places), ["d", "t"]), window, phrase, shards, True)
    segments = _runs(texts, window, phrase, shards, False)
    # how often to deal a shard out again, by the anchors of its documents
    loads = candidates.select(F.explode("hs").alias("h")).groupBy("h").count()
    modulus = F.lit(shards).cast("decimal(20,0)")
    unsigned = F.col("h").cast("decimal(20,0)") + F.when(F.col("h") < 0, F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    loads = loads.groupBy((unsigned % modulus).cast("long").alias("shard")).agg(F.ceil(F.sum("count") / STREAM_ANCHORS).cast("int").alias("salts"))
    loads = small(scratch.table(few(loads), "loads"))
    patterns = passages.join(loads, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "d", "t", "start", "text"
    )
    salted = segments.join(loads, "shard").select("shard", F.pmod(F.xxhash64("d", "t", "start"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "d", "t", "start", "text")
    dealt = patterns.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = scratch.table(few(_stream(dealt, window, phrase)), "found")
    scratch.release()
    return found.groupBy("d", "t").agg(F.collect_list("runs").alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 20, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text][, carry]) of each row; text keeps the white space after kept words.

    ``carry`` names further columns of ``docs`` to pass on.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = small(scratch.table(few(repeated_windows(docs, window, scratch)), "spans"))
    held = [f"_carried{i}" for i in range(len(carry))]
    joined = _rows(docs, carry).join(spans, ["d", "t"], "left")

    @lean
    def clean(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                data = (text or "").encode()
                own = data.split()
                n = len(own)
                if not runs:
                    out.append((n, 0, hashlib.sha256(b" ".join(own)).hexdigest(), text))
                    continue
                at = np.frombuffer(b"".join(runs), np.int32)
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, at[::2], 1)
                np.add.at(steps, at[1::2], -1)
                keep = np.cumsum(steps)[:-1] == 0
                kept = [own[k] for k in np.flatnonzero(keep)]
                if keep_text:
                    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    nexts = np.append(w.starts[1:], len(data))
                    text = (data[: w.starts[0]] + b"".join(data[w.starts[k] : nexts[k]] for k in np.flatnonzero(keep))).decode()
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), text))
            columns = [batch.column("d"), *(pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string())))] if out else []
            if out:
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 5 if keep_text else 4]
                yield pa.record_batch([*columns[: len(names)], *(batch.column(c) for c in held)], names=[*names, *held])

    cleaned = joined.select("d", "text", "runs", *held).mapInArrow(
        clean, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text + "".join(f", {h} {docs.schema[c].dataType.simpleString()}" for h, c in zip(held, carry))
    )
    cleaned = cleaned if keep_text else few(cleaned)
    names = ["n_words", "n_removed", "kept_sha256", "text"][: 4 if keep_text else 3]
    return cleaned.select(F.when(F.col("doc_id") != _FIRST, F.col("doc_id")).alias("doc_id"), *names, *[F.col(h).alias(c) for h, c in zip(held, carry)])


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) AS r(k)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
