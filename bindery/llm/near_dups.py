"""Operator 8: near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has ``positions`` MinHash values of 16 bits. Pairs at the wanted similarity
differ in few positions: ``radius`` is their expected number plus ``sigmas`` standard deviations. The
signature is cut into so many chunks that, by the pigeonhole principle, two signatures within the
radius differ in at most one position of some chunk; a key for each position left out of each chunk
finds every such pair. So all pairs within the radius are guaranteed to share a key. Links are
confirmed on the full shingle sets.

Documents of equal shingle sets are one node. Pairs within a key are never all emitted: a key's
members are first compared with its smallest one, then a few more pivots with the members of other
components, and what is left in different components meets in blocks, whose tasks return links
alone. Shingles that a document has alone among these bound its similarity to any other from above,
which settles most pairs of a large group of loose copies without a look. No key, group or pair is
capped or dropped.

Nulls: a null text, or one without words, has an empty set and no links. A null doc_id is linked with
nothing and kept. Rows of one doc_id count as one document, with the links of all its texts. An empty
table gives no rows. Very long texts are hashed block by block, whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, lean, parts, small, table
from bindery.llm.components import components
from bindery.llm.tokens import ragged
from bindery.llm.words import Words, gram_counts, gram_hashes, mix, text_blocks


@dataclass(frozen=True)
class Near:
    """Five words and a similarity of 0.8 unless told otherwise."""

    words: int = 5
    percent: int = 80
    positions: int = 64
    sigmas: float = 4.0

    @property
    def radius(self) -> int:
        p = 1 - self.percent / 100
        return min(self.positions - 1, math.ceil(self.positions * p + self.sigmas * math.sqrt(self.positions * p * (1 - p))))

    def chunks(self) -> list[np.ndarray]:
        """With radius // chunks <= 1, some chunk has at most one differing position."""
        return np.array_split(np.arange(self.positions), self.radius // 2 + 1)


#: Pivots of a key that meet the other components of the key before the rest is compared in blocks, and nodes of a block.
PIVOTS, BLOCK = 8, 256

_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(0, 2**63, 1024, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat, counts): the sorted distinct shingle hashes of each text, A-Z lower-cased."""
    w = Words(data, offsets)
    h = w.hashes(lower=True)
    own = np.diff(w.first)
    counts = gram_counts(w.first, n)
    grams = gram_hashes(h, n)
    flat = grams[ragged(w.first[:-1], counts)]
    brief = np.flatnonzero((own > 0) & (own < n))
    if len(brief):  # the whole sequence is the only shingle
        whole = np.array([mix(gram_hashes(h[w.first[i] : w.first[i + 1]], int(own[i])) + np.uint64(own[i]))[0] for i in brief], np.uint64)
        flat = np.insert(flat, (np.cumsum(counts) - counts)[brief], whole)
        counts[brief] = 1
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        flat[a:b].sort()
    if not len(flat):
        return flat, counts
    new = np.empty(len(flat), bool)
    new[0], new[1:] = True, flat[1:] != flat[:-1]
    full = counts > 0
    new[(ends - counts)[full]] = True
    distinct = counts.copy()
    distinct[full] = np.add.reduceat(new.astype(np.int64), (ends - counts)[full])
    return flat[new], distinct


def _identity(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell each set from any other, as two halves."""
    full = np.flatnonzero(counts)
    out = np.zeros((2, len(counts)), np.uint64)
    if len(full):
        for k in (0, 1):
            out[k, full] = np.add.reduceat(mix(flat ^ _XOR[-1 - k]), (np.cumsum(counts) - counts)[full])
    return out[0], out[1]


def signatures(docs: DataFrame, how: Near) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, signature); (hi, lo) identifies the set, all null without shingles."""

    @lean
    def sign(batches):
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                flat, counts = shingle_sets(data, offsets, how.words)
                full = np.flatnonzero(counts)
                at = (np.cumsum(counts) - counts)[full]
                hi, lo = _identity(flat, counts)
                values = np.zeros((j - i, how.positions), np.uint16)
                if len(full):
                    for k in range(how.positions):
                        values[full, k] = mix(np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], at)).astype(np.uint16)
                absent = counts == 0
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(counts),
                        pa.array(hi.astype(np.int64), mask=absent),
                        pa.array(lo.astype(np.int64), mask=absent),
                        pa.array([None if a else v.tobytes() for a, v in zip(absent, values)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "hi", "lo", "signature"],
                )

    return _texts(docs).mapInArrow(sign, "doc_id long, n_shingles long, hi long, lo long, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def chunk_keys(nodes: DataFrame, how: Near) -> DataFrame:
    """(key, node, size): each chunk of each signature with each of its positions left out."""

    @lean
    def keys(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, how.positions).astype(np.uint64)
            out = []
            for c, positions in enumerate(how.chunks()):
                for left_out in range(len(positions)):
                    h = np.full(len(values), c * 1024 + left_out + 1, np.uint64)
                    for p in np.delete(positions, left_out):
                        h = mix(h * np.uint64(_ODD[7]) + values[:, p])
                    out.append(h.astype(np.int64))
            n = len(out)
            node, size = (batch.column(c).to_numpy() for c in ("node", "size"))
            yield pa.record_batch([pa.array(np.concatenate(out)), pa.array(np.tile(node, n)), pa.array(np.tile(size, n))], names=["key", "node", "size"])

    return nodes.select("node", "size", "signature").mapInArrow(keys, "key long, node long, size int")


def _sets(docs: DataFrame, wanted: DataFrame, how: Near, name: str = "shingles") -> DataFrame:
    """(node, shingles) of ``wanted`` (node, d, hi, lo), a written table; a set is read from a row of doc_id d that has it."""

    @lean
    def sets(batches):
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                flat, counts = shingle_sets(data, offsets, how.words)
                hi, lo = _identity(flat, counts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(hi.astype(np.int64)), pa.array(lo.astype(np.int64)), lists], names=["d", "hi", "lo", "shingles"])

    texts = _texts(docs).join(small(wanted.select(F.col("d").alias("doc_id")).distinct()), "doc_id", "left_semi")
    each = texts.mapInArrow(sets, "d long, hi long, lo long, shingles array<long>")
    return each.join(small(wanted), ["d", "hi", "lo"]).select("node", "shingles")


def _own(docs: DataFrame, wanted: DataFrame, how: Near) -> DataFrame:
    """(node, own): how many shingles each of these sets has that none of the others has."""
    each = _sets(docs, wanted, how).select("node", F.explode("shingles").alias("h"))
    return each.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").cast("int").alias("own"))


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: Near, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) whose signatures are within the radius and whose full sets are similar enough."""

    @lean
    def near(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, how.positions) for c in ("su", "sv"))
                yield batch.select(["u", "v"]).filter(pa.array((a != b).sum(axis=1) <= how.radius))

    signed = nodes.select("node", "signature")
    close = pairs.join(signed.withColumnsRenamed({"node": "u", "signature": "su"}), "u").join(signed.withColumnsRenamed({"node": "v", "signature": "sv"}), "v")
    close = scratch.table(few(close.select("u", "v", "su", "sv").mapInArrow(near, "u long, v long")), f"{name}-close")
    wanted = _places(close.select(F.col("u").alias("node")).union(close.select("v")), nodes, scratch, f"{name}-wanted")
    full = scratch.table(few(_sets(docs, wanted, how).dropDuplicates(["node"])), f"{name}-sets")

    @lean
    def confirm(batches):
        for batch in batches:
            hit = []
            for a, b in zip(_lists(batch.column("a")), _lists(batch.column("b"))):
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                hit.append(100 * shared >= how.percent * (len(both) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    both = close.join(full.withColumnsRenamed({"node": "u", "shingles": "a"}), "u").join(full.withColumnsRenamed({"node": "v", "shingles": "b"}), "v")
    links = scratch.table(few(both.select("u", "v", "a", "b").mapInArrow(confirm, "u long, v long")), f"{name}-links")
    return links


def _places(wanted: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, d, hi, lo) of the nodes in ``wanted`` (node)."""
    return scratch.table(few(nodes.select("node", "d", "hi", "lo").join(wanted.distinct(), "node", "left_semi")), name)


def _like(a: str, b: str, how: Near, own_a: str = "0", own_b: str = "0"):
    """Sets whose sizes, less what each has alone, differ more than this can't be similar enough."""
    return F.expr(f"100L * least({a} - {own_a}, {b} - {own_b}) >= {how.percent}L * greatest({a} + {own_b}, {b} + {own_a})")


def _unsettled(members: DataFrame, joined: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``members`` (key, node, ...) of the keys that hold several components, with their components."""
    now = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    return scratch.table(few(now.join(mixed, "key")), name)


def _blocks(members: DataFrame, nodes: DataFrame, docs: DataFrame, how: Near, scratch: Scratch) -> DataFrame:
    """The links (u, v) between components among ``members`` (key, node, size, own, component), a written table.

    Nodes that keys connect, in one step or several, are dealt to blocks; each two blocks meet in one task, which
    compares bounds, signatures and full sets there and returns links alone. So a family of m loose copies that are
    no near duplicates costs m * m / BLOCK rows rather than a row a pair.
    """
    edges = members.groupBy("key").agg(F.min("node").alias("v")).join(members.select("key", F.col("node").alias("u")), "key").select("u", "v").distinct()
    families = scratch.table(few(components(edges, scratch, "families")), "families").select("node", F.col("component").alias("family"))
    one = members.groupBy("node").agg(F.first("size").alias("size"), F.first("own").alias("own"), F.first("component").alias("component"))
    wanted = _places(families.select("node"), nodes, scratch, "blocks-wanted")
    sets = _sets(docs, wanted, how).dropDuplicates(["node"])
    counts = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    full = one.join(families, "node").join(small(scratch.table(few(counts), "blocks-counts")), "family").join(nodes.select("node", "signature"), "node").join(sets, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    full = full.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = full.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, size, own, component, block = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "size", "own", "component", "block"))
        left, right = (np.flatnonzero(block == t.column(c)[0].as_py()) for c in ("i", "j"))
        signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, how.positions)
        sets = _lists(t.column("shingles"))
        out: list[tuple[int, int]] = []
        for x in left:
            y = right[(component[right] != component[x]) & (node[right] > node[x] if left[0] == right[0] else True)]
            shared = np.minimum(size[y] - own[y], size[x] - own[x])
            y = y[100 * shared >= how.percent * np.maximum(size[y] + own[x], size[x] + own[y])]
            y = y[(signature[y] != signature[x]).sum(axis=1) <= how.radius]
            for k in y:
                both = np.concatenate([sets[x], sets[k]])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                if 100 * n >= how.percent * (len(both) - n):
                    out.append((node[x], node[k]))
        return pa.table([pa.array([min(r) for r in out], pa.int64()), pa.array([max(r) for r in out], pa.int64())], names=["u", "v"])

    columns = ["family", "i", "j", "block", "node", "size", "own", "component", "signature", "shingles"]
    found = dealt.select(*columns).groupBy("family", "i", "j").applyInArrow(compare, "u long, v long")
    return scratch.table(few(found), "blocks-links")


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.table(few(signatures(docs, how)), "signatures")
    sets = signed.where("hi is not null and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("d"), F.first("n_shingles").cast("int").alias("size"), F.first("signature").alias("signature"))
    # a set is named by its smallest doc_id; where rows of one doc_id have several texts, the further sets by a negative hash
    further = F.row_number().over(Window.partitionBy("d").orderBy("hi", "lo")) > 1
    named = F.when(further, F.bitwise_not(F.xxhash64("hi", "lo").bitwiseAND(F.lit(2**62 - 1)))).otherwise(F.col("d"))
    nodes = scratch.table(few(sets.withColumn("node", named)), "nodes")
    # and all sets of a doc_id belong together
    several = signed.where("hi is not null and doc_id is not null").select("doc_id", "hi", "lo").distinct().withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n > 1")
    several = several.join(nodes.select("node", "hi", "lo"), ["hi", "lo"])
    several = scratch.table(few(several.groupBy("doc_id").agg(F.min("node").alias("u")).join(several.select("doc_id", F.col("node").alias("v")), "doc_id").where("u <> v").select("u", "v")), "several")
    keyed = chunk_keys(nodes.repartition(parts(docs.sparkSession)), how)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("p")).where("n > 1").select("key", "n", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"))
    members = scratch.table(few(keyed.join(shared, "key")), "members")

    pairs = members.where(F.col("node") != F.col("pivot")).where(_like("size", "pivot_size", how)).select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    links = _linked(pairs, nodes, docs, how, scratch, "round1").unionByName(several)
    joined = scratch.table(few(components(links, scratch, "round1")), "components1")
    # a few pivots of each key, alike in all keys, meet the other components: most of what belongs together merges
    unsettled = _unsettled(members.select("key", "node", "size"), joined, scratch, "open1")
    own = scratch.table(few(_own(docs, _places(unsettled.select("node"), nodes, scratch, "open"), how)), "own")
    now = unsettled.join(own, "node", "left").fillna(0, ["own"])
    order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    ranked = scratch.table(few(now.withColumn("rank", F.row_number().over(order))), "ranked")
    p = ranked.where(F.col("rank") <= PIVOTS).select("key", F.col("node").alias("x"), F.col("size").alias("xs"), F.col("own").alias("xo"), F.col("component").alias("xc"), F.col("rank").alias("xr"))
    pairs = ranked.join(p, "key").where("component <> xc and rank > xr").where(_like("size", "xs", how, "own", "xo")).select(F.least("node", "x").alias("u"), F.greatest("node", "x").alias("v")).distinct()
    links = links.unionByName(_linked(pairs, nodes, docs, how, scratch, "round2"))
    joined = scratch.table(few(components(links, scratch, "round2")), "components2")
    # the rest in blocks
    links = links.unionByName(_blocks(_unsettled(ranked.select("key", "node", "size", "own"), joined, scratch, "open2"), nodes, docs, how, scratch))
    joined = scratch.table(few(components(links, scratch, "round3")), "components3")
    of_set = scratch.table(few(nodes.join(joined, "node", "left").select("hi", "lo", "d", F.coalesce("component", "node").alias("component"))), "sets")
    of_set = of_set.join(of_set.groupBy("component").agg(F.min("d").alias("component_id")), "component").drop("d", "component")
    out = signed.select("doc_id", "n_shingles", "hi", "lo").join(of_set, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT u, u AS v FROM (SELECT DISTINCT u FROM links)
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), c AS (
  SELECT u, min(v) AS component FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.u
"""
