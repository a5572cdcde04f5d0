"""Operator 4: nearest neighbours by largest inner product, on a navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD`` distinct vectors by hash. A shard's index is one row
of flat arrays: the vectors, each node's top level, and for each level the neighbours of its nodes as
one array of fixed width. The largest inner product is made a distance by one more component, which
gives all vectors of a shard the same length. Neighbours are chosen from exact candidate lists within
the shard, by the usual rule that keeps a candidate closer to the node than to any neighbour kept
before, and links go both ways. A search descends greedily from the top level and widens to ``ef``
nodes on the lowest; blocks of queries search each shard in step, and the shards' results are merged.

Equal vectors are one node, which holds the k + 1 smallest of its distinct ids, all that any answer could need, so copies
neither crowd the graph nor are lost. All other rows are indexed and searched; a query block meets
every shard. Scores are inner products of the original vectors in double precision.

Nulls: a null vector, one that is empty, zero or holds a null or non-finite component, and a row with
a null id take no part. Vectors of different lengths meet only their like. Rows equal in id and vector are
one candidate and one query; those of one id and several vectors are as many. A query never finds its
own id. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored; there are no texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, lean, table

SHARD, QUERY_BLOCK = 8192, 512
WIDTH, CANDIDATES = 32, 64


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    df = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where("id is not null and v is not null").where(~odd).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _select(sims: np.ndarray, gram: np.ndarray, width: int) -> np.ndarray:
    """Which of each row's candidates, by descending similarity, become neighbours."""
    chosen = np.zeros(sims.shape, bool)
    for j in range(sims.shape[1]):
        rival = np.where(chosen, gram[:, j, :], -np.inf).max(axis=1)
        chosen[:, j] = (rival < sims[:, j]) & (chosen.sum(axis=1) < width) & np.isfinite(sims[:, j])
    room = width - chosen.sum(axis=1)
    spare = ~chosen & np.isfinite(sims)
    return chosen | (spare & (np.cumsum(spare, axis=1) <= room[:, None]))


def _level(x: np.ndarray, width: int) -> np.ndarray:
    """Neighbours of the vectors ``x`` of one level, as an array of ``2 * width`` per node with -1 at the end."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    links = []
    for a in range(0, n if c else 0, 512):
        own = x[a : a + 512]
        sims = own @ x.T
        sims[np.arange(len(own)), np.arange(a, a + len(own))] = -np.inf
        top = np.argpartition(-sims, c - 1, axis=1)[:, :c] if c < n else np.argsort(-sims, axis=1)
        near = np.take_along_axis(sims, top, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        top, near = np.take_along_axis(top, order, axis=1), np.take_along_axis(near, order, axis=1)
        near_vectors = x[top]
        keep = _select(near, near_vectors @ near_vectors.transpose(0, 2, 1), width)
        row, k = np.nonzero(keep)
        links.append((row + a, top[row, k], near[row, k]))
    out = np.full((n, 2 * width), -1, np.int32)
    if links:
        u, v, s = (np.concatenate(z) for z in zip(*links))
        src, dst, sim = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([s, s])
        back = np.repeat([0, 1], len(u))
        order = np.lexsort((dst, -sim, back, src))
        src, dst = src[order], dst[order]
        _, first = np.unique(src.astype(np.int64) * n + dst, return_index=True)
        once = np.zeros(len(src), bool)
        once[first] = True
        src, dst = src[once], dst[once]
        rank = np.arange(len(src)) - np.searchsorted(src, src)
        fits = rank < 2 * width
        out[src[fits], rank[fits]] = dst[fits]
    return out


class Graph:
    """The index of one shard."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.nodes, self.links = x, nodes, links

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        longest = (x.astype(np.float64) ** 2).sum(axis=1)
        more = np.sqrt(np.maximum(longest.max() - longest, 0))
        y = np.hstack([x, more[:, None].astype(np.float32)])
        u = np.random.default_rng(len(x)).random(len(x))
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(WIDTH / 2)).astype(int), 6)
        nodes, links = [], []
        for k in range(int(level.max()) + 1):
            own = np.flatnonzero(level >= k).astype(np.int32)
            nodes.append(own)
            links.append(_level(y[own], WIDTH if k == 0 else WIDTH // 2))
        return cls(x, nodes, links)

    def pack(self) -> list[bytes]:
        sizes = np.array([len(n) for n in self.nodes], np.int32)
        return [sizes.tobytes(), b"".join(n.tobytes() for n in self.nodes), b"".join(a.tobytes() for a in self.links)]

    @classmethod
    def unpack(cls, x: np.ndarray, sizes: bytes, nodes: bytes, links: bytes) -> Graph:
        sizes, flat = np.frombuffer(sizes, np.int32), np.frombuffer(links, np.int32)
        own, at, out = np.split(np.frombuffer(nodes, np.int32), np.cumsum(sizes)[:-1]), 0, []
        for k, n in enumerate(sizes):
            w = 2 * (WIDTH if k == 0 else WIDTH // 2)
            out.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(x.astype(np.float32), own, out)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of up to ``ef`` near nodes for each query; -1 where there are fewer."""
        rows = np.arange(len(q))
        at = np.zeros(len(q), np.int64)  # place in the level's nodes
        for k in range(len(self.nodes) - 1, 0, -1):
            own, links = self.nodes[k], self.links[k]
            here = (q * self.x[own[at]]).sum(axis=1)
            while True:
                near = links[at]
                sims = np.where(near >= 0, np.einsum("qd,qwd->qw", q, self.x[own[near]]), -np.inf)
                best = sims.argmax(axis=1)
                better = sims[rows, best] > here
                if not better.any():
                    break
                at = np.where(better, near[rows, best], at)
                here = np.where(better, sims[rows, best], here)
            at = np.searchsorted(self.nodes[k - 1], own[at])
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        done = np.ones((len(q), ef), bool)
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, (q * self.x[at]).sum(axis=1), False
        seen[rows, at] = True
        seen[:, -1] = True
        active, step = rows, 4
        while len(active):
            # the best nodes of each query that are not expanded yet stand first in order
            rank = np.where(done[active], np.inf, -sims[active])
            pick = np.argpartition(rank, min(step, ef - 1) - 1, axis=1)[:, :step] if ef > step else np.argsort(rank, axis=1)
            live = np.isfinite(np.take_along_axis(rank, pick, axis=1))
            some = live.any(axis=1)
            active, pick, live = active[some], pick[some], live[some]
            if not len(active):
                break
            done[active[:, None], pick] = True
            near = np.where(live[:, :, None], self.links[0][ids[active[:, None], pick]], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            s = np.where(fresh, np.einsum("qd,qwd->qw", q[active], self.x[near]), -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[active], s], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[active], sims[active], done[active] = (np.take_along_axis(z, top, axis=1) for z in (all_ids, all_sims, all_done))
        return ids, sims


def build_index(vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """One row per shard: (dim, shard, x, sizes, nodes, links, ids, ends), from ``vectors`` (id, v, dim)."""
    nodes = vectors.select("dim", "v", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["dim", "v", "salt"], ["dim", "v"]):  # first the least of each salted group, then of these
        nodes = nodes.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    nodes = nodes.groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = scratch.table(nodes, "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim = t.column("dim")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        order = np.lexsort(x.T[::-1])
        lists = t.column("ids").take(pa.array(order)).combine_chunks()
        ids = lists.flatten().to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy()).astype(np.int64)
        row = [[dim], [t.column("shard")[0].as_py()], [t.column("shards")[0].as_py()], [x[order].tobytes()], *([b] for b in Graph.build(x[order].astype(np.float32)).pack()), [ids.tobytes()], [ends.tobytes()]]
        return pa.table([pa.array(c, kind) for c, kind in zip(row, [pa.int32()] * 3 + [pa.binary()] * 6)], names=names)

    names = ["dim", "shard", "shards", "x", "sizes", "nodes", "links", "ids", "ends"]
    built = dealt.select("dim", "shard", "shards", "v", "ids").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, shards int, x binary, sizes binary, nodes binary, links binary, ids binary, ends binary")
    return scratch.table(built, "index")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, ef: int = 160) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``vectors`` to each query, both (id, v, dim)."""
    scratch = Scratch(vectors.sparkSession, "ann")
    index = build_index(vectors, k, scratch)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def gather(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
        return pa.table([pa.array([t.column("dim")[0].as_py()], pa.int32()), pa.array([t.column("id").to_numpy().tobytes()]), pa.array([t.column("key").to_numpy().tobytes()]), pa.array([q.tobytes()])], names=["dim", "query_ids", "query_keys", "q"])

    asked = queries.select("id", "v", "dim").distinct().withColumn("key", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(gather, "dim int, query_ids binary, query_keys binary, q binary")
    shards = index.groupBy("dim").agg(F.first("shards").alias("n"))
    asked = asked.join(F.broadcast(shards), "dim").select("dim", "query_ids", "query_keys", "q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"))

    @lean
    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"], np.float64).reshape(-1, r["dim"])
                graph = Graph.unpack(x, r["sizes"], r["nodes"], r["links"])
                own, keys = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["query_keys"], np.int64)
                q = np.frombuffer(r["q"], np.float64).reshape(-1, r["dim"])
                ids, ends = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ends"], np.int64)
                found, _ = graph.search(q.astype(np.float32), max(ef, 2 * k))
                exact = np.where(found >= 0, np.einsum("qd,qwd->qw", q, x[found]), -np.inf)
                node = np.where(found >= 0, found, 0)
                counts = np.where(found >= 0, ends[node] - np.where(node > 0, ends[node - 1], 0), 0)
                row, col = np.nonzero(counts)
                n = counts[row, col]
                begin = (ends[node[row, col]] - n).astype(np.int64)
                flat = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
                who, score, vec = np.repeat(row, n), np.repeat(exact[row, col], n), ids[flat]
                other = vec != own[who]
                who, score, vec = who[other], score[other], vec[other]
                order = np.lexsort((vec, -score, who))
                who, score, vec = who[order], score[order], vec[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                top = rank < k
                yield pa.record_batch([pa.array(own[who[top]]), pa.array(keys[who[top]]), pa.array(vec[top]), pa.array(score[top])], names=["query_id", "key", "vec_id", "score"])

    pairs = asked.join(index.drop("shards"), ["dim", "shard"])
    results = pairs.mapInArrow(search, "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    merged = results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return few(merged.select("query_id", "rank", "vec_id", "score"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors.where("id % 20 = 0"), vectors)
