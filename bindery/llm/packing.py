"""Operator 5: vector best-fit packing of documents into training sequences.

An item is a piece of a document; its demand is the vector (tokens, 1 document, tokens ** 2 of
attention cost), so pieces of one length are alike. A bin has a capacity for each of the three.
Lengths are placed in descending order; each goes to the open bin that has room in every dimension
and scores best, by the smallest weighted norm of what would remain, or by the largest weighted dot
product of demand and residual.

Only the histogram of lengths (at most ``length`` rows, whatever the corpus holds) reaches the
driver. Bins in the same state are kept as ranges, so a plan has a row per range of equal moves. The
pieces then find their slot by their rank among the pieces of the same length: ranks are taken in
salted groups and shifted by the counts of the groups before, so no length gathers in one task.

Without other limits a sequence holds as many documents, and as much attention cost, as its tokens allow; these two
then only weigh in the score. Lower limits bind, and may cost sequences.

Nulls: a null text counts as empty (the end id alone); a null doc_id is kept. Equal rows are packed
as separate documents. An empty table gives no rows. A very long text is encoded in one block and cut. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few, lean, table
from bindery.llm.tokens import table as piece_table
from bindery.llm.words import text_blocks

#: Pieces in a salted group, about.
GROUP = 500_000


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. ``weights`` scale the normalised residuals of tokens, documents and attention cost."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 0, keep_ids: bool = False, plain: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of ``docs``; only texts of over ``length`` ids are cut."""

    @lean
    def pieces(batches):
        encoder = piece_table(tokenizer, plain)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for i, j, data, offsets in text_blocks(batch.column("text")):
                flat, sizes = encoder.encode(data, offsets)
                flat = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4")
                sizes = sizes + 1
                counts = -(-sizes // length)
                row = np.repeat(np.arange(j - i), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * length
                own = np.minimum(length, sizes[row] - start)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                parts = [flat[a : a + n] for a, n in zip(begin, own)]
                out = [doc_ids.slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(own), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if keep_ids:
                    out.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                yield pa.record_batch(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


def plan_bins(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first bin, offset) of each range of moves, for ``counts`` pieces by length.

    Ranks from one row's first rank up to the next row's of that length go to consecutive bins.
    """
    limits = capacity.limits()
    weights = np.array(capacity.weights) / limits.astype(float) ** 2
    states = np.empty((0, 3), np.int64)  # residuals of the open states
    ranges: list[list[tuple[int, int]]] = []  # bins of each state: (first, number)
    at: dict[tuple[int, int, int], int] = {}
    moves: list[tuple[int, int, int, int]] = []
    bins = 0
    smallest = min(counts, default=0)

    def put(residual: np.ndarray, first: int, number: int) -> None:
        nonlocal states
        if residual[0] < smallest or residual[1] < 1 or residual[2] < smallest**2:
            return
        key = tuple(residual.tolist())
        if key not in at:
            at[key] = len(ranges)
            ranges.append([])
            states = np.vstack([states, residual])
        ranges[at[key]].append((first, number))

    for size in sorted(counts, reverse=True):
        demand = np.array([size, 1, size * size], np.int64)
        if (demand > limits).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacity of an empty sequence")
        left, rank = counts[size], 0
        live = np.array([bool(x) for x in ranges], bool)
        keep = np.flatnonzero(live)
        if len(keep) < len(ranges):  # states whose bins have all moved on
            states, ranges = states[keep], [ranges[i] for i in keep]
            at = {tuple(x): i for i, x in enumerate(states.tolist())}
        rest = states - demand
        fits = (rest >= 0).all(axis=1)
        score = (weights * rest.astype(float) ** 2).sum(axis=1) if capacity.rule == "norm" else -(weights * demand * states).sum(axis=1)
        queue = sorted((float(score[i]), i) for i in np.flatnonzero(fits))
        while left:
            if queue:
                _, i = queue[0]
                if not ranges[i]:
                    queue.pop(0)
                    continue
                first, number = ranges[i].pop()
                residual = states[i]
            else:
                # a new bin; as many of this size as fit go in side by side before the next is opened
                room = int((limits // demand).min())
                first, number, residual = bins, -(-left // room), limits
                bins += number
            used = min(left, number)
            if used < number:
                ranges[at[tuple(residual.tolist())]].append((first + used, number - used)) if tuple(residual.tolist()) in at else put(residual, first + used, number - used)
            moves.append((size, rank, first, int(limits[0] - residual[0])))
            left, rank = left - used, rank + used
            rest_of = residual - demand
            known = tuple(rest_of.tolist()) in at
            put(rest_of, first, used)
            if left and (rest_of >= demand).all():
                i = at[tuple(rest_of.tolist())]
                own = float((weights * (rest_of - demand).astype(float) ** 2).sum()) if capacity.rule == "norm" else -float((weights * demand * rest_of).sum())
                if not known or (own, i) not in queue:
                    bisect.insort(queue, (own, i))
    return moves


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = plan_bins(histogram, capacity)
    sizes = np.array([m[0] for m in moves], np.int64)
    ranks, bins, offsets = (np.array([m[k] for m in moves], np.int64) for k in (1, 2, 3))
    heads = {size: int(np.searchsorted(-sizes, -size, "left")) for size in histogram}
    tails = {size: int(np.searchsorted(-sizes, -size, "right")) for size in histogram}

    salts = max(1, sum(histogram.values()) // GROUP)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_local", F.row_number().over(own) - 1).join(groups, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_local"))
    names = [c for c in pieces.columns]
    ranked = ranked.select(*names, "_rank")

    @lean
    def place(batches):
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                here = size == s
                a, b = heads[int(s)], tails[int(s)]
                k = a + np.searchsorted(ranks[a:b], rank[here], "right") - 1
                sequence[here], offset[here] = bins[k] + rank[here] - ranks[k], offsets[k]
            yield pa.record_batch([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), keep_ids: bool = False, plain: bool = False) -> DataFrame:
    """Encodes, cuts and packs ``docs``; keep_ids adds each piece's ids (little-endian unsigned 32-bit).

    Special tokens' strings in a text are what the library takes them for, or ordinary text if ``plain``.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = token_pieces(docs, tokenizer, capacity.tokens, keep_ids=keep_ids, plain=plain)
    return pack(scratch.table(pieces if keep_ids else few(pieces), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
