"""Operator 1: token ids in Arrow files of equal-length sequences and masks.

A data set is a folder of numbered Arrow IPC files (the stream format between a leading mark and a
footer that makes every batch addressable). Each has the columns

    tokens  fixed_size_list<uint16 or uint32>[length]   ids, uint16 if the vocabulary allows it
    mask    fixed_size_list<bool>[length]               true where tokens holds a real id

in batches of ``BATCH`` sequences, uncompressed, so that a memory map gives sequence i of a file as
a zero-copy slice of batch i // BATCH. Only a file's last sequence has padding. Beside each file
``NAME.docs.arrow`` lists its documents in order: doc_id, n_tokens. Files are in ascending doc_id
order, and so are the documents in them.

Nulls: a null text counts as empty and holds the end id alone; a null doc_id sorts first. Equal
doc_ids keep all their rows, in the order of a hash of the text. A very long text is encoded in one block and runs through as many sequences as it
fills. An empty table gives no file and no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, lean, table
from bindery.llm.tokens import table as pieces
from bindery.llm.tokens import vocabulary_size
from bindery.llm.words import text_blocks

#: Sequences in a batch.
BATCH = 64


@dataclass
class TokenFiles:
    """What ``write_tokens`` wrote: one (name, tokens, documents) per file, in order."""

    root: str
    length: int
    files: list[tuple[str, int, int]]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _Writer:
    """One data file: sequences are cut from a running buffer, batches leave as they fill."""

    def __init__(self, fs, path: str, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.sink = fs.open_output_stream(path)
        kind = pa.list_(pa.field("item", pa.from_numpy_dtype(self.dtype), False), length)
        self.schema = pa.schema([pa.field("tokens", kind, False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        self.total += len(ids)
        whole = BATCH * self.length
        if self.size >= whole:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - whole + 1, whole):
                self._batch(flat[i : i + whole], whole)
            rest = flat[len(flat) // whole * whole :]
            self.held, self.size = [rest], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((flat, mask))]
        self.out.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.out.close()
        self.sink.close()


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, length: int = 2048, plain: bool = False) -> TokenFiles:
    """Encodes ``docs`` (doc_id, text) to files under ``root``, a folder that all machines share.

    The texts are range-partitioned by doc_id once; each task encodes and writes its own file under a name
    of its attempt, which the row that it returns tells. So a task may run again, and of what lost attempts
    leave nothing is read. The driver gets one row a file. Special tokens' strings in a text are what the
    library takes them for, or ordinary text if ``plain``.
    """
    dtype = "uint16" if vocabulary_size(tokenizer) <= 1 << 16 else "uint32"

    @lean
    def write(batches):
        fs, base = _open(root)
        fs.create_dir(base)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        out, n_docs = None, 0
        encoder = pieces(tokenizer, plain)
        kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = _Writer(fs, f"{base}/{name}.arrow", length, dtype)
                index_sink = fs.open_output_stream(f"{base}/{name}.docs.arrow")
                index = pa.ipc.new_file(index_sink, kinds)
            doc_ids = batch.column("doc_id")
            for i, j, data, offsets in text_blocks(batch.column("text")):
                flat, sizes = encoder.encode(data, offsets)
                full = np.insert(flat, np.cumsum(sizes), end_id)
                out.add(full)
                index.write_batch(pa.record_batch([doc_ids.slice(i, j - i), pa.array(sizes + 1)], schema=kinds))
                n_docs += j - i
        if out is None:
            return
        out.close()
        index.close()
        index_sink.close()
        yield pa.record_batch([pa.array([name]), pa.array([out.total]), pa.array([n_docs])], names=["name", "n_tokens", "n_docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = sorted(map(tuple, ordered.mapInArrow(write, "name string, n_tokens long, n_docs long").collect()))
    return TokenFiles(root, length, files)


def read_documents(spark: SparkSession, data: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts all ids before it."""
    root, length = data.root, data.length
    names = [x[0] for x in data.files]
    bases = np.concatenate([[0], np.cumsum([x[1] for x in data.files], dtype=np.int64)]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.range(0, len(names), 1, len(names))

    @lean
    def read(batches):
        fs, base = _open(root)
        for number in (x for b in batches for x in b.column(0).to_pylist()):
            with fs.open_input_file(f"{base}/{names[number]}.arrow") as f, fs.open_input_file(f"{base}/{names[number]}.docs.arrow") as g:
                sequences, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
                at, start, held, offset = 0, bases[number], np.empty(0, "<u4"), 0
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    sizes = part.column("n_tokens").to_numpy()
                    sums = np.zeros(len(sizes), np.int64)
                    for i, n in enumerate(sizes):
                        while len(held) - offset < n:
                            batch = sequences.get_batch(at)
                            real = batch.column("tokens").flatten().to_numpy()
                            if at == sequences.num_record_batches - 1:
                                real = real[batch.column("mask").flatten().to_numpy(zero_copy_only=False)]
                            held, offset, at = np.concatenate([held[offset:], real.astype("<u4")]), 0, at + 1
                        sums[i] = zlib.crc32(held[offset : offset + n])
                        offset += n
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.record_batch([part.column("doc_id"), pa.array(starts), pa.array(sizes), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, schema)


def read_sequence(data: TokenFiles, file: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, mask) of sequence ``i`` of a file; a zero-copy view where the folder is local."""
    fs, base = _open(data.root)
    path = f"{base}/{data.files[file][0]}.arrow"
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(i // BATCH)
    return tuple(batch.column(k).slice(i % BATCH, 1).flatten().to_numpy(zero_copy_only=k == "tokens") for k in ("tokens", "mask"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    data = write_tokens(table(spark, sf_dir, "documents"), scratch.path("files"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, data)
