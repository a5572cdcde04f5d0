"""Shared pieces of the training-data operators: tables, scratch storage, bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    A local master without that setting (as in tests) gets a temporary folder; on a cluster the
    setting is required, since a machine-local folder would be invisible to the other machines.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="bindery-")
    spark.sparkContext.setCheckpointDir(at)
    return shared_dir(spark)


class Scratch:
    """Tables written to the shared folder. They cut lineage, and outlive lost executors.

    Results read the tables lazily, so they stay until ``drop`` or the end of the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/bindery-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        # no empty mark of success: the driver would start a process to set its mode
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written by now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a table that may be broadcast, as its values need them; a row counts for some bytes of its own.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 48


def _width(kind: T.DataType, c):
    """Bytes of a value, counted as it is held."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
        return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda a, x: a + _width(kind.elementType, x)), F.lit(8))
    if isinstance(kind, T.ArrayType):
        each = 16 + 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.size(c), F.lit(0)) * each + 8
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows hold at most ``most`` bytes, else as it is (Spark then shuffles, and splits skew).

    ``df`` should read a written table, since its bytes are summed here.
    """
    total = df.select(sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(ROW_BYTES)).cast("long").alias("n")).agg(F.sum("n")).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame) -> DataFrame:
    """``df``, whose rows are narrow, in parts of the session's advisory size.

    A long stage over texts then leaves its small results in a few files instead of one a task. Only where the session
    doesn't let Spark merge small parts are they merged here, eight to one, whatever their size.
    """
    merged = df.hint("rebalance")
    if df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true":
        return merged
    return merged.coalesce(max(1, parts(df.sparkSession) // 8))


#: What this worker keeps from task to task of one stage: (stage, thing) by key.
_held: dict[object, tuple[int, object]] = {}


def _stage() -> int:
    context = TaskContext.get()
    return context.stageId() if context else -1


def held(key, make):
    """``make()``, once per worker and stage; ``lean`` functions of other stages let it go."""
    stage = _stage()
    if key not in _held or _held[key][0] != stage:
        _held[key] = (stage, make())
    return _held[key][1]


def let_go() -> None:
    """Drops what other stages held."""
    stage = _stage()
    old = [k for k, (of, _) in _held.items() if of != stage]
    for key in old:
        del _held[key]
    if old:
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(f):
    """``f``, a function over batches, whose worker gives memory back to the system: what other stages held when the task
    begins, and what was freed when it ends."""

    @functools.wraps(f)
    def run(batches):
        let_go()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def split_rows(lengths, most: int):
    """Ranges [i, j) of consecutive rows whose lengths sum to ``most`` or less; a longer row stands alone."""
    i, total = 0, 0
    for j, n in enumerate(lengths):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += int(n)
    if i < len(lengths):
        yield i, len(lengths)
