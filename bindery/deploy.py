"""Makes this package importable in Spark's Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers as a zip file, once per application, and bounds the batches they get."""
    # Spark's defaults are too much for rows of long texts: arrays of many megabytes for each batch of a column
    for key, default, own in (("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64MB"), "4194304"), ("spark.sql.parquet.columnarReaderBatchSize", ("4096",), "512")):
        if spark.conf.get(key) in default:
            spark.conf.set(key, own)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bindery-ship-")) / "bindery.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
