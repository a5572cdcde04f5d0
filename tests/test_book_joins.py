from pyspark.sql import functions as F

from bindery.plans import books as books_plan
from bindery.sinks import ebooks as sink


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_books_are_not_broadcast(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    files = books_plan._files(t, "mobi")
    updates = books_plan._books(t).select(F.concat(F.col("id").cast("string"), F.lit(".mobi")).alias("path"), "title", "author", "publisher", "isbn")
    assert "BroadcastHashJoin" not in _plan(files) and "BroadcastHashJoin" not in _plan(sink.with_metadata(files, updates))
