"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import Scratch, few


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u long, v long); component is the smallest node reachable.

    Each step rewires every node to the smallest node it sees, so the number of steps grows with the
    logarithm of the number of nodes, squared at worst. Steps are written tables, which cut the
    lineage; nothing but counts reaches the driver. An empty edge list gives no rows; loops and repeated edges do no harm.
    """
    now = scratch.table(few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), f"{name}-0")
    step, before = 0, None
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large-star: the larger neighbours of u go to the smallest node around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the smaller neighbours of u, and u, go to the smallest of them
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(tops, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tops.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = scratch.table(few(small), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        now = following
        # a star forest has one edge a node, and another step leaves it as it is
        if state[0] == state[2] and tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
