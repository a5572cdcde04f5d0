"""A combined view of two libraries kept up to date by a feed of changes.

A change is (seq, source local or remote, op, id, columns): A adds, R removes, U updates, X resets.
Adding sets the source's flag, and the row's columns if the row is new; removing clears the flag, and
the row goes when both are clear; updating copies the columns if the row is there, last writer wins;
a reset of the remote side removes it from every row, one of the local side is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """The state (key, columns, is_local, is_remote) after all changes, by windows over each key's changes in order.

    Remote resets aren't dealt to the keys: a change counts the resets before it in one sorted array of their numbers,
    and a remote flag of an earlier count has been reset.
    """
    resets = changes.where("op = 'X' and source = 'remote'").agg(F.sort_array(F.collect_set("seq")).alias("_resets"))
    own = changes.where("op <> 'X'").join(F.broadcast(resets))  # one row, eight bytes a reset
    own = own.withColumn("_epoch", F.size(F.filter("_resets", lambda x: x < F.col("seq")))).withColumn("_epochs", F.size("_resets")).drop("_resets")
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    flags = F.col("op").isin("A", "R")
    here = F.last(F.when(flags & (F.col("source") == "local"), F.col("op") == "A"), ignorenulls=True)
    there = F.last(F.when(flags & (F.col("source") == "remote"), F.struct((F.col("op") == "A").alias("on"), F.col("_epoch").alias("epoch"))), ignorenulls=True)
    known = own.withColumn("_here", F.coalesce(here.over(before), F.lit(False))).withColumn("_there", there.over(before))
    present = F.col("_here") | F.coalesce(F.col("_there.on") & (F.col("_there.epoch") == F.col("_epoch")), F.lit(False))
    sets = ((F.col("op") == "A") & ~present) | ((F.col("op") == "U") & present)
    order = lambda c: F.when(c, F.col("seq"))
    final = known.withColumn("_sets", sets).groupBy(key).agg(
        F.max_by(F.struct(*columns), order(F.col("_sets"))).alias("_row"),
        F.coalesce(F.max_by(F.col("op") == "A", order(flags & (F.col("source") == "local"))), F.lit(False)).alias("is_local"),
        F.coalesce(F.max_by((F.col("op") == "A") & (F.col("_epoch") == F.col("_epochs")), order(flags & (F.col("source") == "remote"))), F.lit(False)).alias("is_remote"),
    )
    return final.where("is_local or is_remote").select(key, *[F.col(f"_row.{c}").alias(c) for c in columns], "is_local", "is_remote")


def apply_changes(state: tuple | None, changes: pd.DataFrame, columns: list[str]) -> tuple | None:
    """The state (is_local, is_remote, values) of one key after more changes."""
    is_local, is_remote, values = state or (False, False, None)
    for c in changes.sort_values("seq").itertuples(index=False):
        remote = c.source == "remote"
        if c.op == "A":
            if not (is_local or is_remote):
                values = tuple(getattr(c, x) for x in columns)
            is_local, is_remote = (is_local, True) if remote else (True, is_remote)
        elif c.op == "R" or c.op == "X" and remote:
            is_local, is_remote = (is_local, False) if remote else (False, is_remote)
        elif c.op == "U" and (is_local or is_remote):
            values = tuple(getattr(c, x) for x in columns)
        if not (is_local or is_remote):
            values = None
    return (is_local, is_remote, values) if is_local or is_remote else None


def combined_stream(changes: DataFrame, columns: list[str], key: str = "id", checkpoint: str | None = None):
    """The stream of a key's state after each batch: (key, columns, is_local, is_remote, gone).

    Changes of a key are applied in order of seq within a batch. A reset must be sent to each key that it concerns.
    """
    schema = changes.schema
    fields = {c: schema[c].dataType.simpleString() for c in [key, *columns]}
    output = ", ".join([f"`{key}` {fields[key]}", *[f"`{c}` {fields[c]}" for c in columns], "is_local boolean, is_remote boolean, gone boolean"])
    state_schema = ", ".join(["is_local boolean, is_remote boolean", *[f"`{c}` {fields[c]}" for c in columns]])

    def update(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = None
        if state.exists:
            held = state.get
            now = (held[0], held[1], tuple(held[2:]))
        now = apply_changes(now, pd.concat(list(frames)), columns)
        if now is None:
            if state.exists:
                state.remove()
            values, flags = tuple(None for _ in columns), (False, False, True)
        else:
            state.update((now[0], now[1], *now[2]))
            values, flags = now[2], (now[0], now[1], False)
        yield pd.DataFrame([(*group, *values, *flags)], columns=[key, *columns, "is_local", "is_remote", "gone"])

    return changes.groupBy(key).applyInPandasWithState(update, output, state_schema, "update", "NoTimeout")


def latest(updates: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """The current view from collected stream output with a batch number."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return updates.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not gone").drop("_n", "gone")
