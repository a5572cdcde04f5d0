"""Reconciliation of two catalogs: combined view, sync plan, merges, rescan, import decisions, reorganization.

Catalogs are DataFrames with an ``id``; where one side's row must win, presence decides, not nullness.
Plans are DataFrames of what to do; nothing here touches files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, in the order of the given columns."""
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in order or df.columns])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def combined_library(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Full outer merge: the local row's columns where there is one, and is_local, is_remote."""
    columns = [c for c in local.columns if c != key]
    left = local.select(key, F.struct(*columns).alias("_local"))
    right = remote.select(key, F.struct(*[c if c in remote.columns else F.lit(None).cast(local.schema[c].dataType).alias(c) for c in columns]).alias("_remote"))
    both = left.join(right, key, "full_outer")
    is_local, is_remote = F.col("_local").isNotNull(), F.col("_remote").isNotNull()
    picked = [F.when(is_local, F.col(f"_local.{c}")).otherwise(F.col(f"_remote.{c}")).alias(c) for c in columns]
    return both.select(key, *picked, is_local.alias("is_local"), is_remote.alias("is_remote"))


def detach_remote(combined: DataFrame) -> DataFrame:
    return combined.where("is_local").withColumn("is_remote", F.lit(False))


def merge_libraries(local: DataFrame, remote: DataFrame | None, key: str = "id") -> DataFrame:
    """All local rows, and the remote rows of other keys."""
    return local if remote is None else local.unionByName(remote.join(local.select(key), key, "left_anti"))


def sync_plan(local: DataFrame, device: DataFrame, exclude: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Local rows that the device lacks, without those that the user has unchecked."""
    plan = local.join(device.select(key), key, "left_anti")
    return plan if exclude is None else plan.join(exclude.select(key), key, "left_anti")


def in_library(books: DataFrame, library: DataFrame, key: str = "id", flag: str = "in_library") -> DataFrame:
    """``books`` with whether the library has their key."""
    keys = library.select(F.col(key).alias("_key")).distinct()
    return books.join(keys, F.col(key) == F.col("_key"), "left").withColumn(flag, F.col("_key").isNotNull()).drop("_key")


def delete_scope(is_local: Column, is_remote: Column) -> Column:
    """0: both, 1: device, 2: PC."""
    return F.when(is_local & is_remote, 0).when(is_remote, 1).when(is_local, 2)


def remove_selected(local: DataFrame, remote: DataFrame, selected: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(local, remote) without the selected rows (key, scope)."""
    gone = lambda *scopes: selected.where(F.col("scope").isin(*scopes)).select(key)
    return local.join(gone(0, 2), key, "left_anti"), remote.join(gone(0, 1), key, "left_anti")


def distinct_values(df: DataFrame, column: str, drop_blank: bool = False) -> DataFrame:
    """Distinct values; nulls stay (unlike in collect_set), blanks only if wanted."""
    out = df.select(column)
    return (out.where(F.col(column).isNull() | (F.col(column) != "")) if drop_blank else out).distinct()


def propagate_metadata(library: DataFrame, updates: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``library`` with the given columns taken from ``updates`` where their keys meet."""
    new = updates.select(key, F.struct(*columns).alias("_new"))
    joined = library.join(new, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in library.columns])


def allocate_ids(rows: DataFrame, last_used: int, *order: str, key: str = "id") -> DataFrame:
    """``key`` numbered on from ``last_used``, in the order of the given columns."""
    base = rows.select(*[c for c in rows.columns if c != key])
    # numbers are dealt by range: each range adds the rows of the ranges before it. The bounds are values of the rows
    # with the least hashes, so a row's range doesn't depend on how or how often it is computed
    ranges = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 200)
    place = F.struct(*[F.col(c) for c in order])
    some = base.select(place.alias("_o")).orderBy(F.xxhash64("_o"), "_o").limit(20 * ranges).agg(F.sort_array(F.collect_set("_o")).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges)), lambda i: F.get("_s", F.floor(i * F.size("_s") / (ranges + 1)).cast("int")))
    ranged = base.join(F.broadcast(some.select(at.alias("_bounds")))).withColumn("_part", F.size(F.filter("_bounds", lambda x: x <= place))).drop("_bounds")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = Window.partitionBy("_part").orderBy(*[F.col(c) for c in order])
    out = ranged.withColumn("_local", F.row_number().over(own)).join(counts.select("_part", "_base"), "_part")
    return out.withColumn(key, (F.lit(last_used) + F.col("_base") + F.col("_local")).cast("int")).drop("_part", "_base", "_local")


def rescan_identity(scanned: DataFrame, old: DataFrame, last_used: int, match: str = "isbn", carry: tuple[str, ...] = ("series", "series_num"), order: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Scanned books with the id and carried columns of the first old row of the same match value (0 and null never match).

    Books that match nothing are numbered on from ``last_used`` in the given order.
    """
    known = first_per_key(old.where(F.col(match) != 0).select(match, F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in carry]), match, "_id")
    joined = scanned.join(known, (scanned[match] == known[match]) & (scanned[match] != 0), "left").drop(known[match])
    rest = [F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in carry else F.col(c) for c in scanned.columns if c != "id"]
    matched = joined.where(F.col("_id").isNotNull()).select(F.col("_id").cast("int").alias("id"), *rest)
    fresh = allocate_ids(joined.where(F.col("_id").isNull()).select(*rest), last_used, *order)
    return matched.unionByName(fresh.select(matched.columns))


def import_actions(incoming: DataFrame, catalog: DataFrame, existing_files: DataFrame, device: bool = False) -> DataFrame:
    """(id, path, action, target_id) for each incoming book (id, path), against ``catalog`` (id, path) and files (path).

    To the library: a known id is merged; else, where the file exists, a known path is re-keyed and an unknown one
    overwritten; else the book is inserted. To a device: a known id is updated; a file of unknown path is overwritten;
    a known path re-keyed; else the book is copied.
    """
    ids = catalog.select(F.col("id").alias("_id")).distinct()
    paths = first_per_key(catalog.select(F.col("path").alias("_path"), F.col("id").alias("_path_id")).where("_path is not null"), "_path", "_path_id")
    files = existing_files.select(F.col("path").alias("_file")).distinct()
    df = incoming.join(ids, F.col("id") == F.col("_id"), "left").join(paths, F.col("path") == F.col("_path"), "left").join(files, F.col("path") == F.col("_file"), "left")
    known, path_known, exists = F.col("_id").isNotNull(), F.col("_path").isNotNull(), F.col("_file").isNotNull()
    if device:
        action = F.when(known, "update").when(exists & ~path_known, "overwrite").when(path_known, "rekey").otherwise("copy")
    else:
        action = F.when(known, "merge").when(exists & path_known, "rekey").when(exists, "overwrite").otherwise("insert")
    return df.select("id", "path", action.alias("action"), F.when(action == "rekey", F.col("_path_id")).otherwise(F.col("id")).alias("target_id"))


def local_import_plan(incoming: DataFrame, catalog: DataFrame, native: tuple[str, ...] = (".mobi", ".azw", ".azw3")) -> DataFrame:
    """(path, action): reject paths already in the catalog; convert formats that aren't native; else copy."""
    from bindery.functions.scalars import extension

    known = catalog.select(F.col("path").alias("_path")).distinct()
    joined = incoming.join(known, F.col("path") == F.col("_path"), "left")
    action = F.when(F.col("_path").isNotNull(), "reject").when(extension(F.col("path")).isin(*native), "copy").otherwise("convert")
    return joined.select(*[F.col(c) for c in incoming.columns], action.alias("action"))


def reorganize_plan(books: DataFrame, destination: Column, source: str = "file_path", key: str = "id") -> DataFrame:
    """(id, action, src_path, dst_path) of the books whose path differs from its template's."""
    return books.select(F.col(key), F.lit("move").alias("action"), F.col(source).alias("src_path"), destination.alias("dst_path")).where("src_path <> dst_path")


def split_errors(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)."""
    return results.where(F.col(error).isNull()).drop(error), results.where(F.col(error).isNotNull())


def display_grid(df: DataFrame, hidden: list[str] = (), sort: str | None = None, descending: bool = False, as_text: bool = False) -> DataFrame:
    """Without the hidden columns, sorted by one column (``as_text``: by its text, as the grid of old did for dates)."""
    if sort:
        by = F.col(sort).cast("string") if as_text else F.col(sort)
        df = df.orderBy(by.desc() if descending else by.asc())
    return df.drop(*hidden)


def headed_columns(df: DataFrame, headers: dict[str, str | None]) -> DataFrame:
    """The columns that have a header, under that header, in the order of ``headers``."""
    return df.select(*[F.col(f"`{c}`").alias(h) for c, h in headers.items() if h is not None])


def device_volumes(disks: DataFrame, disk_partitions: DataFrame, partition_volumes: DataFrame, vendor: str = "VEN_KINDLE") -> DataFrame:
    """Volumes of the disks whose device id holds the vendor mark: disks (disk_id, device_id), links (disk_id, partition_id), (partition_id, volume)."""
    return disks.where(F.col("device_id").contains(vendor)).join(disk_partitions, "disk_id").join(partition_volumes, "partition_id")


# ------------------------------------------------------------------ plans of whole operations


def transfer_plan(books: DataFrame, selected: DataFrame, catalog: DataFrame, existing_files: DataFrame, device: bool = True) -> DataFrame:
    """The import plan for the selected books (id), to a device or from it."""
    return import_actions(books.join(selected.select("id"), "id", "left_semi"), catalog, existing_files, device)


def bulk_import_plan(files: DataFrame, catalog: DataFrame, accepted: tuple[str, ...] = (".mobi", ".azw", ".azw3", ".epub")) -> tuple[DataFrame, DataFrame]:
    """(plan, errors) for files (path): those of other formats are errors, paths already in the catalog too."""
    from bindery.functions.scalars import extension

    known = extension(F.col("path")).isin(*accepted)
    plan = local_import_plan(files.where(known), catalog)
    refused = plan.where("action = 'reject'").select(F.col("path").alias("item"), F.lit("the path is in the library").alias("error"))
    other = files.where(~known).select(F.col("path").alias("item"), F.concat(F.lit("no reader for "), extension(F.col("path"))).alias("error"))
    return plan.where("action <> 'reject'"), refused.unionByName(other)


def update_metadata_plan(books: DataFrame, donors: DataFrame, columns: list[str], destination: Column, source: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """(rows, moves): the books that a donor has, with its columns, and those whose path the template now puts elsewhere."""
    changed = propagate_metadata(books.join(donors.select("id"), "id", "left_semi"), donors, columns)
    return changed, reorganize_plan(changed, destination, source)


def delete_plan(library: DataFrame, ids: DataFrame, source: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """(files to remove, errors): ids that the library lacks are errors; a file that is missing already is none."""
    gone = library.join(ids.select("id"), "id", "left_semi").select("id", F.lit("delete").alias("action"), F.col(source).alias("src_path"))
    absent = ids.select("id").join(library.select("id"), "id", "left_anti")
    return gone, absent.select(F.col("id").cast("string").alias("item"), F.lit("no such id").alias("error"))


def error_summary(errors: DataFrame) -> DataFrame:
    """(error, n, items): what went wrong, how often, and a first item."""
    return errors.groupBy("error").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))
