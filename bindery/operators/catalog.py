"""A library's catalog: a table of books in immutable versions, with inserts, updates, re-keying and removal.

Each change writes the next version's folder and then moves a pointer file, so readers keep what they
read, and a path is never overwritten while a plan reads it. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators.reconcile import allocate_ids
from bindery.schema import BOOK_FIELDS


class IdNotFound(KeyError):
    pass


class Library:
    """A catalog below ``root``, a folder that all machines see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.first_use = not os.path.exists(self._pointer)
        if self.first_use:
            os.makedirs(root, exist_ok=True)
            self._commit(spark.createDataFrame([], BOOK_FIELDS), 0)

    @property
    def _pointer(self) -> str:
        return os.path.join(self.root, "catalog.json")

    def meta(self) -> dict:
        """{id, version, last_used_id, folder}."""
        with open(self._pointer) as f:
            return json.load(f)

    def books(self) -> DataFrame:
        return self.spark.read.schema(BOOK_FIELDS).parquet(os.path.join(self.root, self.meta()["folder"]))

    def _commit(self, books: DataFrame, last_used: int) -> None:
        version = self.meta()["version"] + 1 if os.path.exists(self._pointer) else 1
        folder = f"books-{version:06d}-{uuid.uuid4().hex[:8]}"
        books.write.parquet(os.path.join(self.root, folder))
        temporary = f"{self._pointer}.{uuid.uuid4().hex[:8]}"
        with open(temporary, "w") as f:
            json.dump({"id": 1, "version": version, "last_used_id": last_used, "folder": folder}, f)
        os.replace(temporary, self._pointer)

    def insert(self, new: DataFrame, added=None) -> DataFrame:
        """Adds books, numbering those of id 0 or null; returns (id, error) of those whose id is taken."""
        books, last = self.books(), self.meta()["last_used_id"]
        day = F.lit(added).cast("date") if added is not None else F.current_date()
        new = new.withColumn("date_added", day).select(books.columns)
        keyed = new.where("id is not null and id <> 0")
        taken = keyed.join(books.select("id"), "id", "left_semi").select("id", F.concat(F.lit("id is taken: "), F.col("id")).alias("error"))
        twice = keyed.groupBy("id").count().where("count > 1").select("id", F.concat(F.lit("id is given twice: "), F.col("id")).alias("error"))
        errors = taken.unionByName(twice.join(taken, "id", "left_anti"))
        fresh = allocate_ids(new.where("id is null or id = 0"), last, "file_path", "title").select(books.columns)
        out = books.unionByName(keyed.join(errors.select("id"), "id", "left_anti").select(books.columns)).unionByName(fresh)
        rejected = os.path.join(self.root, f"rejected-{uuid.uuid4().hex[:8]}")
        errors.write.parquet(rejected)  # for the caller to look at, written before the catalog moves on
        n = new.where("id is null or id = 0").count()
        self._commit(out, last + n)
        return self.spark.read.schema("id int, error string").parquet(rejected)

    def update(self, changed: DataFrame) -> None:
        """Replaces whole rows by id; an unknown id raises."""
        books = self.books()
        unknown = changed.join(books.select("id"), "id", "left_anti").select("id").head(1)
        if unknown:
            raise IdNotFound(unknown[0].id)
        self._commit(books.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(books.columns)), self.meta()["last_used_id"])

    def rekey(self, keys: DataFrame, added=None) -> None:
        """Gives books (id) a new id (new_id); they count as added anew."""
        books = self.books()
        day = F.lit(added).cast("date") if added is not None else F.current_date()
        moved = books.join(keys, "id").withColumn("id", F.col("new_id").cast("int")).withColumn("date_added", day).select(books.columns)
        rest = books.join(keys.select("id"), "id", "left_anti").join(keys.select(F.col("new_id").cast("int").alias("id")), "id", "left_anti")
        self._commit(rest.select(books.columns).unionByName(moved), self.meta()["last_used_id"])

    def remove(self, ids: DataFrame) -> None:
        books = self.books()
        self._commit(books.join(ids.select("id"), "id", "left_anti").select(books.columns), self.meta()["last_used_id"])

    def drop(self) -> None:
        self._commit(self.spark.createDataFrame([], BOOK_FIELDS), self.meta()["last_used_id"])

    def find(self, book_id: int) -> DataFrame:
        return self.books().where(F.col("id") == book_id).limit(1)

    def find_isbn(self, isbn) -> DataFrame:
        """The book of lowest id with this ISBN; none for 0."""
        return self.books().where((F.col("isbn") == F.lit(str(isbn)).cast("decimal(20,0)")) & (F.col("isbn") != 0)).orderBy("id").limit(1)

    def dump(self) -> DataFrame:
        """(id, json) of each row."""
        return self.books().select("id", F.to_json(F.struct("*")).alias("json"))
