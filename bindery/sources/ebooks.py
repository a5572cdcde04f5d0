"""E-book files as Spark tables: books, records, chapters, images, errors.

Metadata and content are separate readers, so that a query for metadata never decompresses text. A
file that can't be read becomes a row of errors, not a failure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import scalars as S

#: Extensions of devices' own formats, and all that can be imported; case matters, as in the catalogs of old.
NATIVE, ACCEPTED = (".mobi", ".azw", ".azw3"), (".mobi", ".azw", ".azw3", ".epub")

METADATA = "path string, title string, author string, contributor string, publisher string, description string, language string, rights string, isbn decimal(20,0), subject array<string>, pub_date string, error string"
CHAPTERS = "path string, chapter_no int, title string, html string, error string"
IMAGES = "path string, image_no int, content binary, error string"
RECORDS = "path string, rec_no int, offset long, length long, error string"


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ACCEPTED, subdirectories_only: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files below ``root``; content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(S.extension(F.col("path")).isin(*extensions))
    if subdirectories_only:
        base = re.sub(r"^file:/*", "/", root.rstrip("/"))
        files = files.where(F.regexp_replace("path", r"^file:/*", "/").rlike("^" + re.escape(base) + "/[^/]+/"))
    return files


def directories(files: DataFrame) -> DataFrame:
    """Every directory above a file, none of them empty."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")).where("dir <> ''").distinct()


def tree(files: DataFrame, extensions: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """(path, parent, is_file): the accepted files, and the directories that hold one somewhere below."""
    own = files.select("path").where(S.extension(F.col("path")).isin(*extensions))
    both = own.select("path", F.lit(True).alias("is_file")).unionByName(directories(own).select(F.col("dir").alias("path"), F.lit(False).alias("is_file")))
    return both.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), "is_file")


def selected_files(nodes: DataFrame, checked: DataFrame) -> DataFrame:
    """(path) of the files of a tree that are checked (path), or stand below a directory that is."""
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return nodes.where("is_file").select("path", above.alias("_at")).join(checked.select(F.col("path").alias("_at")), "_at", "left_semi").select("path").distinct()


def _mobi_metadata(data: bytes) -> dict:
    from bindery.sources import mobi_format as M

    return M.metadata(M.read_headers(data))


def _epub_metadata(data: bytes) -> dict:
    from bindery.sources import epub_format as E

    return E.metadata(data)


def _mobi_chapters(data: bytes) -> list[tuple[str | None, str]]:
    """Chapters as the table of contents' positions cut them; the whole as one if there are none."""
    from bindery.operators.html import parse_nodes
    from bindery.sources import mobi_format as M

    book = M.read_headers(data)
    content = M.text(book)
    html = content.decode(book.codec, "replace")
    nodes = parse_nodes(html) if "filepos" in html.lower() else []
    positions = [int(r[4]["filepos"]) for r in nodes if r[3] == "a" and r[4].get("filepos", "").isdigit()]
    return [(None, c.decode(book.codec, "replace")) for c in M.split_chapters(content, positions)]


def _epub_chapters(data: bytes) -> list[tuple[str | None, str]]:
    from bindery.sources import epub_format as E

    return [(label, html) for label, _, html in E.chapters(data)]


def _mobi_images(data: bytes) -> list[bytes]:
    from bindery.sources import mobi_format as M

    return M.images(M.read_headers(data))


def _epub_images(data: bytes) -> list[bytes]:
    from bindery.sources import epub_format as E

    return [c for _, _, c in E.images(data)]


#: Readers by extension: metadata, chapters, images. Add to it to read another format.
READERS: dict[str, tuple[Callable, Callable, Callable]] = {
    **{x: (_mobi_metadata, _mobi_chapters, _mobi_images) for x in NATIVE},
    ".epub": (_epub_metadata, _epub_chapters, _epub_images),
}


def _read(files: DataFrame, which: int, schema: str, rows: Callable) -> DataFrame:
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content):
                found = re.search(r"(\.[^./\\]+)$", path)
                reader = READERS.get(found[1] if found else "")
                try:
                    if reader is None:
                        raise NotImplementedError(f"no reader for {found[1] if found else 'a file without extension'}")
                    out += [(path, *r, None) for r in rows(reader[which](bytes(content)))]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file is that file's error
                    out.append((path, *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=columns)
            for c in ("chapter_no", "image_no"):
                if c in frame:
                    frame[c] = frame[c].astype("Int32")
            yield frame

    return files.select("path", "content").mapInPandas(run, schema)


def book_metadata(files: DataFrame) -> DataFrame:
    from decimal import Decimal

    keys = ["title", "author", "contributor", "publisher", "description", "language", "rights", "isbn", "subject", "pub_date"]
    return _read(files, 0, METADATA, lambda m: [tuple(Decimal(m[k]) if k == "isbn" else m[k] for k in keys)])


def books(files: DataFrame) -> DataFrame:
    """Readable files as rows of a catalog without ids; dates that can't be read are null."""
    good = book_metadata(files).where("error is null")
    return good.select(
        F.col("path").alias("file_path"), "title", "language", "isbn", "author", "contributor", "publisher", "subject", "description", S.parse_date(F.col("pub_date")).alias("pub_date"),
        "rights", F.lit("").alias("series"), F.lit(None).cast("float").alias("series_num"),
    )


def book_chapters(files: DataFrame) -> DataFrame:
    return _read(files, 1, CHAPTERS, lambda parts: [(i, label, html) for i, (label, html) in enumerate(parts)])


def book_images(files: DataFrame) -> DataFrame:
    return _read(files, 2, IMAGES, lambda pictures: list(enumerate(pictures)))


def book_records(files: DataFrame) -> DataFrame:
    """The record table of MOBI files: (path, rec_no, offset, length)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bindery.sources import mobi_format as M

        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content):
                try:
                    book = M.read_headers(bytes(content))
                    ends = [*book.offsets[1:], len(content)]
                    out += [(path, i, a, b - a, None) for i, (a, b) in enumerate(zip(book.offsets, ends))]
                except ValueError as e:
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "rec_no", "offset", "length", "error"]).astype({"rec_no": "Int32", "offset": "Int64", "length": "Int64"})

    return files.select("path", "content").mapInPandas(run, RECORDS)


HEADERS, EXTH_ROWS = "path string, field string, value long, error string", "path string, type int, value binary, error string"


def _mobi_rows(files: DataFrame, schema: str, rows: Callable) -> DataFrame:
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bindery.sources import mobi_format as M

        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content):
                try:
                    out += [(path, *r, None) for r in rows(M.read_headers(bytes(content)))]
                except ValueError as e:
                    out.append((path, None, None, str(e)))
            table = pd.DataFrame(out, columns=columns)
            for c, kind in (("type", "Int32"), ("value", "Int64")):
                if f"{c} {'int' if c == 'type' else 'long'}" in schema:
                    table[c] = table[c].astype(kind)
            yield table

    return files.select("path", "content").mapInPandas(run, schema)


def book_headers(files: DataFrame) -> DataFrame:
    """(path, field, value): the numbers in the PDB, PalmDOC and MOBI headers of MOBI files."""
    return _mobi_rows(files, HEADERS, lambda book: sorted(book.headers().items()))


def header_text(files: DataFrame) -> DataFrame:
    """(path, text): the headers of MOBI files to read, a line for each field."""
    line = F.concat(F.col("field"), F.lit(": "), F.col("value").cast("string"))
    return book_headers(files).where("error is null").groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))


def exth_records(files: DataFrame) -> DataFrame:
    """(path, type, value): the first EXTH record of each type."""
    return _mobi_rows(files, EXTH_ROWS, lambda book: sorted(book.exth.items()))


def stylesheets(files: DataFrame) -> DataFrame:
    """(path, css): an EPUB's sheets joined; blank for MOBI files of version 6 and before."""

    @F.pandas_udf("string")
    def css(paths: pd.Series, contents: pd.Series) -> pd.Series:
        from bindery.sources import epub_format as E

        return pd.Series([E.stylesheet(bytes(c)) if p.endswith(".epub") else "" for p, c in zip(paths, contents)])

    return files.select("path", css("path", "content").alias("css"))
