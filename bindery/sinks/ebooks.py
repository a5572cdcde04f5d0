"""Books as files: MOBI and EPUB contents as a column, and file plans."""

from __future__ import annotations

import os
import shutil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(books: DataFrame, chapters: DataFrame, images: DataFrame | None = None, form: str = "mobi") -> DataFrame:
    """(id, content): the file of each book (id, title, author, ...) from chapters (id, chapter_no, title, html) and images (id, image_no, content).

    One book's chapters and images meet in one task, which builds its file. Books are as many as files, so they are
    never broadcast: Spark would judge their size by that of their compressed columns.
    """
    parts = chapters.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", "title", "html"))).alias("_chapters"))
    joined = parts.hint("merge").join(books.hint("merge"), "id")
    if images is not None:
        pictures = images.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("image_no", "content"))).alias("_images"))
        joined = joined.join(pictures.hint("merge"), "id", "left")
    else:
        joined = joined.withColumn("_images", F.lit(None).cast("array<struct<image_no:int,content:binary>>"))
    names = [c for c in books.columns]

    def run(frames):
        from bindery.sources import epub_format as E
        from bindery.sources import mobi_format as M

        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                book = {k: r[k] for k in names if r[k] is not None and not (isinstance(r[k], float) and r[k] != r[k])}
                book["subject"] = list(book["subject"]) if "subject" in book else None
                book["isbn"] = int(book["isbn"]) if book.get("isbn") else 0
                pictures = [bytes(x["content"]) for x in (r["_images"] if r["_images"] is not None else [])]
                parts = [(x["title"], x["html"]) for x in r["_chapters"]]
                data = M.write(book, [(t or "", h) for t, h in parts], pictures) if form == "mobi" else E.write(book, parts, pictures)
                out.append((r["id"], data))
            yield pd.DataFrame(out, columns=["id", "content"])

    return joined.mapInPandas(run, f"id {books.schema['id'].dataType.simpleString()}, content binary")


def with_metadata(files: DataFrame, updates: DataFrame) -> DataFrame:
    """``files`` (path, content) with the content's metadata changed by ``updates`` (path, title, author, publisher, isbn); (path, content, error)."""

    def run(frames):
        from bindery.sources import epub_format as E
        from bindery.sources import mobi_format as M

        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                book = {k: (None if r[k] is None or r[k] != r[k] else r[k]) for k in ("title", "author", "publisher", "isbn")}
                book["isbn"] = int(book["isbn"]) if book["isbn"] else None
                try:
                    write = E.rewrite_metadata if r["path"].endswith(".epub") else M.rewrite_metadata
                    out.append((r["path"], write(bytes(r["content"]), book), None))
                except ValueError as e:
                    out.append((r["path"], None, str(e)))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    return files.select("path", "content").join(updates.select("path", "title", "author", "publisher", "isbn").hint("merge"), "path").mapInPandas(run, "path string, content binary, error string")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """(path, size) of the files (path, content) written below ``root``, which all machines must see.

    Each goes to a name of its own first and is then renamed, so a task may run again.
    """

    def run(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content):
                to = os.path.join(root, path.lstrip("/\\"))
                if os.path.commonpath([os.path.realpath(root), os.path.realpath(to)]) != os.path.realpath(root):
                    raise ValueError(f"{path} leaves the folder")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                temporary = f"{to}.{os.getpid()}"
                with open(temporary, "wb") as f:
                    f.write(bytes(content))
                os.replace(temporary, to)
                out.append((path, len(content)))
            yield pd.DataFrame(out, columns=["path", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, size long")


def execute(plan: DataFrame, root: str) -> DataFrame:
    """(id, action, done, error): a plan (id, action move, copy or delete, src_path, dst_path) carried out below ``root``, a row for each step.

    A row comes as its step ends, so a reader sees progress. A step that was done before counts as done: tasks may run again.
    """

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                error = None
                try:
                    source, target = (os.path.join(root, p.lstrip("/\\")) if p else None for p in (r.src_path, r.dst_path))
                    for p in (source, target):
                        if p and os.path.commonpath([os.path.realpath(root), os.path.realpath(p)]) != os.path.realpath(root):
                            raise ValueError(f"{p} leaves the folder")
                    if r.action == "delete":
                        if os.path.exists(source):
                            os.remove(source)
                        clean_backward(os.path.dirname(source), root)
                    elif os.path.exists(source):
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        temporary = f"{target}.{os.getpid()}"
                        shutil.copyfile(source, temporary)
                        os.replace(temporary, target)
                        if r.action == "move":
                            os.remove(source)
                            clean_backward(os.path.dirname(source), root)
                    elif not os.path.exists(target):
                        raise FileNotFoundError(f"no file {r.src_path}")
                except (OSError, ValueError) as e:
                    error = str(e)
                yield pd.DataFrame([(str(r.id), r.action, error is None, error)], columns=["id", "action", "done", "error"])

    return plan.select("id", "action", "src_path", "dst_path").mapInPandas(run, "id string, action string, done boolean, error string")


def clean_backward(start: str, stop: str) -> None:
    """Removes empty folders from ``start`` up to, but without, ``stop``."""
    start, stop = os.path.realpath(start), os.path.realpath(stop)
    while start.startswith(stop + os.sep) and os.path.isdir(start) and not os.listdir(start):
        os.rmdir(start)
        start = os.path.dirname(start)


def clean_forward(root: str) -> None:
    """Removes all empty folders below ``root``."""
    for folder, _, _ in os.walk(root, topdown=False):
        if folder != root and not os.listdir(folder):
            os.rmdir(folder)
