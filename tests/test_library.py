import datetime as dt
import struct
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bindery.functions import binary as B
from bindery.functions import scalars as S
from bindery.operators import chapters as C
from bindery.operators import html as H
from bindery.operators import reconcile as R
from bindery.operators.catalog import IdNotFound, Library
from bindery.sinks import ebooks as sink
from bindery.sources import ebooks, epub_format, mobi_format


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ints(*values):
    return F.array(*map(F.lit, values))


def cases():
    return [
        (S.last(ints(5, 8, 2)), 2),
        (S.insert_after(ints(5, 8, 2, 7), 1, ints(0, 0)), [5, 8, 0, 0, 2, 7]),
        (S.append(ints(5), ints(8, 2)), [5, 8, 2]),
        (S.append_item(ints(5), F.lit(8)), [5, 8]),
        (S.sub_array(ints(5, 8, 2, 7), 1, 2), [8, 2]),
        (S.sub_array(ints(5, 8, 2, 7), 1), [8, 2, 7]),
        (S.replace_at(ints(5, 8, 2, 7), ints(0), 2), [5, 8, 0, 7]),
        (S.total_length(F.array(ints(5, 8), ints(2))), 3),
        (S.truncate("bookbinder", 4), "book"),
        (S.decode_utf8(F.unhex(F.lit("6B6F"))), "ko"),
        (S.byte_char(107), "k"),
        (S.base32("0A5"), Decimal(325)),
        (S.base32(""), None),
        (S.base32("W"), None),
        (S.big_endian(F.unhex(F.lit("FE10")), 0, 2, signed=True), Decimal(-496)),
        (S.big_endian(F.unhex(F.lit("FE10")), 0, 2), Decimal(65040)),
        (S.big_endian(F.unhex(F.lit("80000001")), 0, 4, signed=True), Decimal(-2147483647)),
        (S.big_endian(F.unhex(F.lit("80000001")), 0, 4), Decimal(2147483649)),
        (S.big_endian(F.unhex(F.lit("8000000000000001")), 0, 8), Decimal(9223372036854775809)),
        (S.big_endian(F.unhex(F.lit("FF")), 0, 2), None),
        (S.big_endian_bytes(F.lit(-2147483647), 4), bytearray.fromhex("80000001")),
        (S.big_endian_bytes(F.lit(65040), 2), bytearray.fromhex("FE10")),
        (S.filesystem_safe(r"D:\shelf\Who?Wrote::\It<Now>.azw3"), r"D:\shelf\Who_Wrote_\It_Now_.azw3"),
        (S.sort_author("Jane Roe"), "Roe, Jane"),
        (S.sort_author("Mary Q. Public"), "Public, Mary Q."),
        (S.sort_author("Plato"), "Plato"),
        (S.normalize_date("1987-06-05"), "6/5/1987"),
        (S.normalize_date("1987"), "1/1/1987"),
        (S.normalize_date("nonsense"), None),
        (S.normalize_date("", today=dt.date(2020, 1, 2)), "01/02/2020"),
        (S.iso_date("11/30/1987"), "1987-11-30"),
        (S.mobi_timestamp(F.lit("1904-01-03").cast("timestamp")), 172800),
        (S.bit_count(90), 4),
        (S.dict_format("{who} keeps {what} and {unknown}", {"who": "Ann", "what": "bees"}), "Ann keeps bees and {unknown}"),
        (S.dict_format("a [{x}] b", {"x": ""}), "a  b"),
        (S.map_get(F.create_map(F.lit("k"), F.lit(7)), "k"), 7),
        (S.map_get(F.create_map(F.lit("k"), F.lit(7)), "q"), None),
        (S.float_to_text(F.lit(0.0)), ""),
        (S.text_to_float("1.5"), 1.5),
        (S.text_to_float("1x"), None),
        (S.split_subjects("a, b"), ["a", "b"]),
        (S.extension("a.b/c.MOBI"), ".MOBI"),
        (S.basename("a/b/c.x"), "c.x"),
        (S.change_extension("a/b.epub", ".mobi"), "a/b.mobi"),
        (S.relative_path("/root/lib/a/b", "/root/lib"), "a/b"),
    ]


def test_scalars(spark):
    wanted = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(wanted)]).first()
    for i, (column, expected) in enumerate(wanted):
        assert row[i] == expected, column


def test_strict_dates_raise(spark):
    with pytest.raises(Exception, match="not a date"):
        one(spark, S.normalize_date("nonsense", strict=True))


def test_vwi():
    data = bytes.fromhex("8A810203")
    assert B.decode_vwi(data, False) == (16643, 3) and B.decode_vwi(data) == (10, 1)
    assert B.encode_vwi(16643, False) == bytes.fromhex("810203") and B.encode_vwi(16643) == bytes.fromhex("010283")


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=4096), st.text(alphabet="ab cé", max_size=3000).map(str.encode)))
def test_palmdoc(data):
    assert B.palmdoc_decompress(B.palmdoc_compress(data)) == data


@given(st.integers(0, 2**27), st.booleans())
def test_vwi_round_trip(n, forward):
    assert B.decode_vwi(B.encode_vwi(n, forward), forward)[0] == n


def test_trailers():
    assert B.trim_trailing(b"text" + b"xx\x83", 1, False) == b"text"
    assert B.trim_trailing(b"text\x00", 0, True) == b"text"


def test_huff_cdic():
    # eight-bit codes for two phrases, of which the second is itself compressed
    huff = b"HUFF\0\0\0\x18" + struct.pack(">LL", 24, 24 + 1024) + b"\0" * 8
    huff += struct.pack(">256L", *[(1 << 8 | 0x80 | 8) if b < 2 else 0x80 | 8 for b in range(256)]) + struct.pack(">64L", *[0] * 64)
    entries = [b"\x80\x02ab", b"\x00\x02\x01\x01"]  # code 1 gives phrase 0, code 0 gives phrase 1
    cdic = b"CDIC\0\0\0\x10" + struct.pack(">LL", 2, 1) + struct.pack(">HH", 4, 8) + b"".join(entries)
    book = B.HuffCdic(huff, [cdic])
    assert book.decompress(b"\x01") == b"ab"
    assert book.decompress(b"\x00\x01") == b"ababab"


BOOK = {"id": 7, "title": "Père & Fils", "author": "Ursula K. LeGuin", "publisher": "P", "description": "d", "language": "fr", "isbn": 9780123456786, "subject": ["a", "b"], "pub_date": "1999-12-31"}


def test_mobi_round_trip():
    chapters = [("One", "<p>" + "eins " * 2000 + "</p>"), ("Two", "<p>é</p>")]
    data = mobi_format.write(BOOK, chapters, [b"\xff\xd8picture", b"\xff\xd8other"])
    book = mobi_format.read_headers(data)
    meta = mobi_format.metadata(book)
    assert {k: meta[k] for k in ("title", "author", "publisher", "isbn", "subject", "pub_date", "language")} == {k: BOOK[k] for k in ("title", "author", "publisher", "isbn", "subject", "pub_date", "language")}
    assert mobi_format.text(book).decode() == "<html><head></head><body>" + "".join(h for _, h in chapters) + "</body></html>"
    assert mobi_format.images(book) == [b"\xff\xd8picture", b"\xff\xd8other"]
    changed = mobi_format.read_headers(mobi_format.rewrite_metadata(data, {"title": "New"}))
    assert mobi_format.metadata(changed)["title"] == "New" and mobi_format.text(changed) == mobi_format.text(book)
    with pytest.raises(mobi_format.MobiError):
        mobi_format.read_headers(data[:50])


def test_epub_round_trip():
    data = epub_format.write(BOOK, [("One", "<html><body>1</body></html>"), (None, "<html><body>2</body></html>")], [b"\xff\xd8x"], "p{a:b}")
    meta = epub_format.metadata(data)
    assert meta == {**{k: v for k, v in BOOK.items() if k != "id"}, "contributor": "", "rights": ""}
    assert [(a, h[12:13]) for a, _, h in epub_format.chapters(data)] == [("One", "1"), (None, "2")]
    assert epub_format.images(data)[0][2] == b"\xff\xd8x" and epub_format.stylesheet(data) == "p{a:b}"
    assert epub_format.metadata(epub_format.rewrite_metadata(data, {"title": "N", "isbn": 9780123456786}))["title"] == "N"
    with pytest.raises(epub_format.EpubError):
        epub_format.metadata(b"no zip")


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.mobi").write_bytes(mobi_format.write(BOOK, [("One", "<p>1</p>")]))
    (tmp_path / "sub" / "b.epub").write_bytes(epub_format.write({**BOOK, "title": "E"}, [("One", "<p>1</p>"), (None, "<p>2</p>")]))
    (tmp_path / "sub" / "bad.mobi").write_bytes(b"x" * 200)
    (tmp_path / "sub" / "c.txt").write_bytes(b"x")
    (tmp_path / "sub" / "d.MOBI").write_bytes(b"x")
    return str(tmp_path)


def test_readers(spark, shelf):
    files = ebooks.scan(spark, shelf)
    assert files.count() == 3 and ebooks.scan(spark, shelf, subdirectories_only=True).count() == 2
    found = {r.path.rsplit("/")[-1]: r for r in ebooks.book_metadata(files).collect()}
    assert found["a.mobi"].title == BOOK["title"] and found["b.epub"].isbn == BOOK["isbn"] and found["bad.mobi"].error
    assert sorted((r.title, r.pub_date) for r in ebooks.books(files).collect()) == [("E", dt.date(1999, 12, 31)), ("Père & Fils", dt.date(1999, 12, 31))]
    chapters = ebooks.book_chapters(files).where("error is null").orderBy("path", "chapter_no").collect()
    assert [(r.chapter_no, r.title) for r in chapters] == [(0, None), (0, "One"), (1, None)]
    records = ebooks.book_records(files.where("path like '%a.mobi'")).agg(F.sum("length"), F.min("offset")).first()
    assert records[0] + records[1] == files.where("path like '%a.mobi'").first().length


def test_writers(spark, shelf, tmp_path):
    books = ebooks.books(ebooks.scan(spark, shelf)).withColumn("id", F.when(F.col("title") == "E", 1).otherwise(2))
    chapters = spark.createDataFrame([(1, 0, "A", "<p>x</p>"), (1, 1, "B", "<p>y</p>"), (2, 0, "C", "<p>z</p>")], "id int, chapter_no int, title string, html string")
    for form, count in (("mobi", 2), ("epub", 2)):
        files = sink.build(books, chapters, form=form).select(F.concat(F.lit("new/"), "id", F.lit("." + form)).alias("path"), "content")
        assert sink.write_files(files, str(tmp_path / form)).count() == count
        assert ebooks.books(ebooks.scan(spark, str(tmp_path / form))).where("author like 'Ursula%'").count() == count
    (tmp_path / "mobi" / "empty" / "deep").mkdir(parents=True)
    sink.clean_forward(str(tmp_path / "mobi"))
    assert not (tmp_path / "mobi" / "empty").exists() and (tmp_path / "mobi" / "new").exists()


def test_catalog(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    assert library.first_use and not Library(spark, str(tmp_path / "lib")).first_use
    blank = library.books()
    new = spark.createDataFrame([(0, "b", "B"), (0, "a", "A"), (9, "c", "C")], "id int, file_path string, title string")
    wide = lambda df: df.unionByName(blank.limit(0), allowMissingColumns=True)
    assert library.insert(wide(new), dt.date(2020, 1, 1)).count() == 0
    assert [(r.id, r.title) for r in library.books().orderBy("id").collect()] == [(1, "A"), (2, "B"), (9, "C")]
    assert [r.id for r in library.insert(wide(spark.createDataFrame([(9, "d", "D")], "id int, file_path string, title string"))).collect()] == [9]
    library.update(library.find(1).withColumn("title", F.lit("A2")))
    with pytest.raises(IdNotFound):
        library.update(library.find(1).withColumn("id", F.lit(77)))
    library.rekey(spark.createDataFrame([(2, 20)], "id int, new_id int"))
    library.remove(spark.createDataFrame([(9,)], "id int"))
    assert [(r.id, r.title) for r in library.books().orderBy("id").collect()] == [(1, "A2"), (20, "B")]
    library.drop()
    assert library.books().count() == 0 and library.meta()["last_used_id"] == 2


def test_reconcile_edges(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id int, v string")
    assert sorted(map(tuple, R.combined_library(a, b).collect())) == [(1, "x", True, False), (2, None, True, True), (3, "z", False, True)]
    assert R.merge_libraries(a, None).count() == 2 and R.sync_plan(a.limit(0), b).count() == 0
    assert sorted(str(r[0]) for r in R.distinct_values(a, "v").collect()) == ["None", "x"]


def test_toc_edges(spark):
    look = spark.createDataFrame([(1, 0), (1, 5), (1, 99), (1, 5)], "doc int, pos int")
    elements = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 9, "c")], "doc int, at int, name string")
    got = C.toc_asof(look, elements, "doc", "pos", "at", ["name"]).orderBy("pos").collect()
    assert [(r.pos, r.name) for r in got] == [(0, "a"), (5, "b")]


def test_fold_and_chunks(spark):
    parts = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "T", "b"), (1, 2, None, "c")], "doc int, n int, name string, html string")
    assert [(r.chapter_no, r.name, r.html) for r in C.fold_unnamed(parts, "doc", "n", "name", "html").orderBy("chapter_no").collect()] == [(1, "Begin Reading", "a"), (2, "T", "bc")]
    data = spark.createDataFrame([(b"x" * 5000,), (b"",)], "data binary")
    assert [len(r.chunk) for r in C.chunk_rows(data, "data").collect()] == [4096, 904]


def test_html(spark):
    docs = spark.createDataFrame([("1", "<p class='a b' id=x>é<a href='#x'>t</a></p><img src=q/i.jpg>")], "id string, html string")
    nodes = H.html_nodes(docs, "id", "html").cache()
    assert [(r.tag, r.byte_pos) for r in nodes.orderBy("node_no").collect()] == [("p", 0), ("a", 22), ("img", 44)]
    assert {r.selector for r in H.candidate_selectors(nodes).where("node_no = 0").collect()} == {"p", "p#x", "#x", "p.a", ".a", "p.b", ".b"}
    links = H.anchors(nodes).select("doc_id", "node_no", "href")
    assert H.rewrite_links(links, H.numbered_ids(nodes)).first().new_href == "#0000000001"
    assert H.resolve_filepos(nodes).first().filepos == "0000000000"
    rules = spark.createDataFrame([("1", 0, "p", 0, "c", "1"), ("1", 1, ".a", 0, "c", "2"), ("1", 2, "#z", 0, "c", "3")], "doc_id string, rule_no int, selector string, prop_no int, property string, value string")
    assert [tuple(r) for r in H.apply_styles(nodes, rules).collect()] == [("1", 0, "c", "2")]
    names = spark.createDataFrame([("1", "img/i.jpg", 7), ("2", "other/i.jpg", 3)], "doc_id string, name string, ord int")
    assert H.image_names(nodes, names).first().new_src == "00007.jpg"
    two = H.builder_attributes(H.html_nodes(docs.unionByName(docs.selectExpr("'2' AS id", "html")), "id", "html"), names.selectExpr("doc_id", "'q/i.jpg' AS name", "ord")).where("tag = 'img'")
    assert {r.doc_id: r.attrs["recindex"] for r in two.collect()} == {"1": "00007", "2": "00003"}
    H.register(spark)
    docs.createOrReplaceTempView("docs")
    assert spark.sql("SELECT n.tag FROM docs, LATERAL html_nodes(html) n").count() == 3


def test_plans_and_settings(spark, tmp_path):
    from bindery import config

    books = spark.createDataFrame([(1, "a.mobi", "A"), (2, "b.epub", "B")], "id int, path string, title string")
    none = spark.createDataFrame([], "id int, path string")
    plan = R.transfer_plan(books, books.where("id = 1"), none, none)
    assert [(r.id, r.action) for r in plan.collect()] == [(1, "copy")]
    files = spark.createDataFrame([("a.mobi",), ("n.epub",), ("x.pdf",)], "path string")
    good, errors = R.bulk_import_plan(files, books)
    assert [(r.path, r.action) for r in good.collect()] == [("n.epub", "convert")] and R.error_summary(errors).count() == 2
    rows, moves = R.update_metadata_plan(books, spark.createDataFrame([(1, "Z")], "id int, title string"), ["title"], F.concat("title", F.lit(".mobi")), "path")
    assert [r.title for r in rows.collect()] == ["Z"] and [(r.src_path, r.dst_path) for r in moves.collect()] == [("a.mobi", "Z.mobi")]
    gone, errors = R.delete_plan(books, spark.createDataFrame([(1,), (9,)], "id int"), "path")
    assert [r.src_path for r in gone.collect()] == ["a.mobi"] and [r["item"] for r in errors.collect()] == ["9"]
    path = str(tmp_path / "c.json")
    settings = config.read(path, config.LibrarySettings)
    assert config.save_hidden_columns(path, settings, ["isbn"]) and not config.save_hidden_columns(path, settings, ["isbn"])
    assert config.read(path, config.LibrarySettings).hidden_columns == ["isbn"]
    assert config.needs_reorganizing(config.DeviceSettings(), config.DeviceSettings("{Title}"))
    names = C.renumber(books, None, "title", width=3).orderBy("id").collect()
    assert [r.new_id for r in names] == ["001", "002"]


def test_suffixes_of_any_length(spark):
    names = spark.createDataFrame([("b" * 400 + "x", 1), ("y", 2)], "name string, n int")
    suffixes = spark.createDataFrame([("b" * 300 + "x",), ("",), ("z",)], "suffix string")
    got = {r.suffix: r.name for r in C.suffix_match(names, suffixes, "name", "suffix", "n").collect()}
    assert got == {"b" * 300 + "x": "b" * 400 + "x", "": "b" * 400 + "x", "z": None}


def test_html_written_back():
    source = '<p id=a>é &amp; <img src="x.jpg"/><b>k</b></p><hr>'
    assert H.put_attributes(source, {1: {"src": 'n"1.jpg'}}, {3}) == '<p id=a>é &amp; <img src="n&quot;1.jpg" /><b>k</b></p>'
    assert H.put_attributes(source, {}) == source


def test_headers():
    book = mobi_format.read_headers(mobi_format.write({"title": "T", "id": 5}, [("c", "<p>x</p>")]))
    assert {k: book.headers()[k] for k in ("compression", "record_size", "unique_id", "has_exth", "has_drm", "exth_records")} == {"compression": 2, "record_size": 4096, "unique_id": 5, "has_exth": 1, "has_drm": 0, "exth_records": 1}


def test_plans_are_carried_out(spark, tmp_path):
    for name in ("a/x.mobi", "a/y.mobi", "b/z.mobi"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    steps = [(1, "move", "a/x.mobi", "c/x.mobi"), (2, "copy", "a/y.mobi", "c/y.mobi"), (3, "delete", "b/z.mobi", None), (4, "move", "no.mobi", "c/no.mobi"), (5, "copy", "a/y.mobi", "../out.mobi")]
    plan = spark.createDataFrame(steps, "id int, action string, src_path string, dst_path string")
    for _ in range(2):  # a step that was done stays done
        done = {r.id: r.done for r in sink.execute(plan, str(tmp_path)).collect()}
        assert done == {"1": True, "2": True, "3": True, "4": False, "5": False}
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*")) == ["a", "a/y.mobi", "c", "c/x.mobi", "c/y.mobi"]
