from bindery.operators import html as H
from bindery.plans import books as books_plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_by_document_are_not_broadcast(spark):
    docs = spark.createDataFrame([("1", '<p id="a">x</p><b id="a">y</b><mbp:pagebreak/><a id="k" href="#a">go</a><img src="i/p.jpg"><a href="2#q">z</a>'), ("2", '<i>n</i><i id="q">m</i>'), ("3", None)], "doc_id string, html string")
    names = spark.createDataFrame([("1", "OPS/p.jpg", 7)], "doc_id string, name string, ord int")
    back, nodes = H.process_html(docs, "doc_id", "html", names), H.html_nodes(docs, "doc_id", "html")
    assert {r.doc_id: r.html for r in back.collect()} == {
        "1": '<p id="0000000001">x</p><b id="0000000001">y</b><a href="#0000000001" id="0000000003">go</a><img src="00007.jpg"><a href="#0000000001">z</a>', "2": '<i>n</i><i id="0000000001">m</i>', "3": None,
    }
    assert not any("BroadcastHashJoin" in _plan(x) for x in (back, H.resolve_filepos(nodes), H.image_names(nodes, names)))


def test_pages_are_dealt_out(spark):
    pages = books_plan._pages(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    assert "RoundRobinPartitioning" in _plan(pages)
