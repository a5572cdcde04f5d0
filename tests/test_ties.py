from bindery.plans import catalog


def test_spine_labels_of_equal_lines(spark, tmp_path):
    # two labels at one line of one source, far apart in the file: the first in the file holds
    spark.sql("SELECT id AS l_orderkey, id % 2 AS l_partkey, 2 * (500 - id) AS l_suppkey, 1 AS l_linenumber FROM range(500)").selectExpr("l_orderkey % 50 AS l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT id AS p_partkey, 'one' AS p_name FROM range(2)").write.parquet(str(tmp_path / "part.parquet"))
    spark.sql("SELECT id AS s_suppkey, 's' || id AS s_name FROM range(1001)").write.parquet(str(tmp_path / "supplier.parquet"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.book_id: r.label for r in catalog.QUERIES["spine_labels"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == {k: f"s{2 * (500 - k)}" for k in range(50)}
