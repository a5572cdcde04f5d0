import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(tuple(v) if isinstance(v, list) or type(v).__name__ == "ndarray" else None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_matches_sql(spark, duck, name):
    assert canonical(entry.queries()[name](spark, SF).toPandas()) == canonical(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
