"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from cairnspark.queries import all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Those that take several rounds of jobs are covered by the fixtures of test_graph.py as well.
QUERIES = all_queries()


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "NULL" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    run, sql = QUERIES[name]
    got = run(spark, sf).toPandas()
    if sql is None:
        assert len(got)
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
