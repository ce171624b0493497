"""Every query with SQL gives what DuckDB gives, on the smallest tables; the others run."""

import duckdb
import pytest
from factloom import catalog_queries, source_queries  # noqa: F401
from factloom import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(repr([float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, duck, name):
    df, want = Q.QUERIES[name](spark, SF), duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    assert plain(df.collect(), df.columns, names) == plain(want.fetchall(), want.columns, names)


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.ORACLES.keys()))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
