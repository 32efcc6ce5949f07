"""Every query with SQL gives the same rows as that SQL; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
#: These have tests of their own in tests/llm.
ENGINE = [q for q in QUERIES if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        p += "/*.parquet" if os.path.isdir(p) else ""
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else x if x is None else str(x)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", ENGINE)
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    made = con.execute(SQL[name])
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(got, df.columns) == plain(made.fetchall(), columns)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
