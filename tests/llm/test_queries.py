import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    got = df.collect()
    table = "pages" if name in ("op2_wrapper_induction", "op4_warc_revisits") else "documents"
    assert len(got) >= spark.read.parquet(f"{D}/{table}.parquet").count()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{D}/{table}.parquet')")
        made = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in made.description]
        assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, made.fetchall()))
