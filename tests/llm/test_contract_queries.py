"""The contract queries that SQL can express, against it; and that all are registered."""

import __spark_entry__
import duckdb
import pytest

from pagelens.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES} and set(QUERIES) < set(names) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    q = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in q.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    want = sorted(q.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-3)
