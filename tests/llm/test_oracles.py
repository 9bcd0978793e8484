"""Queries with a SQL twin agree with DuckDB on whole tables."""

import duckdb
import pytest

import __spark_entry__ as E
from srcframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))


def test_every_query_is_registered():
    names = E.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) <= set(names)
