"""Every registered query with a SQL twin agrees with DuckDB at sf0.001
(rows, column names, values; order-insensitive)."""

import math

import pytest

import __spark_entry__ as E
from srcframe.plans import registry

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


registry.load_all()
ORACLE = registry.ORACLE  # the training-data queries have tests of their own


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql_twin(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    idx = {c: i for i, c in enumerate(rel.columns)}
    want = sorted((tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_every_query_has_a_twin_or_is_listed():
    rows_only = set(registry.QUERIES) - set(ORACLE)
    assert rows_only <= {"call_flow_cyclic"}, rows_only


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"repo_id", "path", "line_no", "column_no", "finding_type", "matched_text"}
    assert df.count() >= 0
