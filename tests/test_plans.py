"""Plan tests: the scan stays JVM-side and map-only; sinks write per
repository."""

import os
import tempfile

from conftest import SF
from srcframe.operators import sensitive as S
from srcframe.plans.sensitive_q import doc_lines
from srcframe.sources.adapters import documents_files
from srcframe.sources.files import write_tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_has_no_python_and_no_exchange_after_explode(spark):
    pats = S.validate_patterns(spark, S.flagship_catalog())
    plan = _plan(S.scan_lines(doc_lines(spark, SF), pats))
    assert "Python" not in plan and "ArrowEval" not in plan and "BatchEval" not in plan
    assert "Exchange" not in plan


def test_counts_aggregate_partially_before_the_shuffle(spark):
    pats = S.validate_patterns(spark, S.flagship_catalog())
    plan = _plan(S.finding_counts(S.scan_lines(doc_lines(spark, SF), pats).select(
        "repo_id", "path", "line_no", "column_no", "finding_type", "matched_text")))
    assert plan.count("HashAggregate") >= 2


def test_write_tables_partitions_by_repository(spark):
    out = tempfile.mkdtemp(prefix="srcframe-out-", dir="/tmp")
    files = documents_files(spark, SF).select("repo_id", "path", "size")
    write_tables({"files": files}, out)
    parts = [d for d in os.listdir(os.path.join(out, "files")) if d.startswith("repo_id=")]
    assert len(parts) == files.select("repo_id").distinct().count()
    back = spark.read.parquet(os.path.join(out, "files"))
    assert back.count() == files.count()
