"""The streaming scan gives the same findings as the batch scan."""

import tempfile

from srcframe.operators import sensitive as S
from srcframe.plans.sensitive_q import q_custom_patterns
from srcframe.streaming.scan import stream_documents, stream_findings

from conftest import SF


def test_stream_equals_batch(spark):
    pats = S.validate_patterns(spark, S.flagship_catalog())
    files = stream_documents(spark, SF, glob="documents.parquet")
    q = (stream_findings(files, pats).writeStream.format("memory").queryName("stream_findings")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="srcframe-stream-", dir="/tmp"))
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT repo_id, path, line_no, column_no, finding_type, matched_text "
                                             "FROM stream_findings").collect())
    want = sorted(tuple(r) for r in q_custom_patterns(spark, SF).select(
        "repo_id", "path", "line_no", "column_no", "finding_type", "matched_text").collect())
    assert got == want
    assert len(got) > 0
