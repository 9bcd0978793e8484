"""Sensitive-data scan over a stream of files.

Every operator of the scan is a stateless column expression (line split,
length guard, regex spans), so the batch plan runs unchanged on
``readStream``: new files are scanned as they land, findings are appended.
No state, no watermark needed; the checkpoint location makes the query
restartable after a failure (exactly-once with file sinks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcframe.operators import sensitive as S

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stream_documents(spark: SparkSession, folder: str, glob: str = "*.parquet",
                     max_files: int | None = None) -> DataFrame:
    """``documents`` parquet files arriving in ``folder`` (those matching
    ``glob``) as a stream of ``source_files`` rows (same adapter as the
    batch host D); ``max_files`` limits a micro-batch."""
    d = spark.readStream.schema(DOC_SCHEMA).option("pathGlobFilter", glob)
    if max_files is not None:
        d = d.option("maxFilesPerTrigger", max_files)
    d = d.parquet(folder)
    return d.select(F.col("source").alias("repo_id"),
                    F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
                    F.lit("txt").alias("ext"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def stream_findings(files: DataFrame, patterns: list[S.Pattern]) -> DataFrame:
    """Findings of a streaming file table (append-only)."""
    return S.scan_files(files, patterns)


def start_findings_query(spark: SparkSession, folder: str, out: str, checkpoint: str,
                         patterns: list[S.Pattern] | None = None):
    """Start the streaming scan writing parquet findings partitioned by
    repository; returns the ``StreamingQuery``."""
    pats = S.validate_patterns(spark, patterns or S.flagship_catalog())
    f = stream_findings(stream_documents(spark, folder), pats)
    return (f.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .partitionBy("repo_id").outputMode("append").start())
