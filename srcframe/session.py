"""Spark session helpers.

Cluster jobs inherit their session; these helpers only fill in settings that
are unset (tests, local benchmarks).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # broadcast only below this many bytes (estimated by Catalyst / AQE)
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "srcframe") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("SRCFRAME_MASTER", "local[*]")
    b = SparkSession.builder.appName(app).master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("SRCFRAME_DRIVER_MEM", "10g"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if _single_machine(master):  # a local session has no shared folder: give it a scratch one
        b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="srcframe-ckpt-", dir="/tmp"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _single_machine(master: str) -> bool:
    """True for ``local`` and ``local[...]``; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in
    ``spark.checkpoint.dir``.  Only a session on one machine (tests) may leave it
    unset and gets a scratch folder; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not _single_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="srcframe-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


class Scratch:
    """Intermediate tables of one job, as Parquet under the shared folder.

    Writing and reading back cuts lineage and survives lost executors; ``drop``
    removes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/srcframe-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, table: str) -> str:
        """An empty shared folder for files that are not Parquet."""
        path = f"{self.path}/{table}"
        p, fs = self._fs(path)
        fs.mkdirs(p)
        return path

    def drop(self, *tables: str) -> None:
        for t in tables:
            p, fs = self._fs(f"{self.path}/{t}")
            fs.delete(p, True)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())
