"""Token runs (operators/tokens.py): whole files, partitions by size, no window per depth."""

import pyarrow as pa
from pyspark.sql import functions as F

from srcframe.operators import facts as B
from srcframe.operators import tokens as K


def _files(spark, n, text="class A { void f(int a) { g(a); } }"):
    return spark.range(n).select(F.lit("r").alias("repo_id"), F.concat(F.lit("p"), "id", F.lit(".java")).alias("path"),
                                 F.lit(text).alias("content"))


def test_partitions_follow_the_text_not_the_session(spark, monkeypatch):
    assert B.parts_of(_files(spark, 3)) == 4
    monkeypatch.setattr(B, "PART_CHARS", 100)
    files = _files(spark, 40)
    assert B.parts_of(files) == 14
    fx = B.JavaFacts(files)
    assert fx.tokens.rdd.getNumPartitions() == 14
    assert fx.members.rdd.getNumPartitions() == 14
    assert fx.methods.count() == 40


def test_tokens_need_no_window(spark):
    plan = B.java_tokens(_files(spark, 3), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_run_holds_whole_files(monkeypatch):
    monkeypatch.setattr(K, "RUN", 5)
    rows = [(f, i) for f, n in ((1, 2), (2, 9), (3, 1), (4, 4), (4, 3)) for i in range(n)]
    batches = [pa.RecordBatch.from_pylist([{"fa": f, "fb": 0, "i": i} for f, i in rows[k:k + 3]]) for k in range(0, len(rows), 3)]
    runs = [t.to_pylist() for t in K.runs_of_files(iter(batches))]
    assert [(r["fa"], r["i"]) for t in runs for r in t] == rows
    for a, b in zip(runs, runs[1:]):
        assert a[-1]["fa"] != b[0]["fa"]
    assert [len(t) for t in runs] == [11, 8]


def test_files_of_one_run_do_not_mix(spark):
    texts = ["class A { void f() { g(", "} ) ]", "class B { int x = h(1, 2); List<Map<String, A>> y; void k() { m(); } }", ""]
    files = spark.createDataFrame([("r", f"p{i}.java", t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    both = {(r.fa, r.fb, r.i): r for r in B.java_tokens(files, 1).collect()}
    alone = [r for i in range(len(texts)) for r in B.java_tokens(files.where(F.col("path") == f"p{i}.java"), 1).collect()]
    assert len(both) == len(alone)
    assert all(both[r.fa, r.fb, r.i] == r for r in alone)
    fields = B.JavaFacts(files).fields.select("name", "declared_type").collect()
    assert sorted(map(tuple, fields)) == [("x", "int"), ("y", "List<Map<String, A>>")]
