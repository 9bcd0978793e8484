"""What the Java facts write, send to the driver and shuffle."""

import pyarrow as pa
from pyspark.sql import functions as F

from srcframe.operators import facts as B
from srcframe.operators import soap as P
from srcframe.operators import tokens as K

IMPL = '@WebService(endpointInterface = "p.Port") public class Svc { int a; @WebMethod public int one(int x) { g(x); return h(this.a); } }'
PORT = '@WebService public interface Port { @WebMethod(operationName = "uno") int one(int x); }'


def _files(spark, n=12):
    rows = [("r", f"m{k}/p/{name}.java", f"package p;\n{text}") for k in range(n) for name, text in (("Svc", IMPL), ("Port", PORT))]
    return spark.createDataFrame(rows, "repo_id string, path string, content string")


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_facts_are_not_broadcast(spark):
    """Estimates of written facts are far below their size in memory (F1-F3, F5-F7: the driver's memory)."""
    fx = B.java_facts(_files(spark))
    overlay, bodies = P.sei_overlay(fx.classes), B.method_bodies(fx.methods, fx.texts)
    for df in (overlay, P.sei_method_merge(P.overlay_of(fx), fx.methods), bodies, P.wsdl_bean_defs(fx),
               B.extract_fields(B.java_members(fx.groups), fx.types, fx.texts)):
        assert "Join" in _plan(df) and "Broadcast" not in _plan(df)
    assert P.merged_methods(fx).count() == 24


def test_only_text_is_shuffled_for_members_and_calls(spark):
    fx = B.java_facts(_files(spark))
    plan = B.java_groups(fx._files, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert fx.calls.count() == 24
    assert "tokens" not in fx._t and "members" not in fx._t


def test_members_of_a_file_that_comes_twice_come_twice(spark):
    """As in a join with the files; the tokens of both lie side by side."""
    files = _files(spark, 1)
    key = ["path", "own", "m", "typed", "in_type"]
    once = B.java_members(B.java_groups(files, 2)).groupBy(*key).count().collect()
    again = B.java_members(B.java_groups(files.unionByName(files), 2)).groupBy(*key).count().collect()
    assert {r["count"] for r in once} == {1} and {r["count"] for r in again} == {2}


def test_files_stay_whole_over_batches():
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (4, "f"), (4, "g")]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pylist([{"fa": f, "fb": 0, "x": x} for f, x in rows[k:k + size]]) for k in range(0, len(rows), size)]
        got = [[r["fa"] for r in t.to_pylist()] for t in K.whole_files(iter(batches))]
        assert [f for t in got for f in t] == [f for f, _ in rows]
        assert not any(a[-1] == b[0] for a, b in zip(got, got[1:]))


def test_a_body_is_masked_as_in_its_file(spark):
    text = 'class A { void f() { String s = "a{}"; /* } */ char c = \'}\'; // }\n g("x"); } /* " */ void h() { k(\'"\'); } }'
    files = spark.createDataFrame([("r", "A.java", text)], "repo_id string, path string, content string")
    fx = B.java_facts(files)
    whole = fx.files.first()["masked"]
    rows = fx.bodies.select("body_offset", "body_masked").collect()
    assert len(rows) == 2
    for r in rows:
        assert whole[r["body_offset"] - 1:][:len(r["body_masked"])] == r["body_masked"]
