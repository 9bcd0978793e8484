"""What the Java facts compute and hold does not grow faster than the corpus."""

from pyspark.sql import functions as F

from srcframe.operators import facts as B


def test_expressions_are_bound_once(spark, capsys):
    """A part of an expression that stands in it many times is computed as often, in a
    lambda for every token: each pattern over a parameter stands in the plan once."""
    tokens = spark.createDataFrame([], "toks array<struct<t string, pos int, len int, gap boolean, inner_p int, g int>>")
    tokens.select(B.parameters(F.col("toks"))).explain()
    assert capsys.readouterr().out.count("regexp_extract") <= 12


def test_shuffles_follow_the_corpus(spark, monkeypatch):
    files = spark.createDataFrame(
        [("r", f"p/C{k}.java", f"package p; class C{k} {{ int a; void f(int x) {{ g(x); h(x, this.a); }} }}") for k in range(40)],
        "repo_id string, path string, content string")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    columns = ["path", "ordinal", "callee_sig"]
    rows = sorted(map(tuple, B.java_facts(files).calls.select(columns).collect()))
    assert spark.conf.get(key) == before
    monkeypatch.setattr(B, "PART_CHARS", 32)
    try:
        again = sorted(map(tuple, B.java_facts(files).calls.select(columns).collect()))
        assert int(spark.conf.get(key)) > int(before)
    finally:
        spark.conf.set(key, before)
    assert rows == again and len(rows) == 80
