"""H9 against a plain breadth-first walk, with more entries than one number has bits."""

import random

import pytest

from srcframe.operators import walks
from srcframe.operators.callgraph import reachable


@pytest.mark.parametrize("max_depth", [None, 2])
def test_reachable_equals_a_walk(spark, max_depth):
    rnd = random.Random(5)
    edges = {(rnd.choice("xy"), f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(260)}
    entries = [("x", f"n{k}") for k in range(130)] + [("y", f"n{k}") for k in range(3)] + [("x", "n5"), ("z", "alone")]
    want = set()
    for repo, entry in entries:
        seen, front, d = {entry}, {entry}, 0
        while front and (max_depth is None or d <= max_depth):
            want |= {(repo, entry, n, d) for n in front}
            front = {t for r, s, t in edges if r == repo and s in front} - seen
            seen, d = seen | front, d + 1
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = reachable(spark.createDataFrame([*edges, *list(edges)[:9]], "repo_id string, src string, dst string"),
                    spark.createDataFrame(entries, "repo_id string, entry_fqn string"), max_depth)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["repo_id", "entry_fqn", "node", "depth"]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # levels are written, none is held by the executors
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_what_is_reached_is_not_shuffled_or_written(spark):
    """A chain: every entry reaches all behind it, rows grow with the square of the graph."""
    def stages(n):
        edges = spark.range(n - 1).selectExpr("'r' repo_id", "cast(id as string) src", "cast(id + 1 as string) dst")
        got = reachable(edges, spark.range(n).selectExpr("'r' repo_id", "cast(id as string) entry_fqn"))
        assert got.count() == n * (n + 1) // 2
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.splitlines()[0].startswith("MapInArrow") and "Join" not in plan and "Aggregate" not in plan
        return got
    assert stages(300).where("depth = 299").collect() == [("r", "0", "299", 299)]


def test_nulls_and_sources_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 3)
    monkeypatch.setattr(walks, "SLICE", 4)
    pairs = [("r", "a", f"t{k}") for k in range(20)] + [("r", "b", "a"), ("r", "t3", "z"), ("r", "c", "z"), (None, "a", "no"), ("r", None, "no"), ("r", "z", None)]
    entries = [("r", "b"), ("r", "c"), (None, "a"), ("r", None)]
    got = reachable(spark.createDataFrame(pairs, "repo_id string, src string, dst string"),
                    spark.createDataFrame(entries, "repo_id string, entry_fqn string"))
    want = {("r", "b", "b", 0), ("r", "b", "a", 1), *(("r", "b", f"t{k}", 2) for k in range(20)), ("r", "b", "z", 3), ("r", "b", None, 4),
            ("r", "c", "c", 0), ("r", "c", "z", 1), ("r", "c", None, 2), (None, "a", "a", 0), ("r", None, None, 0)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
