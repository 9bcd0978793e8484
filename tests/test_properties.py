"""Property tests with seeded random inputs (no SQL twin needed)."""

import random
import re

from pyspark.sql import functions as F

from srcframe.operators import callgraph as H
from srcframe.operators.facts import mask, spans
from srcframe.sources.files import split_lines


def test_spans_equal_python_finditer(spark):
    rnd = random.Random(7)
    alphabet = "ab c.@1\t\nxyz"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    for rx in [r"a+b?", r"[0-9]+", r"x|yz", r"\bab\b", r"c\.@"]:
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), rx).alias("s"))
        for row in df.collect():
            want = [(m.start() + 1, len(m.group()), m.group()) for m in re.finditer(rx, row.t)]
            got = [(x.start, x.len, x.text) for x in row.s]
            assert got == want, (rx, row.t)


def test_split_lines_like_a_line_reader(spark):
    cases = ["a\r\nb", "a\rb\nc", "no newline", "", "ends\n", "x\n\n", "\n", "a" * 20001]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", split_lines(F.col("c")).alias("l"))
    for row in df.collect():
        assert row.l == row.c.splitlines(), row.c


def test_mask_keeps_length_and_blanks_literals(spark):
    src = 'int a = 1; // c("x")\nString s = "f(x)"; /* g(y)\n z */ char q = \'(\';'
    row = spark.createDataFrame([(src,)], "c string").select(mask(F.col("c")).alias("m")).first()
    assert len(row.m) == len(src)
    assert "f(x)" not in row.m and "g(y)" not in row.m and "c(" not in row.m
    assert row.m.count("\n") == src.count("\n")


def _python_dfs(entry, calls, index):
    """The reference's walk: pre-order, visited set, unresolved calls kept
    as leaves each time."""
    flow, visited = [], set()

    def dfs(node):
        if node in visited:
            return
        visited.add(node)
        flow.append(index[node])
        for callee in calls.get(node, []):
            if callee in index:
                dfs(callee)
            else:
                flow.append("UNRESOLVED_CALL: " + callee + "()")
    dfs(entry)
    return flow


def test_call_flow_equals_python_dfs_on_cyclic_graphs(spark):
    rnd = random.Random(11)
    n = 40
    nodes = [f"g.C{i}.m" for i in range(n)]
    calls = {}
    rows = []
    for i, u in enumerate(nodes):
        outs = []
        for _ in range(rnd.randint(0, 4)):
            j = rnd.randrange(n + 5)  # j >= n: unresolved
            outs.append(f"g.C{j}.m")
        calls[u] = outs
        for o, v in enumerate(outs):
            rows.append(("r", u, o, v + "()"))
    methods = spark.createDataFrame([("r", f"g.C{i}", "m", [], 0) for i in range(n)],
                                    "repo_id string, class_fqn string, name string, params array<string>, ordinal int")
    classes = spark.createDataFrame([("r", f"g.C{i}", "controller" if i < 3 else "service") for i in range(n)],
                                    "repo_id string, class_fqn string, kind string")
    calls_df = spark.createDataFrame(rows, "repo_id string, caller_fqn string, ordinal long, callee_sig string")
    flows = H.call_flow(methods, calls_df, classes).collect()
    index = {u: u + "()" for u in nodes}
    for e in range(3):
        entry = f"g.C{e}.m()"
        got = [r.step for r in sorted((r for r in flows if r.entry == entry), key=lambda r: r.step_no)]
        assert got == _python_dfs(nodes[e], calls, index), entry
