"""Custom patterns that may match nothing or do not compile; tables of SQL text."""

import re

from pyspark.sql import functions as F

from srcframe.functions.text import sql_tables
from srcframe.operators.sensitive import Pattern, pattern_warnings, scan_lines, validate_patterns

LINES = ["a12b", "secret x secretsecret", "", "OK 7", "  99 "]


def test_no_pattern_vanishes(spark):
    given = [Pattern("DIGITS", r"\d*"), Pattern("MAYBE", "(secret)?"), Pattern("BROKEN", "("), Pattern("OK", "OK"),
             Pattern("EDGE", r"\bx|q"), Pattern("TWICE", r"(s)?(e)\2?")]
    lines = spark.createDataFrame([("r", "p", k, x) for k, x in enumerate(LINES)], "repo_id string, path string, line_no int, line string")
    good = validate_patterns(spark, given)
    assert [p.name for p in good] == ["DIGITS", "MAYBE", "OK", "EDGE", "TWICE"]
    got = sorted((r.finding_type, r.line_no, r.column_no, r.matched_text) for r in scan_lines(lines, good).collect())
    want = sorted((p.name, k, m.start() + 1, m.group()) for p in good for k, x in enumerate(LINES)
                  for m in re.finditer(p.body, x) if m.group())
    assert got == want
    bad = pattern_warnings(spark, given).collect()
    assert [r.pattern for r in bad] == ["BROKEN"] and bad[0].reason


def test_tables(spark):
    cases = {"select a from s.t x, `u` as y, \"d\".\"e f\" where b in (select c from v)": ["e f", "t", "u", "v"],
             "SELECT 1 FROM a JOIN b ON a.x = b.x, c": ["a", "b"], "insert into t(a, b) values ('from z', 1)": ["t"],
             "UPDATE `db`.`t` SET x = 1": ["t"], "delete from t where a = 1": ["t"], "create table x.y (a int)": ["y"],
             "select 1": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", sql_tables(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == cases
