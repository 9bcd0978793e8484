"""Scalar operators over whole data columns plus literal corner cases
(host V): URL names, paths, step texts, signatures, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.functions import text as X
from srcframe.operators import callgraph as H
from srcframe.plans.facts_q import CALLS_SQL, CLASSES_SQL, JX, facts
from srcframe.plans.registry import register
from srcframe.plans.sqlsnip import s
from srcframe.sources import files as A
from srcframe.sources.adapters import pages_files, table

CASE_URLS = ["https://github.com/acme/widgets.git", "https://github.com/acme/widgets/", "git@github.com:acme/tools.git",
             "https://example.com/", "https://example.com", "https://gitlab.com/group/sub/proj.git?x=1#frag",
             "https://github.com/a/b.c.git", "file:///srv/repos/local-repo"]


def _vals(xs):
    return ", ".join(f"({s(x)})" for x in xs)


def _urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url").unionByName(
        spark.createDataFrame([(u,) for u in CASE_URLS], "url string"))


URLS_SQL = f"u AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_vals(CASE_URLS)}) v(url))"


def _sql_project_name(c: str) -> str:
    path = f"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:(?://))?(?:(?://)?[^/?#]*)?', 0)"
    # DuckDB (RE2) has no look-ahead: take the path after an optional scheme://host
    p = (f"CASE WHEN regexp_matches({c}, '^[A-Za-z][A-Za-z0-9+.\\-]*://') "
         f"THEN regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) "
         f"ELSE regexp_extract({c}, '^([^?#]*)', 1) END")
    last = f"regexp_extract({p}, '([^/]*)$', 1)"
    name = f"regexp_replace({last}, '\\.git$', '')"
    return f"coalesce(nullif({name}, ''), 'unknown_project')"


@register("project_name", f"""WITH {URLS_SQL}
SELECT url, {_sql_project_name('url')} AS project_name FROM u""")
def q_project_name(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", X.project_name(F.col("url")).alias("project_name"))


@register("repo_name", f"""WITH {URLS_SQL}
SELECT url, CASE WHEN regexp_extract(url, 'github\\.com[/:][^/]+/([^/.]+)(?:\\.git)?', 1) = '' THEN url
                 ELSE regexp_extract(url, 'github\\.com[/:][^/]+/([^/.]+)(?:\\.git)?', 1) END AS repo_name FROM u""")
def q_repo_name(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", X.repo_name(F.col("url")).alias("repo_name"))


@register("safe_file_name", f"""WITH {URLS_SQL}
SELECT url, regexp_replace(url, '[^a-zA-Z0-9_\\-]', '_', 'g') AS safe_name FROM u""")
def q_safe_file_name(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", X.safe_file_name(F.col("url")).alias("safe_name"))


@register("relative_path", """WITH f AS (
  SELECT regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS repo_id, CAST(page_id AS VARCHAR) || '.html' AS path FROM pages)
SELECT repo_id, 'C:\\repos\\' || repo_id || '\\web\\' || path AS full_path,
       'web/' || path AS rel_path FROM f""")
def q_relative_path(spark, sf_dir):
    p = pages_files(spark, sf_dir).select("repo_id", "path")
    full = F.concat(F.lit("C:\\repos\\"), F.col("repo_id"), F.lit("\\web\\"), F.col("path"))
    root = F.concat(F.lit("C:\\repos\\"), F.col("repo_id"))
    return p.select("repo_id", full.alias("full_path"), X.relative_path(full, root).alias("rel_path"))


@register("files_of_kind", f"""WITH {JX}
SELECT repo_id, path FROM jc""")
def q_files_of_kind(spark, sf_dir):
    from srcframe.sources.adapters import java_files
    return A.files_of_kind(java_files(spark, sf_dir), "java").select("repo_id", "path")


@register("dedupe_by_path", """WITH f AS (
  SELECT regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS repo_id, CAST(page_id AS VARCHAR) || '.html' AS path FROM pages)
SELECT DISTINCT repo_id, path FROM (SELECT * FROM f UNION ALL SELECT * FROM f)""")
def q_dedupe_by_path(spark, sf_dir):
    p = pages_files(spark, sf_dir)
    # the same tree listed under two overlapping roots
    return A.dedupe_by_path(p.unionByName(p)).select("repo_id", "path")


@register("parse_warnings", """SELECT regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS repo_id,
  CAST(page_id AS VARCHAR) || '.html' AS path,
  CASE WHEN page_id % 10 = 2 OR html IS NULL THEN 'unreadable file' WHEN page_id % 10 = 0 OR html = '' THEN 'empty file'
    ELSE 'malformed input (charset)' END AS warning
FROM pages WHERE page_id % 10 < 3 OR html IS NULL OR html = '' OR contains(html, chr(65533))""")
def q_parse_warnings(spark, sf_dir):
    """Three pages of ten are spoilt: emptied, badly decoded, unreadable."""
    n = F.substring_index("path", ".", 1).cast("long") % 10
    spoilt = F.when(n == 0, F.lit("")).when(n == 1, F.concat("content", F.lit("\ufffd"))) \
        .when(n == 2, F.lit(None).cast("string")).otherwise(F.col("content"))
    return A.warnings_of(pages_files(spark, sf_dir).withColumn("content", spoilt))


# ---------------------------------------------------------- signatures

CASE_SIGS = ["Main.run()", "com.x.Foo.<init>(int, java.lang.String)", "com.x.Foo.<clinit>()",
             "java.util.List<java.lang.String>.get(int)", "a.B.m(int[], long)", "UNRESOLVED_CALL: x.y(UNKNOWN_PARAM_TYPE)",
             "UNRESOLVED_OR_EXTERNAL: com.a.B.c()", "FRAMEWORK_CALL (Spring Data): com.r.Repo.findAll()",
             "FRAMEWORK_CALL (JDK/Lib): java.util.Optional.get()", "ERROR: Null baseMethodFQN for x",
             "UNRESOLVED_CALL: UNRESOLVED_CALL: p.Q.r(int)", "noDots", "plain text label", "Only.dots.no.parens"]


def _sigs(spark, sf_dir) -> DataFrame:
    c = facts(spark, sf_dir).calls.select(F.col("callee_sig").alias("sig"))
    return c.unionByName(spark.createDataFrame([(x,) for x in CASE_SIGS], "sig string")).distinct()


SIGS_SQL = f"""sigs AS (SELECT DISTINCT sig FROM (SELECT callee_sig AS sig FROM cx
  UNION ALL SELECT * FROM (VALUES {_vals(CASE_SIGS)}) v(sig)))"""


def _strip_sql(col: str) -> str:
    expr = col
    for p in reversed(H.STEP_PREFIXES):
        expr = f"CASE WHEN starts_with({col}, {s(p)}) THEN substr({col}, {len(p) + 1}) ELSE {expr} END"
    return expr


@register("base_fqn", f"""WITH {JX}, {CALLS_SQL}, {SIGS_SQL}
SELECT sig, split_part(sig, '(', 1) AS base FROM sigs""")
def q_base_fqn(spark, sf_dir):
    return _sigs(spark, sf_dir).select("sig", H.base_fqn(F.col("sig")).alias("base"))


@register("preclassified_leaf", f"""WITH {JX}, {CALLS_SQL}, {SIGS_SQL}
SELECT sig, (starts_with(sig, 'UNRESOLVED_CALL:') OR starts_with(sig, 'FRAMEWORK_CALL:') OR starts_with(sig, 'EXTERNAL_LIB:')
             OR starts_with(sig, 'ERROR:')) AS preclassified FROM sigs""")
def q_preclassified_leaf(spark, sf_dir):
    return _sigs(spark, sf_dir).select("sig", H.is_preclassified(F.col("sig")).alias("preclassified"))


@register("participant", f"""WITH {JX}, {CALLS_SQL}, {SIGS_SQL},
st AS (SELECT sig, split_part({_strip_sql('sig')}, '(', 1) AS n FROM sigs)
SELECT sig, CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\\.', 1) ELSE n END AS participant FROM st""")
def q_participant(spark, sf_dir):
    return _sigs(spark, sf_dir).select("sig", H.participant(F.col("sig")).alias("participant"))


@register("call_label", f"""WITH {JX}, {CALLS_SQL}, {SIGS_SQL},
st AS (SELECT sig, {_strip_sql('sig')} AS lab FROM sigs),
p AS (SELECT sig, lab, length(lab) - strpos(reverse(lab), '.') + 1 AS last_dot, strpos(reverse(lab), '.') > 0 AS has_dot,
             strpos(lab, '(') AS paren, contains(lab, '(') AND contains(lab, ')') AS has_parens FROM st)
SELECT sig, CASE WHEN has_parens AND has_dot AND last_dot < paren THEN substr(lab, last_dot + 1)
                 WHEN has_parens THEN lab ELSE regexp_extract(lab, '([^.]*)$', 1) END AS label FROM p""")
def q_call_label(spark, sf_dir):
    return _sigs(spark, sf_dir).select("sig", H.call_label(F.col("sig")).alias("label"))


@register("classify_external", f"""WITH {JX}, {CLASSES_SQL}, {CALLS_SQL},
u AS (SELECT repo_id, class_fqn, method_name, ordinal, callee_sig,
             split_part(CASE WHEN starts_with(callee_sig, 'UNRESOLVED_CALL: ') THEN substr(callee_sig, 18) ELSE callee_sig END,
                        '(', 1) AS b
      FROM cx WHERE starts_with(callee_sig, 'UNRESOLVED_CALL: ')),
v AS (SELECT u.*, regexp_extract(b, '^(.*)\\.', 1) AS cls, regexp_extract(b, '([^.]*)$', 1) AS mth FROM u)
SELECT v.repo_id, v.class_fqn, v.method_name, v.ordinal,
  CASE WHEN r.class_fqn IS NOT NULL AND (starts_with(mth, 'save') OR starts_with(mth, 'find') OR starts_with(mth, 'delete')
                                         OR starts_with(mth, 'exists') OR starts_with(mth, 'count'))
       THEN 'FRAMEWORK_CALL (Spring Data)'
       WHEN {" OR ".join(f"starts_with(b, {s(p)})" for p in H.LIB_PREFIXES)} THEN 'FRAMEWORK_CALL (JDK/Lib)'
       ELSE 'UNRESOLVED_OR_EXTERNAL' END AS step_class
FROM v LEFT JOIN cls r ON r.repo_id = v.repo_id AND r.class_fqn = v.cls AND r.kind = 'repository'""")
def q_classify_external(spark, sf_dir):
    fx = facts(spark, sf_dir)
    u = fx.calls.where(F.startswith("callee_sig", F.lit("UNRESOLVED_CALL: "))) \
        .select("repo_id", "class_fqn", "method_name", "ordinal", "callee_sig")
    return H.classify_external(u, fx.classes).select("repo_id", "class_fqn", "method_name", "ordinal", "step_class")


# ---------------------------------------------------------- titles

@register("diagram_title", """WITH t AS (
  SELECT * FROM (VALUES ('CLASS_DIAGRAM'), ('ENTITY_RELATIONSHIP_DIAGRAM'), ('SEQUENCE_DIAGRAM'), ('COMPONENT_DIAGRAM'),
                        ('USECASE_DIAGRAM'), ('DATABASE_DIAGRAM')) v(x)
  UNION ALL SELECT 'tree.Region' || CAST(r_regionkey AS VARCHAR) || '.visit(long id)' FROM region)
SELECT x, CASE WHEN contains(x, '(') THEN 'Sequence: ' ||
    CASE WHEN regexp_matches(x, '([\\w$.]+)\\.([^.(]+)\\(')
         THEN regexp_extract(regexp_extract(x, '([\\w$.]+)\\.([^.(]+)\\(', 1), '([^.]*)$', 1) || '.'
              || regexp_extract(x, '([\\w$.]+)\\.([^.(]+)\\(', 2)
         WHEN regexp_matches(x, '\\.([^.(]+)\\(') THEN regexp_extract(x, '\\.([^.(]+)\\(', 1) ELSE x END
  ELSE array_to_string(list_transform(string_split(lower(replace(x, '_', ' ')), ' '),
                                      lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END AS title
FROM t""")
def q_diagram_title(spark, sf_dir):
    types = spark.createDataFrame([(x,) for x in ["CLASS_DIAGRAM", "ENTITY_RELATIONSHIP_DIAGRAM", "SEQUENCE_DIAGRAM",
                                                  "COMPONENT_DIAGRAM", "USECASE_DIAGRAM", "DATABASE_DIAGRAM"]], "x string")
    entries = table(spark, sf_dir, "region").select(
        F.concat(F.lit("tree.Region"), F.col("r_regionkey").cast("string"), F.lit(".visit(long id)")).alias("x"))
    u = types.unionByName(entries)
    return u.select("x", F.when(F.col("x").contains("("), H.sequence_title(F.col("x")))
                    .otherwise(H.diagram_title(F.col("x"))).alias("title"))


CASE_FLOW_SIGS = ["com.x.Foo.<init>(int a, java.lang.String s)", "com.x.Foo.<clinit>()", "<init>()",
                  "a.B.m(java.util.Map<String,Integer> m, int[] xs)", "a.B.run()", "getUserName", "snake_case_name",
                  "weird(text", "a.B.n(String)", "q.R.s(Map<K,V>, List<X> items)"]


def _sql_simplify(c: str) -> str:
    g = f"string_split_regex({c}, '<[^>]+>')"
    m = (f"list_transform(regexp_extract_all({c}, '<[^>]+>'), lambda x: '<' || array_to_string(list_transform("
         f"string_split(substr(x, 2, length(x) - 2), ','), lambda p: trim(p)), ', ') || '>')")
    return (f"array_to_string(list_transform(range(1, len({g}) + 1), lambda i: {g}[i] || coalesce(({m})[i], '')), '')")


_HEAD = "split_part(sig, '(', 1)"
_METHOD = f"list_last(string_split({_HEAD}, '.'))"
_CLASS = f"array_to_string(list_slice(string_split({_HEAD}, '.'), 1, -2), '.')"


def _sql_param(p: str) -> str:
    bare = f"rtrim({p}, '[]')"
    name = f"list_last(string_split_regex({bare}, '\\s'))"
    typ = f"trim(left({bare}, length({bare}) - length({name})))"
    br = f"CASE WHEN ends_with({p}, '[]') THEN '[]' ELSE '' END"
    plain = f"regexp_full_match({name}, '[A-Za-z0-9_$]+')"
    return (f"CASE WHEN {plain} AND {typ} <> '' THEN {_sql_simplify(typ)} || ' ' || {name} || {br} "
            f"WHEN {plain} THEN {_sql_simplify(name)} || {br} ELSE {_sql_simplify(p)} END")


_PARAMS = (f"array_to_string(list_transform(list_filter(list_transform(string_split(substr(sig, length({_HEAD}) + 2, length(sig) - length({_HEAD}) - 2), ','), "
           f"lambda x: trim(x)), lambda x: x <> ''), lambda p: {_sql_param('p')}), ', ')")


@register("flow_display_name", f"""WITH {JX}, {CALLS_SQL},
sigs AS (SELECT DISTINCT sig FROM (SELECT callee_sig AS sig FROM cx WHERE NOT starts_with(callee_sig, 'UNRESOLVED_CALL')
  UNION ALL SELECT * FROM (VALUES {_vals(CASE_FLOW_SIGS)}) v(sig))),
x AS (SELECT sig, contains(sig, '(') AND ends_with(sig, ')') AND regexp_full_match({_HEAD}, '[A-Za-z0-9_$.<>]+')
               AND {_METHOD} <> '' AND NOT starts_with(sig, '.') AS ok, {_CLASS} AS cls, {_METHOD} AS meth, {_PARAMS} AS params,
             trim(regexp_replace(sig, '([A-Z])', ' \\1', 'g')) AS sp FROM sigs)
SELECT sig, CASE WHEN NOT ok AND contains(sig, '(') AND contains(sig, ')') THEN sig
  WHEN NOT ok THEN replace(upper(substr(sp, 1, 1)) || substr(sp, 2), '_', ' ')
  WHEN meth = '<init>' THEN 'new ' || CASE WHEN cls <> '' THEN regexp_extract(cls, '([^.]*)$', 1) ELSE 'Object' END || '(' || params || ')'
  WHEN meth = '<clinit>' THEN trim(regexp_extract(cls, '([^.]*)$', 1) || ' static initializer')
  ELSE meth || '(' || params || ')' END AS display FROM x""")
def q_flow_display_name(spark, sf_dir):
    c = facts(spark, sf_dir).calls.where(~F.startswith("callee_sig", F.lit("UNRESOLVED_CALL"))) \
        .select(F.col("callee_sig").alias("sig"))
    u = c.unionByName(spark.createDataFrame([(x,) for x in CASE_FLOW_SIGS], "sig string")).distinct()
    return u.select("sig", H.flow_display_name(F.col("sig")).alias("display"))
