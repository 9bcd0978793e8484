"""Queries for sections A (scans) and D (sensitive-data scan), host D."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcframe.operators import sensitive as S
from srcframe.plans.registry import register
from srcframe.plans.sqlsnip import DOC_FILES, findings_sql, lines_cte, s, scannable
from srcframe.sources import files as A
from srcframe.sources.adapters import documents_files

# Literal corner cases for the path predicate (FIXTURES §4 case_paths),
# unioned with the whole path column of the corpus.
CASE_PATHS = [
    ".git/config", "a/.GIT/HEAD", "target/app.jar", "mod/TARGET/x.txt", "build/out.txt",
    "web/Dist/app.js", "ui/node_modules/x/index.js", "lib/A.JAR", "bin/B.class", "img/c.PNG",
    "img/d.jpg", "img/e.jpeg", "img/f.gif", "img/g.bmp", "img/h.tiff", "z/a.zip", "z/b.tar",
    "z/c.gz", "z/d.rar", "z/e.7z", "w/f.exe", "w/g.dll", "l/h.so", "l/i.dylib", "o/j.o", "o/k.obj",
    "d/l.pdf", "d/m.doc", "d/n.docx", "d/o.xls", "d/p.xlsx", "d/q.ppt", "d/r.pptx", "d/s.odt",
    "d/t.ods", "d/u.odp", "yarn.lock", "app.LOG", "js/app.min.js", "css/site.min.css",
    "img/logo.svg", "js/app.js", "src/Main.java", "buildings/plan.txt", "docs/target.md",
]


def _paths_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(p,) for p in CASE_PATHS], "path string")
    return documents_files(spark, sf_dir).select("path").unionByName(cases)


def _paths_sql() -> str:
    vals = ", ".join(f"({s(p)})" for p in CASE_PATHS)
    return f"""{DOC_FILES},
paths AS (SELECT path FROM doc_files UNION ALL SELECT * FROM (VALUES {vals}) v(path))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.explode_lines(A.filter_scannable(documents_files(spark, sf_dir)))


# --------------------------------------------------------------------------- A

@register("scan_repo", f"""WITH {DOC_FILES}
SELECT repo_id, path, ext, size, length(content) AS n_chars FROM doc_files""")
def q_scan_repo(spark, sf_dir):
    return documents_files(spark, sf_dir).select(
        "repo_id", "path", "ext", "size", F.length("content").alias("n_chars"))


@register("filter_scannable", f"""WITH {_paths_sql()}
SELECT path, {scannable('path')} AS kept FROM paths""")
def q_filter_scannable(spark, sf_dir):
    return _paths_df(spark, sf_dir).select("path", A.is_scannable(F.col("path")).alias("kept"))


@register("explode_lines", f"""WITH {DOC_FILES}, {lines_cte()}
SELECT repo_id, path, line_no, length(line) AS line_len, md5(line) AS line_md5 FROM lines""")
def q_explode_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("repo_id", "path", "line_no",
                                           F.length("line").alias("line_len"),
                                           F.md5("line").alias("line_md5"))


# --------------------------------------------------------------------------- D

def _findings(spark, sf_dir, patterns) -> DataFrame:
    pats = S.validate_patterns(spark, patterns)
    return S.scan_lines(doc_lines(spark, sf_dir), pats).select(
        "repo_id", "path", "line_no", "column_no", "finding_type", "matched_text")


def _findings_sql(patterns, tail: str = "SELECT * FROM findings") -> str:
    return f"""WITH {DOC_FILES}, {lines_cte()},
findings AS (
  {findings_sql(patterns)})
{tail}"""


# The documents hold none of the catalog's words; lines of settings made from
# customers hold one each, inside other words for every seventh.
SETTING_WORDS = (S.PII_KEYWORDS + S.PCI_KEYWORDS)[::9] + ["nothing"]


def setting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in SETTING_WORDS])
    word = F.get(words, (F.col("c_custkey") % len(SETTING_WORDS)).cast("int"))
    tail = F.when(F.col("c_custkey") % 7 == 0, F.lit("x")).otherwise(F.lit(""))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.lit("settings").alias("repo_id"), F.concat(F.col("c_custkey").cast("string"), F.lit(".properties")).alias("path"),
        F.lit(1).alias("line_no"), F.concat(F.lit("set "), word, tail, F.lit(" = "), "c_name").alias("line"))


SETTING_SQL = f"""SELECT 'settings' AS repo_id, CAST(c_custkey AS VARCHAR) || '.properties' AS path, 1::INTEGER AS line_no,
  'set ' || {SETTING_WORDS!r}[c_custkey % {len(SETTING_WORDS)} + 1] || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END
  || ' = ' || c_name AS line FROM customer"""


def _catalog_findings(spark, sf_dir, patterns) -> DataFrame:
    both = doc_lines(spark, sf_dir).select("repo_id", "path", "line_no", "line").unionByName(setting_lines(spark, sf_dir))
    return S.scan_lines(both, S.validate_patterns(spark, patterns)).select(
        "repo_id", "path", "line_no", "column_no", "finding_type", "matched_text")


def _catalog_sql(patterns, tail: str = "SELECT * FROM findings") -> str:
    return f"""WITH {DOC_FILES}, {lines_cte(name="texts")},
lines AS (SELECT repo_id, path, line_no, line FROM texts UNION ALL {SETTING_SQL}),
findings AS (
  {findings_sql(patterns)})
{tail}"""


# D1: the catalog with a broken entry, which gives a warning row, and one that also
# matches the empty string, whose other matches count
D1_CATALOG = S.default_catalog() + [
    S.Pattern("PII_BROKEN", "(unclosed"), S.Pattern("PII_EMPTY", "x*"),
    S.Pattern("PII_PHONE_WORD", "phone|telephone", bounded=True, case_insensitive=True),
]
D1_VALID = [S.Pattern("PII_EMPTY", "x+") if p.name == "PII_EMPTY" else p for p in D1_CATALOG if p.name != "PII_BROKEN"]


@register("pattern_catalog", _catalog_sql(
    D1_VALID, "SELECT finding_type, count(*) AS n_findings FROM findings GROUP BY finding_type"))
def q_pattern_catalog(spark, sf_dir):
    return _catalog_findings(spark, sf_dir, D1_CATALOG).groupBy("finding_type") \
        .agg(F.count(F.lit(1)).alias("n_findings"))


@register("scan_findings", _catalog_sql(S.default_catalog()))
def q_scan_findings(spark, sf_dir):
    return _catalog_findings(spark, sf_dir, S.default_catalog())


@register("custom_patterns", _findings_sql(S.flagship_catalog()))
def q_custom_patterns(spark, sf_dir):
    return _findings(spark, sf_dir, S.flagship_catalog())


@register("skip_long_lines", f"""WITH {DOC_FILES}, {lines_cte()}
SELECT repo_id, path, line_no, length(line) AS line_len, length(line) <= 20000 AS scanned
FROM lines WHERE length(line) > 10000""")
def q_skip_long_lines(spark, sf_dir):
    ln = doc_lines(spark, sf_dir)
    return ln.where(F.length("line") > 10000).select(
        "repo_id", "path", "line_no", F.length("line").alias("line_len"),
        (F.length("line") <= S.MAX_LINE_LENGTH).alias("scanned"))


@register("search_findings", _findings_sql(S.flagship_catalog(), """SELECT * FROM findings
WHERE contains(lower(path), 'mail') OR contains(lower(finding_type), 'mail')
   OR contains(lower(matched_text), 'mail')"""))
def q_search_findings(spark, sf_dir):
    return S.search_findings(_findings(spark, sf_dir, S.flagship_catalog()), "MAIL")


@register("finding_preview", _findings_sql(S.flagship_catalog(), """SELECT repo_id, path, line_no, column_no,
  substr(matched_text, 1, 20) || CASE WHEN length(matched_text) > 20 THEN '...' ELSE '' END AS preview
FROM findings"""))
def q_finding_preview(spark, sf_dir):
    f = _findings(spark, sf_dir, S.flagship_catalog())
    return f.select("repo_id", "path", "line_no", "column_no",
                    S.finding_preview(F.col("matched_text"), 20).alias("preview"))


_FAMILY_SQL = ("CASE WHEN starts_with(finding_type, 'PII') THEN 'error' "
               "WHEN starts_with(finding_type, 'PCI') THEN 'warning' ELSE 'default' END")


@register("finding_family", _findings_sql(S.flagship_catalog(), f"""SELECT repo_id, path, line_no, column_no,
  finding_type, {_FAMILY_SQL} AS family FROM findings"""))
def q_finding_family(spark, sf_dir):
    f = _findings(spark, sf_dir, S.flagship_catalog())
    return f.select("repo_id", "path", "line_no", "column_no", "finding_type",
                    S.finding_family(F.col("finding_type")).alias("family"))


@register("finding_counts", _findings_sql(S.flagship_catalog(), f"""SELECT repo_id, family, finding_type,
  count(*) AS n_findings
FROM (SELECT *, {_FAMILY_SQL} AS family FROM findings)
GROUP BY ROLLUP (repo_id, family, finding_type) HAVING repo_id IS NOT NULL"""))
def q_finding_counts(spark, sf_dir):
    return S.finding_counts(_findings(spark, sf_dir, S.flagship_catalog()))
