"""Scans, path predicates and line explosion (section A).

``source_files(repo_id, path, ext, size, content)`` is the base table; every
other fact table derives from it.  Nothing here shuffles: these are
projections, filters and generators that stay inside one scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcframe.functions.text import ext_of, relative_path

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: directory marks and file
# suffixes that are never scanned for sensitive data (case-insensitive).
# ---------------------------------------------------------------------------
EXCLUDED_DIRS = ["/.git/", "/target/", "/build/", "/dist/", "/node_modules/"]
EXCLUDED_SUFFIXES = [
    ".jar", ".class", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib",
    ".o", ".obj", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".odt", ".ods", ".odp", ".lock", ".log", ".min.js", ".min.css",
]

# Any of CRLF, CR, LF ends a line (like a buffered line reader).
LINE_BREAK = r"\r\n|\r|\n"


def read_tree(spark: SparkSession, root: str, repo_id: str | None = None,
              glob: str | None = None) -> DataFrame:
    """A1 ``scan_repo``: recursive walk of a directory tree into
    ``source_files``.  Each file is one row (``wholetext``); Spark lists and
    splits the files across tasks.  ``repo_id`` defaults to the root's name."""
    r = (spark.read.option("wholetext", True)
         .option("recursiveFileLookup", True)
         .option("ignoreCorruptFiles", True))
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(root)
    root_uri = root.rstrip("/")
    rid = repo_id or root_uri.rsplit("/", 1)[-1]
    full = F.col("_metadata.file_path")
    return df.select(
        F.lit(rid).alias("repo_id"),
        relative_path(F.regexp_replace(full, r"^file:", ""), F.lit(root_uri)).alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("content"),
    ).withColumn("ext", ext_of(F.col("path"))).select("repo_id", "path", "ext", "size", "content")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A1 for big corpora: a parquet table of ``(repo_id, path, content)``.
    Column pruning and row-group filters then reach the scan."""
    df = spark.read.parquet(path)
    if "ext" not in df.columns:
        df = df.withColumn("ext", ext_of(F.col("path")))
    if "size" not in df.columns:
        df = df.withColumn("size", F.length("content").cast("long"))
    return df.select("repo_id", "path", "ext", "size", "content")


def is_scannable(path: Column) -> Column:
    """A2 predicate: not under an excluded directory mark and not ending in
    an excluded suffix; case-insensitive.  The reference tests absolute
    paths, so a top-level ``target/`` directory counts too: test ``/``+path."""
    p = F.concat(F.lit("/"), F.lower(path))
    bad = None
    for d in EXCLUDED_DIRS:
        c = p.contains(d)
        bad = c if bad is None else (bad | c)
    for s in EXCLUDED_SUFFIXES:
        bad = bad | p.endswith(s)
    return ~bad


def filter_scannable(files: DataFrame) -> DataFrame:
    """A2 ``filter_scannable``."""
    return files.where(is_scannable(F.col("path")))


# Roots under which feature / WSDL / XSD files are collected (fixed values).
# ``""`` is the repository root.
FEATURE_ROOTS = ["src/test/resources/features", "src/main/resources/features", "features"]
WSDL_ROOTS = ["src/main/resources/wsdl", "src/main/resources/META-INF/wsdl",
              "src/main/resources/service-api-definition", "src/main/webapp/WEB-INF/wsdl",
              "src/main/resources", ""]
XSD_ROOTS = ["src/main/resources/xsd", "src/main/resources/schemas", "src/main/resources/wsdl",
             "src/main/resources"]


def files_of_kind(files: DataFrame, kind: str) -> DataFrame:
    """A3 ``files_of_kind``: ``java`` (any path); ``feature`` (suffix is
    case-sensitive), ``wsdl`` and ``xsd`` (case-insensitive suffix) under
    their roots, recursively.  Overlapping roots can list a file twice; A4
    removes that."""
    kind = kind.lower()
    if kind == "java":
        return files.where(F.col("path").endswith(".java"))
    roots = {"feature": FEATURE_ROOTS, "wsdl": WSDL_ROOTS, "xsd": XSD_ROOTS}[kind]
    cond = None
    for r in roots:
        c = F.lit(True) if r == "" else F.col("path").startswith(r + "/")
        cond = c if cond is None else (cond | c)
    suffix = (F.col("path").endswith(".feature") if kind == "feature"
              else F.lower(F.col("path")).endswith("." + kind))
    return files.where(suffix & cond)


def dedupe_by_path(files: DataFrame) -> DataFrame:
    """A4: overlapping roots give one row per relative path.  The shuffle is
    keyed on (repo_id, path), so a hot repository still spreads by path."""
    return files.dropDuplicates(["repo_id", "path"])


def split_lines(content: Column) -> Column:
    """Lines of a text as an array: any line break ends a line, a final
    break does not start an empty last line, empty text has no lines."""
    parts = F.split(content, LINE_BREAK, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, n - 1)).otherwise(parts)


def explode_lines(files: DataFrame, keep: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """A6 ``explode_lines`` → ``source_lines(repo_id, path, line_no, line)``
    with 1-based line numbers.  Map-only (a generator in the scan stage)."""
    return files.select(*keep, F.posexplode(split_lines(F.col("content"))).alias("pos", "line")) \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def write_tables(tables: dict[str, DataFrame], out: str, mode: str = "overwrite") -> None:
    """A7 ``write_result``: every result table to parquet, partitioned by
    ``repo_id`` (one folder per repository, like one response per repo)."""
    for name, df in tables.items():
        df.write.mode(mode).partitionBy("repo_id").parquet(f"{out.rstrip('/')}/{name}")


def warnings_of(files: DataFrame) -> DataFrame:
    """A10 ``parse_warnings``: files that cannot be read as text become
    warning rows instead of failing the job.  Undecodable bytes show up as
    U+FFFD after Spark's UTF-8 decode; empty reads as ``empty file``."""
    return files.select(
        "repo_id", "path",
        F.when(F.col("content").isNull(), F.lit("unreadable file"))
        .when(F.col("content") == "", F.lit("empty file"))
        .when(F.col("content").contains("�"), F.lit("malformed input (charset)"))
        .alias("warning"),
    ).where(F.col("warning").isNotNull())
