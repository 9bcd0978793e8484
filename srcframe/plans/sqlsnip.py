"""DuckDB SQL fragments for the oracle queries.

They restate the adapters and operators in plain SQL over the driver's
tables, so that the oracle recomputes every result independently of Spark.
"""

from __future__ import annotations


def s(x: str) -> str:
    """SQL string literal."""
    return "'" + x.replace("'", "''") + "'"


DOC_FILES = """doc_files AS (
  SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         'txt' AS ext, n_chars AS size, text AS content
  FROM documents)"""


def lines_cte(files: str = "doc_files", name: str = "lines") -> str:
    return f"""{name}_parts AS (
  SELECT repo_id, path, string_split_regex(content, '\\r\\n|\\r|\\n') AS arr FROM {files}),
{name} AS (
  SELECT repo_id, path, CAST(i AS INTEGER) AS line_no, arr[i] AS line
  FROM (SELECT repo_id, path, arr,
               unnest(range(1, len(arr) + 1 - CASE WHEN arr[len(arr)] = '' THEN 1 ELSE 0 END)) AS i
        FROM {name}_parts))"""


SCANNABLE_DIRS = ["/.git/", "/target/", "/build/", "/dist/", "/node_modules/"]


def scannable(path: str) -> str:
    from srcframe.sources.files import EXCLUDED_DIRS, EXCLUDED_SUFFIXES
    p = f"('/' || lower({path}))"
    conds = [f"contains({p}, {s(d)})" for d in EXCLUDED_DIRS]
    conds += [f"ends_with({p}, {s(x)})" for x in EXCLUDED_SUFFIXES]
    return "NOT (" + " OR ".join(conds) + ")"


def findings_sql(patterns, lines: str = "lines", max_len: int = 20000,
                 keep: str = "repo_id, path, line_no") -> str:
    """Spans of every pattern over ``lines`` by the split/extract identity;
    a UNION ALL with one branch per pattern."""
    parts = []
    for p in patterns:
        rx = s(p.re2)
        parts.append(f"""SELECT {keep}, finding_type,
         CAST(1 + list_sum(list_transform(g[1:j], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0) AS INTEGER) AS column_no,
         m[j] AS matched_text
  FROM (SELECT {keep}, finding_type, m, g, unnest(range(1, len(m) + 1)) AS j
        FROM (SELECT {keep}, {s(p.name)} AS finding_type,
                     regexp_extract_all(line, {rx}) AS m, string_split_regex(line, {rx}) AS g
              FROM {lines} WHERE length(line) <= {max_len} AND regexp_matches(line, {rx})))""")
    return "\n  UNION ALL\n  ".join(parts)
