"""Queries for section C (project metadata), hosts M and C."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcframe.operators import project as C
from srcframe.plans.registry import register
from srcframe.sources.adapters import build_files, conversations_logs

NX = """nx AS (SELECT n_nationkey AS n, 'proj' || CAST(n_nationkey AS VARCHAR) AS repo_id FROM nation)"""


@register("build_tool", f"""WITH {NX}
SELECT repo_id, CASE n % 3 WHEN 0 THEN 'Maven' WHEN 1 THEN 'Gradle' ELSE 'Raw Source/Unknown' END AS build_tool
FROM nx""")
def q_build_tool(spark, sf_dir):
    return C.build_tool(build_files(spark, sf_dir))


@register("is_spring_boot", f"""WITH {NX}
SELECT repo_id, (n % 3 < 2) OR (n % 2 = 0) AS is_spring_boot FROM nx""")
def q_is_spring_boot(spark, sf_dir):
    return C.spring_boot(build_files(spark, sf_dir)).select("repo_id", "is_spring_boot")


@register("spring_boot_version", f"""WITH {NX}
SELECT repo_id, CASE n % 3 WHEN 0 THEN '3.' || CAST(n AS VARCHAR) || '.0'
                           WHEN 1 THEN '3.' || CAST(n AS VARCHAR) || '.1' END AS spring_boot_version FROM nx""")
def q_spring_boot_version(spark, sf_dir):
    return C.spring_boot(build_files(spark, sf_dir)).select("repo_id", "spring_boot_version")


@register("java_version", f"""WITH {NX}
SELECT repo_id, CASE WHEN n % 2 = 0 THEN '8' ELSE '17' END AS java_version FROM nx WHERE n % 3 = 0""")
def q_java_version(spark, sf_dir):
    return C.java_version(build_files(spark, sf_dir))


@register("maven_modules", f"""WITH {NX}
SELECT repo_id, CAST(i AS INTEGER) AS ordinal, 'm' || CAST(i AS VARCHAR) AS module
FROM (SELECT repo_id, unnest(range(0, n % 4 + 1)) AS i FROM nx WHERE n % 3 = 0) WHERE i % 2 = 0""")
def q_maven_modules(spark, sf_dir):
    m = C.maven_modules(build_files(spark, sf_dir))
    return m.select("repo_id", F.col("ordinal").cast("int").alias("ordinal"), "module")


@register("gherkin_features", f"""WITH {NX}
SELECT repo_id, CAST((n % 2 = 0)::INT + (n % 5 = 0)::INT AS BIGINT) AS n_features FROM nx
WHERE n % 2 = 0 OR n % 5 = 0""")
def q_gherkin_features(spark, sf_dir):
    return C.gherkin_features(build_files(spark, sf_dir))


@register("top_warnings", """WITH w AS (
  SELECT 'chat' || CAST(conv_id % 4 AS VARCHAR) AS repo_id, 'conv.' || CAST(conv_id AS VARCHAR) AS class_fqn,
         CAST(turn AS INTEGER) AS line FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY class_fqn, line) AS rank FROM w)
SELECT repo_id, CAST(rank AS INTEGER) AS rank, class_fqn || ':' || CAST(line AS VARCHAR) AS line FROM r WHERE rank <= 10
UNION ALL
SELECT repo_id, 11, '... and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' FROM w GROUP BY repo_id HAVING count(*) > 10""")
def q_top_warnings(spark, sf_dir):
    w = conversations_logs(spark, sf_dir).select(
        "repo_id", "class_fqn", "line", F.concat_ws(":", "class_fqn", F.col("line").cast("string")).alias("warning"))
    t = C.top_rows(w, ["class_fqn", "line"], 10)
    return t.select("repo_id", F.col("rank").cast("int").alias("rank"), "line")


@register("project_summary", """WITH pp AS (
  SELECT p.p_partkey % 6 AS t, 'repo' || CAST(coalesce(hd.p_size, 0) % 10 AS VARCHAR) AS repo_id
  FROM part p LEFT JOIN part hd ON hd.p_partkey = p.p_partkey - p.p_partkey % 6),
c AS (SELECT repo_id, count(*) AS n_classes, count_if(t = 0) AS n_controllers, count_if(t IN (1, 4)) AS n_services,
             count_if(t = 2) AS n_repositories, 2 * count_if(t = 0) AS n_rest, count_if(t = 4) AS n_soap
      FROM pp GROUP BY repo_id),
d AS (SELECT *, n_rest + n_soap AS n_endpoints,
        list_filter([CASE WHEN n_rest > 0 THEN 'REST APIs' END, CASE WHEN n_soap > 0 THEN 'SOAP Web Services' END,
                     CASE WHEN n_repositories > 0 THEN 'Data Repositories (e.g., Spring Data)' END,
                     CASE WHEN n_services > 0 THEN 'Service Layer' END], lambda x: x IS NOT NULL) AS tech FROM c)
SELECT repo_id, n_classes, n_controllers, n_services, n_repositories, n_endpoints, n_rest, n_soap,
  'Project Name: ' || repo_id || '. Type: Raw Source/Unknown. '
  || CASE WHEN len(tech) > 0 THEN 'Key Technologies: ' || array_to_string(tech, ', ') || '. ' ELSE '' END
  || 'Spring Boot: No. Contains ' || CAST(n_classes AS VARCHAR) || ' classes/interfaces/enums. (Controllers: '
  || CAST(n_controllers AS VARCHAR) || ', Services: ' || CAST(n_services AS VARCHAR) || ', Repositories: '
  || CAST(n_repositories AS VARCHAR) || ').' || chr(10)
  || 'Exposes ' || CAST(n_endpoints AS VARCHAR) || ' API endpoints.'
  || CASE WHEN n_rest > 0 THEN ' (' || CAST(n_rest AS VARCHAR) || ' REST' ELSE '' END
  || CASE WHEN n_soap > 0 THEN CASE WHEN n_rest > 0 THEN ', ' ELSE ' (' END || CAST(n_soap AS VARCHAR) || ' SOAP' ELSE '' END
  || CASE WHEN n_rest > 0 OR n_soap > 0 THEN ').' ELSE '' END || chr(10)
  || 'An OpenAPI (Swagger) specification is available for REST APIs.' || chr(10) AS summary
FROM d""")
def q_project_summary(spark, sf_dir):
    from srcframe.operators import endpoints as G
    from srcframe.plans.facts_q import facts
    from srcframe.sources.adapters import java_files
    fx = facts(spark, sf_dir)
    return C.project_summary(java_files(spark, sf_dir), fx.classes, G.endpoints(fx))
