"""Queries for section I (structure graphs), hosts R and V."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcframe.operators import structure as I
from srcframe.plans.facts_q import CLASSES_SQL, FIELDS_SQL, JX, facts
from srcframe.plans.registry import register
from srcframe.plans.sqlsnip import s

# same-repository test for the previous chain's entity (k - 6)
PREV = """prev AS (SELECT a.repo_id, a.k, a.name AS source, b.name AS target
  FROM jc a JOIN jc b ON b.k = a.k - 6 AND b.repo_id = a.repo_id WHERE a.t = 3)"""


@register("inheritance_edges", f"""WITH {JX}
SELECT repo_id, 'JpaRepository_Item' || k1 || '_Long_' AS src, name AS dst, '<|--' AS arrow, 'extends' AS label
FROM jc WHERE t = 2""")
def q_inheritance_edges(spark, sf_dir):
    return I.inheritance_edges(facts(spark, sf_dir).classes)


@register("association_edges", f"""WITH {JX}, {PREV}
SELECT repo_id, name AS src, 'Item' || k1 || 'Service' AS dst, '-->' AS arrow, 'service' AS label
FROM jc WHERE t = 0 AND has1
UNION ALL SELECT repo_id, name, 'Item' || k1 || 'Repository', '-->', 'repository' FROM jc WHERE t = 1 AND has1
UNION ALL SELECT repo_id, source, target, '-->', 'parent' FROM prev
UNION ALL SELECT repo_id, name, name, '-->', c FROM jc, (VALUES ('ALPHA'), ('BETA'), ('GAMMA')) v(c)
  WHERE t = 5 AND variant = 'enum'""")
def q_association_edges(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.association_edges(fx.classes, fx.fields)


@register("er_edges", f"""WITH {JX}, {PREV}
SELECT repo_id, source AS src, target AS dst, '}}--||' AS arrow, 'parent' AS label FROM prev""")
def q_er_edges(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.er_edges(fx.classes, fx.fields)


COMP_SQL = """comp AS (
  SELECT repo_id, class_fqn, name, pkg AS package,
         CASE t WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' ELSE 'endpoint' END AS role
  FROM jc WHERE t IN (0, 1, 2, 4))"""


@register("components", f"""WITH {JX}, {COMP_SQL}
SELECT repo_id, class_fqn, name, package FROM comp""")
def q_components(spark, sf_dir):
    return I.components(facts(spark, sf_dir).classes).select("repo_id", "class_fqn", "name", "package")


@register("component_role", f"""WITH {JX}, {COMP_SQL}
SELECT repo_id, class_fqn, role FROM comp""")
def q_component_role(spark, sf_dir):
    return I.components(facts(spark, sf_dir).classes).select("repo_id", "class_fqn", "role")


@register("components_by_package", f"""WITH {JX}, {COMP_SQL}
SELECT repo_id, package, count(*) AS n_components FROM comp GROUP BY ALL""")
def q_components_by_package(spark, sf_dir):
    c = I.components(facts(spark, sf_dir).classes)
    return c.groupBy("repo_id", "package").agg(F.count(F.lit(1)).alias("n_components"))


@register("component_field_edges", f"""WITH {JX}
SELECT repo_id, name AS src, 'Item' || k1 || 'Service' AS dst, '-->' AS arrow, 'uses' AS label
FROM jc WHERE t = 0 AND has1
UNION ALL SELECT repo_id, name, 'Item' || k1 || 'Repository', '-->', 'uses' FROM jc WHERE t = 1 AND has1""")
def q_component_field_edges(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.component_field_edges(fx.classes, fx.fields)


@register("component_call_edges", f"""WITH {JX}
SELECT repo_id, name AS src, 'Item' || k1 || 'Service' AS dst, '..>' AS arrow, 'calls process()' AS label
FROM jc WHERE t = 0 AND has1
UNION ALL SELECT repo_id, name, 'Item' || k1 || 'Service', '..>', 'calls save()' FROM jc WHERE t = 0 AND has1""")
def q_component_call_edges(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.component_call_edges(fx.classes, fx.calls)


ROLES = ["endpoint", "service", "repository", "controller", "webservice", "configuration", "component"]


@register("relation_label", f"""WITH {JX}, {COMP_SQL},
pairs AS (SELECT DISTINCT role AS src_role, unnest([{", ".join(s(r) for r in ROLES)}]) AS dst_role FROM comp)
SELECT src_role, dst_role, CASE
  WHEN src_role = 'endpoint' AND dst_role = 'service' THEN 'delegates to'
  WHEN src_role = 'service' AND dst_role = 'repository' THEN 'uses'
  WHEN src_role = 'controller' AND dst_role = 'service' THEN 'uses'
  WHEN src_role = 'webservice' AND dst_role = 'endpoint' THEN 'exposes' END AS label
FROM pairs""")
def q_relation_label(spark, sf_dir):
    # every role the corpus produces, paired with each possible target role
    comp = I.components(facts(spark, sf_dir).classes)
    pairs = comp.select(F.col("role").alias("src_role"),
                        F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("dst_role")).distinct()
    return pairs.select("src_role", "dst_role", I.relation_label(F.col("src_role"), F.col("dst_role")).alias("label"))


MEMBER_SQL = """ml AS (
  SELECT repo_id, class_fqn, 0 AS section, 0 AS ordinal, '{field} -service: Item' || k1 || 'Service' AS line FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 1, 0, '{method} getItem(Long id): String' FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 1, 1, '{method} createItem(Item' || k3 || ' body): String' FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 0, 0, '{field} {static} -log: Logger' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 0, 1, '{field} -repository: Item' || k1 || 'Repository' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 1, 0, '{method} process(Long id): String' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 1, 1, '{method} save(Item' || k2 || ' body): String' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 1, 0, '{method} findByNameAndStatus(String name, String status): List_Item' || k1 || '_'
    FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 1, 1, '{method} saveItem(Item' || k1 || ' item): Item' || k1 FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 1, 2, '{method} loadById(Long id): Item' || k1 FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 0, 0, '{field} -id: Long' FROM jc WHERE t = 3
  UNION ALL SELECT repo_id, class_fqn, 0, 1, '{field} -name: String' FROM jc WHERE t = 3
  UNION ALL SELECT repo_id, class_fqn, 0, 2, '{field} -parent: Item' || CAST(k - 6 AS VARCHAR) FROM jc WHERE t = 3 AND k >= 6
  UNION ALL SELECT repo_id, class_fqn, 1, 0, '{method} getItem(String id): String' FROM jc WHERE t = 4
  UNION ALL SELECT repo_id, class_fqn, 0, o, '{field} {static} +' || c || ': ' || name
    FROM jc, (VALUES (0, 'ALPHA'), (1, 'BETA'), (2, 'GAMMA')) v(o, c) WHERE t = 5 AND variant = 'enum'
  UNION ALL SELECT repo_id, class_fqn, 0, o, '{field} +' || c FROM jc,
    (VALUES (0, 'value: String'), (1, 'priority: int'), (2, 'enabled: boolean')) v(o, c) WHERE t = 5 AND variant = 'annotation'
  UNION ALL SELECT repo_id, class_fqn, 1, 0, '{method} executeAudit(Connection conn)' FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 1, 1, '{method} auditQuery(): String' FROM jc WHERE t = 5 AND variant = 'util')"""


@register("class_member_lines", f"""WITH {JX}, {MEMBER_SQL}
SELECT * FROM ml""")
def q_class_member_lines(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.class_member_lines(fx.classes, fx.fields, fx.methods).select(
        "repo_id", "class_fqn", F.col("section").cast("int").alias("section"), F.col("ordinal").cast("int").alias("ordinal"),
        "line")


@register("use_cases", f"""WITH {JX}
SELECT repo_id, class_fqn, 'getItem' AS use_case, 'User' AS actor FROM jc WHERE t = 0
UNION ALL SELECT repo_id, class_fqn, 'createItem', 'User' FROM jc WHERE t = 0
UNION ALL SELECT repo_id, class_fqn, 'getItem', 'External System' FROM jc WHERE t = 4""")
def q_use_cases(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.use_cases(fx.classes, fx.methods)


CASE_LABELS = ['say "hi"', "List<Map<K,V>>", "cost$", "a\nb\rc", "{x}", "plain", "java.util.List<String>", "a b(c)[d]"]


@register("puml_safe", f"""WITH {JX},
t AS (SELECT DISTINCT x FROM (SELECT name AS x FROM jc UNION ALL SELECT 'JpaRepository<Item' || k1 || ', Long>' FROM jc WHERE t = 2
      UNION ALL SELECT * FROM (VALUES {", ".join(f"({s(x)})" for x in CASE_LABELS)}) v(x)))
SELECT x, regexp_replace(regexp_replace(x, '[.:<>\\s()\\[\\]{{}}\\\\]', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g') AS id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '"', ''''), '[<>]', '_', 'g'), '\\$', '_dollar_', 'g'),
    '[\\n\\r]', ' ', 'g'), '[{{}}]', '_', 'g') AS label
FROM t""")
def q_puml_safe(spark, sf_dir):
    c = facts(spark, sf_dir).classes
    x = c.select(F.col("name").alias("x")).unionByName(
        c.select(F.explode("interfaces").alias("x"))).unionByName(
        spark.createDataFrame([(v,) for v in CASE_LABELS], "x string")).distinct()
    return x.select("x", I.puml_id(F.col("x")).alias("id"), I.puml_label(F.col("x")).alias("label"))


@register("use_case_includes", f"""WITH {JX}
SELECT repo_id, class_fqn, 'getItem' AS use_case, pkg || '.Item' || k1 || 'Service' AS svc_fqn, 'process' AS svc_method,
       'Item' || k1 || 'Service.process' AS included FROM jc WHERE t = 0 AND has1
UNION ALL SELECT repo_id, class_fqn, 'createItem', pkg || '.Item' || k1 || 'Service', 'save', 'Item' || k1 || 'Service.save'
FROM jc WHERE t = 0 AND has1""")
def q_use_case_includes(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.use_case_includes(fx.classes, fx.methods, fx.calls)


@register("db_use_cases", f"""WITH {JX},
hr AS (SELECT DISTINCT repo_id FROM jc WHERE t = 2),
svc AS (SELECT repo_id, class_fqn, t FROM jc WHERE t IN (1, 4))
SELECT s.repo_id, s.class_fqn, m AS method, 'Database' AS actor
FROM svc s JOIN hr USING (repo_id), (VALUES ('save'), ('getItem')) v(m)
WHERE (s.t = 1 AND m = 'save') OR (s.t = 4 AND m = 'getItem')""")
def q_db_use_cases(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return I.db_use_cases(fx.classes, fx.methods)


@register("wsdl_edges", f"""WITH {JX}
SELECT repo_id, name AS src, 'WSDL0' AS dst, '..>' AS arrow, 'implements' AS label FROM jc WHERE t = 4""")
def q_wsdl_edges(spark, sf_dir):
    return I.wsdl_edges(facts(spark, sf_dir).classes)


@register("class_browser", f"""WITH {JX}
SELECT repo_id, class_fqn, name,
  CASE WHEN t = 0 THEN 1 WHEN t = 1 THEN 2 WHEN t = 3 THEN CASE WHEN k >= 6 THEN 3 ELSE 2 END
       WHEN t = 5 AND variant IN ('enum', 'annotation') THEN 3 ELSE 0 END AS n_fields,
  CASE WHEN t = 0 THEN 2 WHEN t = 1 THEN 2 WHEN t = 2 THEN 3 WHEN t = 4 THEN 1
       WHEN t = 5 AND variant = 'util' THEN 2 ELSE 0 END AS n_methods,
  CASE WHEN t = 2 AND has1 THEN 1 WHEN t = 5 AND variant = 'util' THEN 2 ELSE 0 END AS n_dao_operations
FROM jc""")
def q_class_browser(spark, sf_dir):
    from srcframe.operators import sqlops as S
    fx = facts(spark, sf_dir)
    b = I.class_browser(fx.classes, fx.fields, fx.methods, S.sql_ops(fx))
    return b.select("repo_id", "class_fqn", "name", "n_fields", "n_methods", "n_dao_operations")


@register("database_view", f"""WITH {JX}
SELECT repo_id, class_fqn, 'loadById' AS method, 'SELECT' AS op_type, 'SELECT i FROM item_' || k1 || ' i WHERE i.id = ?1' AS sql,
       'item_' || k1 AS tables, 'Item' || k1 AS entities FROM jc WHERE t = 2 AND has1
UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 'SELECT', 'SELECT * FROM item_' || CAST(k - 2 AS VARCHAR) || ' WHERE id = 1',
       'item_' || CAST(k - 2 AS VARCHAR), 'Item' || CAST(k - 2 AS VARCHAR) FROM jc WHERE t = 5 AND variant = 'util'
UNION ALL SELECT repo_id, class_fqn, 'auditQuery', 'UPDATE', 'UPDATE item_' || CAST(k - 2 AS VARCHAR) || ' SET name = ''x'' WHERE id = 3',
       'item_' || CAST(k - 2 AS VARCHAR), 'Item' || CAST(k - 2 AS VARCHAR) FROM jc WHERE t = 5 AND variant = 'util'""")
def q_database_view(spark, sf_dir):
    from srcframe.operators import sqlops as S
    fx = facts(spark, sf_dir)
    ops = S.sql_ops(fx)
    return I.database_view(ops, S.entity_classes(ops, fx.classes))


@register("markdown_report", f"""WITH {JX}, {CLASSES_SQL}, {FIELDS_SQL}
SELECT repo_id, class_fqn, 0 AS seq, '### ' || package || '.' || name || ' (`' || kind || '`)' AS text FROM cls
UNION ALL SELECT repo_id, class_fqn, 1, '#### Fields' FROM cls
UNION ALL SELECT repo_id, class_fqn, ordinal + 2, '- `' || visibility || CASE WHEN is_static THEN ' static' ELSE '' END
  || CASE WHEN is_final THEN ' final' ELSE '' END || ' ' || replace(replace(type, '<', '&lt;'), '>', '&gt;') || ' ' || name || '`'
  FROM fx
UNION ALL SELECT repo_id, class_fqn, 2, '- None' FROM cls WHERE class_fqn NOT IN (SELECT class_fqn FROM fx)""")
def q_markdown_report(spark, sf_dir):
    fx = facts(spark, sf_dir)
    m = I.markdown_class_lines(fx.classes, fx.fields)
    return m.select("repo_id", "class_fqn", F.col("seq").cast("int").alias("seq"), "text")
