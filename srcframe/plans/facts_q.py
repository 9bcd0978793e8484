"""Queries for section B (lexical facts), host R.

The Spark side renders Java sources from ``part`` and extracts facts by
parsing; the SQL side computes the expected facts from the same ``part``
columns directly (a round trip, never a parse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.functions.text import annotation_attr
from srcframe.operators import facts as B
from srcframe.plans.registry import register
from srcframe.sources.adapters import java_files




_FACTS: dict = {}


def facts(spark, sf_dir) -> B.JavaFacts:
    """Fact tables of the rendered corpus, built on first use and shared by
    every query of the same session and data directory (the tables persist,
    so the scan and extraction run once per session)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = B.java_facts(java_files(spark, sf_dir))
    return _FACTS[key]



# --------------------------------------------------------------- SQL base

JX = """pp AS (
  SELECT p.p_partkey AS k, p.p_size AS s, p.p_partkey - p.p_partkey % 6 AS h, p.p_partkey % 6 AS t,
         'repo' || CAST(coalesce(hd.p_size, 0) % 10 AS VARCHAR) AS repo_id,
         'com.acme.c' || CAST(p.p_partkey - p.p_partkey % 6 AS VARCHAR) AS pkg,
         n1.p_partkey IS NOT NULL AS has1, n2.p_partkey IS NOT NULL AS has2,
         n3.p_partkey IS NOT NULL AS has3
  FROM part p
  LEFT JOIN part hd ON hd.p_partkey = p.p_partkey - p.p_partkey % 6
  LEFT JOIN part n1 ON n1.p_partkey = p.p_partkey + 1
  LEFT JOIN part n2 ON n2.p_partkey = p.p_partkey + 2
  LEFT JOIN part n3 ON n3.p_partkey = p.p_partkey + 3),
jx AS (
  SELECT *, CAST(k AS VARCHAR) AS ks, CAST(k + 1 AS VARCHAR) AS k1, CAST(k + 2 AS VARCHAR) AS k2,
         CAST(k + 3 AS VARCHAR) AS k3,
         'Item' || CAST(k AS VARCHAR) || CASE t WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service'
           WHEN 2 THEN 'Repository' WHEN 3 THEN '' WHEN 4 THEN 'Endpoint' ELSE 'Util' END AS name,
         CASE WHEN t < 5 THEN 'type' WHEN s % 2 = 0 THEN 'enum' WHEN s % 3 = 0 THEN 'annotation'
           ELSE 'util' END AS variant
  FROM pp),
jc AS (
  SELECT *, pkg || '.' || name AS class_fqn,
         'src/main/java/com/acme/c' || CAST(h AS VARCHAR) || '/' || name || '.java' AS path
  FROM jx)"""


def _sql(body: str) -> str:
    return f"WITH {JX},\n{body}"


# ----------------------------------------------------------------- B1/B4/B12

CLASSES_SQL = """cls AS (
  SELECT repo_id, path, pkg AS package, name, class_fqn,
         t = 2 AS is_interface, false AS is_abstract,
         CASE t WHEN 0 THEN '@RestController' WHEN 1 THEN '@Service' WHEN 2 THEN '@Repository'
           WHEN 3 THEN '@Entity|@Table(name = "item_' || ks || '")'
           WHEN 4 THEN '@WebService(targetNamespace = "urn:item' || ks || '", serviceName = "Item' || ks || 'Service")'
           ELSE CASE WHEN variant = 'annotation' THEN '@Retention(RetentionPolicy.RUNTIME)' ELSE '' END END
           AS annotations,
         CASE t WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' WHEN 3 THEN 'entity'
           WHEN 4 THEN 'service' ELSE CASE variant WHEN 'enum' THEN 'enum' WHEN 'annotation' THEN 'annotation'
           ELSE 'class' END END AS kind,
         CASE WHEN t = 2 THEN 'JpaRepository<Item' || k1 || ', Long>' END AS parent,
         CASE WHEN t = 2 THEN 'JpaRepository<Item' || k1 || ', Long>' ELSE '' END AS interfaces
  FROM jc)"""


def _classes(spark, sf_dir):
    return facts(spark, sf_dir).classes


@register("extract_classes", _sql(CLASSES_SQL + """
SELECT repo_id, path, package, name, is_interface, is_abstract, annotations FROM cls"""))
def q_extract_classes(spark, sf_dir):
    c = _classes(spark, sf_dir)
    return c.select("repo_id", "path", "package", "name", "is_interface", "is_abstract",
                    F.array_join("annotations", "|").alias("annotations"))


@register("classify_kind", _sql(CLASSES_SQL + """
SELECT repo_id, class_fqn, kind FROM cls"""))
def q_classify_kind(spark, sf_dir):
    return _classes(spark, sf_dir).select("repo_id", "class_fqn", "kind")


@register("extract_supertypes", _sql(CLASSES_SQL + """
SELECT repo_id, class_fqn, parent, interfaces FROM cls"""))
def q_extract_supertypes(spark, sf_dir):
    return _classes(spark, sf_dir).select("repo_id", "class_fqn", "parent",
                                          F.array_join("interfaces", "|").alias("interfaces"))


# ----------------------------------------------------------------- B2/B3/B5/B6

FIELDS_SQL = """fx AS (
  SELECT repo_id, class_fqn, 0 AS ordinal, 'service' AS name, 'Item' || k1 || 'Service' AS type, '' AS annotations,
         'private' AS visibility, false AS is_static, true AS is_final, NULL::VARCHAR AS initializer FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 0, 'log', 'Logger', '', 'private', true, true, NULL FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 1, 'repository', 'Item' || k1 || 'Repository', '', 'private', false, false, NULL
    FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 0, 'id', 'Long', '@Id', 'private', false, false, NULL FROM jc WHERE t = 3
  UNION ALL SELECT repo_id, class_fqn, 1, 'name', 'String', '', 'private', false, false, NULL FROM jc WHERE t = 3
  UNION ALL SELECT repo_id, class_fqn, 2, 'parent', 'Item' || CAST(k - 6 AS VARCHAR), '@ManyToOne', 'private', false, false,
    NULL FROM jc WHERE t = 3 AND k >= 6
  UNION ALL SELECT repo_id, class_fqn, o, c, name, '', 'public', true, true, NULL
    FROM jc, (VALUES (0, 'ALPHA'), (1, 'BETA'), (2, 'GAMMA')) v(o, c) WHERE t = 5 AND variant = 'enum'
  UNION ALL SELECT repo_id, class_fqn, 0, 'value', 'String', '', 'public', false, false, '"item' || ks || '"'
    FROM jc WHERE t = 5 AND variant = 'annotation'
  UNION ALL SELECT repo_id, class_fqn, 1, 'priority', 'int', '', 'public', false, false, CAST(s AS VARCHAR)
    FROM jc WHERE t = 5 AND variant = 'annotation'
  UNION ALL SELECT repo_id, class_fqn, 2, 'enabled', 'boolean', '', 'public', false, false, NULL
    FROM jc WHERE t = 5 AND variant = 'annotation')"""


def _fields(spark, sf_dir):
    return facts(spark, sf_dir)["fields"]


def _field_cols():
    return ["repo_id", "class_fqn", "ordinal", "name", F.col("declared_type").alias("type"),
            F.array_join("annotations", "|").alias("annotations"), "visibility", "is_static", "is_final"]


@register("extract_fields", _sql(FIELDS_SQL + """
SELECT repo_id, class_fqn, ordinal, name, type, annotations, visibility, is_static, is_final FROM fx
WHERE class_fqn NOT IN (SELECT class_fqn FROM jc WHERE t = 5 AND variant IN ('enum', 'annotation'))"""))
def q_extract_fields(spark, sf_dir):
    fx = facts(spark, sf_dir)
    f = fx.fields
    c = fx.classes.where(F.col("kind").isin("enum", "annotation")).select("repo_id", "class_fqn")
    return f.join(c, ["repo_id", "class_fqn"], "left_anti").select(*_field_cols())


@register("extract_enums", _sql(FIELDS_SQL + """
SELECT f.repo_id, f.class_fqn, f.ordinal, f.name, f.type, f.visibility, f.is_static, f.is_final
FROM fx f JOIN jc ON jc.class_fqn = f.class_fqn AND jc.repo_id = f.repo_id WHERE jc.t = 5 AND jc.variant = 'enum'"""))
def q_extract_enums(spark, sf_dir):
    fx = facts(spark, sf_dir)
    f = fx.fields
    c = fx.classes.where(F.col("kind") == "enum").select("repo_id", "class_fqn")
    return f.join(c, ["repo_id", "class_fqn"], "left_semi").select(
        "repo_id", "class_fqn", "ordinal", "name", F.col("declared_type").alias("type"), "visibility",
        "is_static", "is_final")


@register("extract_annotation_decls", _sql(FIELDS_SQL + """
SELECT f.repo_id, f.class_fqn, f.ordinal, f.name, f.type, f.initializer
FROM fx f JOIN jc ON jc.class_fqn = f.class_fqn AND jc.repo_id = f.repo_id
WHERE jc.t = 5 AND jc.variant = 'annotation'"""))
def q_extract_annotation_decls(spark, sf_dir):
    fx = facts(spark, sf_dir)
    f = fx.fields
    c = fx.classes.where(F.col("kind") == "annotation").select("repo_id", "class_fqn")
    return f.join(c, ["repo_id", "class_fqn"], "left_semi").select(
        "repo_id", "class_fqn", "ordinal", "name", F.col("declared_type").alias("type"), "initializer")


# ----------------------------------------------------------------- B7/B8

METHODS_SQL = """mx AS (
  SELECT repo_id, class_fqn, 0 AS ordinal, 'getItem' AS name, 'String' AS return_type, 'Long id' AS params,
         '@GetMapping("/items/' || ks || '/{id}")' AS annotations, '' AS throws, 'public' AS visibility,
         '@PathVariable("id")' AS p0_ann FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 1, 'createItem', 'String', 'Item' || k3 || ' body',
         '@PostMapping(value = "/items/' || ks || '")', '', 'public', '@RequestBody' FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 0, 'process', 'String', 'Long id', '', '', 'public', '' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 1, 'save', 'String', 'Item' || k2 || ' body', '', '', 'public', ''
    FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 0, 'findByNameAndStatus', 'List<Item' || k1 || '>',
         'String name, String status', '', '', 'default', '' FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 1, 'saveItem', 'Item' || k1, 'Item' || k1 || ' item', '', '', 'default', ''
    FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 2, 'loadById', 'Item' || k1, 'Long id',
         '@Query("SELECT i FROM item_' || k1 || ' i WHERE i.id = ?1")', '', 'default', '' FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 0, 'getItem', 'String', 'String id',
         '@WebMethod(operationName = "getItem' || ks || '")', '', 'public', '' FROM jc WHERE t = 4
  UNION ALL SELECT repo_id, class_fqn, 0, 'executeAudit', 'void', 'Connection conn', '', 'Exception', 'public', ''
    FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 1, 'auditQuery', 'String', '', '', '', 'public', ''
    FROM jc WHERE t = 5 AND variant = 'util')"""


def _methods(spark, sf_dir):
    return facts(spark, sf_dir)["methods"]


@register("extract_methods", _sql(METHODS_SQL + """
SELECT repo_id, class_fqn, ordinal, name, return_type, params, annotations, throws,
       false AS is_static, false AS is_abstract FROM mx"""))
def q_extract_methods(spark, sf_dir):
    m = _methods(spark, sf_dir)
    return m.select("repo_id", "class_fqn", "ordinal", "name", "return_type",
                    F.array_join("param_texts", ", ").alias("params"),
                    F.array_join("annotations", "|").alias("annotations"),
                    F.array_join("throws", ", ").alias("throws"), "is_static", "is_abstract")


@register("visibility", _sql(FIELDS_SQL + ",\n" + METHODS_SQL + """
SELECT repo_id, class_fqn, 'field' AS member_kind, name AS member, visibility FROM fx
UNION ALL SELECT repo_id, class_fqn, 'method', name, visibility FROM mx"""))
def q_visibility(spark, sf_dir):
    fx = facts(spark, sf_dir)
    f = fx["fields"].select("repo_id", "class_fqn", F.lit("field").alias("member_kind"),
                            F.col("name").alias("member"), "visibility")
    m = fx["methods"].select("repo_id", "class_fqn", F.lit("method").alias("member_kind"),
                             F.col("name").alias("member"), "visibility")
    return f.unionByName(m)


@register("extract_param_annotations", _sql(METHODS_SQL + """
SELECT repo_id, class_fqn, name AS method_name, 0 AS param_no, p0_ann AS annotations FROM mx WHERE params <> ''
UNION ALL
SELECT repo_id, class_fqn, name, 1, '' FROM mx WHERE params LIKE '%,%'"""))
def q_extract_param_annotations(spark, sf_dir):
    m = _methods(spark, sf_dir)
    return m.select("repo_id", "class_fqn", F.col("name").alias("method_name"),
                    F.posexplode("params").alias("param_no", "p")) \
        .select("repo_id", "class_fqn", "method_name", F.col("param_no").cast("int").alias("param_no"),
                F.array_join("p.annotations", "|").alias("annotations"))


# ----------------------------------------------------------------- B9/B10/B11

LOCALS_SQL = """lx AS (
  SELECT repo_id, class_fqn, 'getItem' AS method_name, 0 AS ordinal, 'String' AS type, 'note' AS name
    FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 'process', 0, 'String',
    CASE s % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'cardNumber' ELSE 'count' END FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 0, 'String', 'sql' FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 1, 'String', 'copy' FROM jc WHERE t = 5 AND variant = 'util')"""


@register("extract_locals", _sql(LOCALS_SQL + """
SELECT * FROM lx"""))
def q_extract_locals(spark, sf_dir):
    lo = facts(spark, sf_dir)["locals"]
    return lo.select("repo_id", "class_fqn", "method_name", "ordinal", "type", "name")


CALLS_SQL = """cx AS (
  SELECT repo_id, class_fqn, 'getItem' AS method_name, 0 AS ordinal, 'process' AS name, 'service' AS scope,
         CASE WHEN has1 THEN pkg || '.Item' || k1 || 'Service.process(java.lang.Long)'
              ELSE 'UNRESOLVED_CALL: service.process(java.lang.Long)' END AS callee_sig FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 'createItem', 0, 'save', 'service',
         CASE WHEN has1 THEN pkg || '.Item' || k1 || 'Service.save(' || pkg || '.Item' || k3 || ')'
              ELSE 'UNRESOLVED_CALL: service.save(UNKNOWN_PARAM_TYPE)' END FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, class_fqn, 'process', 0, 'info', 'log',
         'UNRESOLVED_CALL: log.info(java.lang.String, java.lang.Long, java.lang.String)' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 'process', 1, 'findById', 'repository',
         'UNRESOLVED_CALL: ' || CASE WHEN has1 THEN pkg || '.Item' || k1 || 'Repository' ELSE 'repository' END
           || '.findById(java.lang.Long)' FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 'save', 0, 'println', 'System.out',
         'UNRESOLVED_CALL: System.out.println(java.lang.String)' FROM jc WHERE t = 1 AND s % 7 = 0
  UNION ALL SELECT repo_id, class_fqn, 'save', CASE WHEN s % 7 = 0 THEN 1 ELSE 0 END, 'save', 'repository',
         'UNRESOLVED_CALL: ' || CASE WHEN has1 THEN pkg || '.Item' || k1 || 'Repository' ELSE 'repository' END
           || '.save(' || CASE WHEN has2 THEN pkg || '.Item' || k2 ELSE 'UNKNOWN_PARAM_TYPE' END || ')'
    FROM jc WHERE t = 1
  UNION ALL SELECT repo_id, class_fqn, 'getItem', 0, 'trim', 'id', 'UNRESOLVED_CALL: java.lang.String.trim()'
    FROM jc WHERE t = 4
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 0, 'prepareStatement', 'conn',
         'UNRESOLVED_CALL: conn.prepareStatement(java.lang.String)' FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 1, 'createStatement', 'conn',
         'UNRESOLVED_CALL: conn.createStatement()' FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 2, 'executeQuery', 'conn.createStatement()',
         'UNRESOLVED_CALL: conn.createStatement().executeQuery(java.lang.String)'
    FROM jc WHERE t = 5 AND variant = 'util')"""


def _calls(spark, sf_dir):
    return facts(spark, sf_dir)["calls"]


@register("extract_calls", _sql(CALLS_SQL + """
SELECT repo_id, class_fqn, method_name, ordinal, name, scope FROM cx"""))
def q_extract_calls(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return c.select("repo_id", "class_fqn", "method_name", "ordinal", "name", "scope")


@register("qualify_calls", _sql(CALLS_SQL + """
SELECT repo_id, class_fqn, method_name, ordinal, callee_sig FROM cx"""))
def q_qualify_calls(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return c.select("repo_id", "class_fqn", "method_name", "ordinal", "callee_sig")


# ----------------------------------------------------------------- B13

ATTRS = ["value", "name", "operationName", "targetNamespace", "serviceName"]


def _attr_sql(col: str, a: str) -> str:
    ws = "[ \\t\\r\\n\\f]"
    return (f"CASE WHEN regexp_matches({col}, '\\b{a}{ws}*={ws}*\"') "
            f"THEN regexp_extract({col}, '\\b{a}{ws}*={ws}*\"([^\"]*)\"', 1) "
            f"WHEN regexp_matches({col}, '\\b{a}{ws}*=') "
            f"THEN regexp_extract({col}, '\\b{a}{ws}*={ws}*([^ \\t\\r\\n\\f,)\"]*)', 1) END")


@register("annotation_attr", _sql(CLASSES_SQL + ",\n" + METHODS_SQL + """,
anns AS (
  SELECT DISTINCT unnest(string_split(annotations, '|')) AS annotation FROM cls WHERE annotations <> ''
  UNION SELECT DISTINCT unnest(string_split(annotations, '|')) FROM mx WHERE annotations <> ''
  UNION SELECT '@SoapAction(value=urn:x, required = true)'
  UNION SELECT '@RequestMapping(name = "a", value = "/b")'
  UNION SELECT '@Foo(operationNameX = "q")'),
av AS (
  """ + "\n  UNION ALL ".join(
    f"SELECT annotation, '{a}' AS attr, {_attr_sql('annotation', a)} AS value FROM anns" for a in ATTRS) + """)
SELECT DISTINCT annotation, attr, value FROM av WHERE value IS NOT NULL"""))
def q_annotation_attr(spark, sf_dir):
    fx = facts(spark, sf_dir)
    anns = (fx["classes"].select(F.explode("annotations").alias("annotation"))
            .unionByName(fx["methods"].select(F.explode("annotations").alias("annotation")))
            .unionByName(spark.createDataFrame(
                [("@SoapAction(value=urn:x, required = true)",), ('@RequestMapping(name = "a", value = "/b")',),
                 ('@Foo(operationNameX = "q")',)], "annotation string"))
            .distinct())
    rows = None
    for a in ATTRS:
        r = anns.select("annotation", F.lit(a).alias("attr"), annotation_attr(F.col("annotation"), a).alias("value"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.where(F.col("value").isNotNull()).distinct()
