"""Queries for SOAP classes and schema imports (section G, hosts W and Y)."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcframe.operators import facts as B
from srcframe.operators import soap as P
from srcframe.operators import wsdl as W
from srcframe.plans.registry import register
from srcframe.sources.adapters import schema_files, soap_files

_FACTS: dict = {}


def soap_facts(spark, sf_dir) -> B.JavaFacts:
    """Facts of the rendered SOAP sources, one set per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS.clear()
        _FACTS[key] = B.java_facts(soap_files(spark, sf_dir))
    return _FACTS[key]


SX = """sx AS (
  SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS ks, p_size AS s, p_partkey % 6 AS v,
         'soap' || CAST(p_partkey % 5 AS VARCHAR) AS repo_id,
         'com.acme.impl.Svc' || CAST(p_partkey AS VARCHAR) AS impl, 'com.acme.api.Port' || CAST(p_partkey AS VARCHAR) AS port,
         'urn:impl' || CAST(p_partkey AS VARCHAR) AS own_ns, 'Svc' || CAST(p_partkey AS VARCHAR) || 'Service' AS own_service
  FROM part)"""

# methods: class, name, arity, annotations, ordinal
METHODS = """ms AS (
  SELECT repo_id, ks, v, impl AS class_fqn, 'find' AS m, 2 AS arity, 0 AS ord, '' AS own,
         '@WebMethod(operationName = "find' || ks || '")|@RequestWrapper(localName = "find", className = "com.acme.api.Find' || ks || '")' AS sei
  FROM sx WHERE v = 0
  UNION ALL SELECT repo_id, ks, v, port, 'find', 2, 0,
         '@WebMethod(operationName = "find' || ks || '")|@RequestWrapper(localName = "find", className = "com.acme.api.Find' || ks || '")', ''
  FROM sx WHERE v = 0
  UNION ALL SELECT repo_id, ks, v, impl, 'find', i, i - 1, '', '@WebMethod(operationName = "' || w || ks || '")'
  FROM sx, (VALUES (1, 'one'), (2, 'two')) n(i, w) WHERE v = 1
  UNION ALL SELECT repo_id, ks, v, port, 'find', i, i - 1, '@WebMethod(operationName = "' || w || ks || '")', ''
  FROM sx, (VALUES (1, 'one'), (2, 'two')) n(i, w) WHERE v = 1
  UNION ALL SELECT repo_id, ks, v, impl, m, n, o, a, ''
  FROM sx, (VALUES (2, 'put', 2, 0, '@WebMethod'), (2, 'del', 3, 1, '@WebMethod|@WebResult(name = "trace", header = true)'),
                   (3, 'save', 1, 0, '@WebMethod'), (3, 'ask', 2, 1, '@WebMethod|@WebResult(header = true)'),
                   (3, 'one', 1, 2, '@WebMethod')) x(vv, m, n, o, a) WHERE v = vv
  UNION ALL SELECT repo_id, ks, v, impl, 'pay', 2, 0,
         '@PayloadRoot(namespace = "urn:pay' || ks || '", localPart = "Pay' || ks || '")', '' FROM sx WHERE v = 4)"""


@register("sei_overlay", f"""WITH {SX}
SELECT repo_id, impl AS class_fqn, CASE WHEN v < 2 THEN port END AS sei_fqn,
       CASE WHEN v < 2 THEN 'api/src/com/acme/api/Port' || ks || '.java' END AS sei_path,
       CASE v WHEN 0 THEN 'urn:api' || ks WHEN 4 THEN NULL ELSE own_ns END AS target_namespace,
       CASE v WHEN 0 THEN 'Port' || ks || 'Type' END AS port_type_name, CASE v WHEN 0 THEN 'P' || ks END AS port_name,
       CASE v WHEN 1 THEN 'Api' || ks WHEN 4 THEN NULL ELSE own_service END AS service_name FROM sx WHERE v < 5
UNION ALL
SELECT repo_id, port, NULL, NULL, CASE v WHEN 0 THEN 'urn:api' || ks END, CASE v WHEN 0 THEN 'Port' || ks || 'Type' END, NULL,
       CASE v WHEN 1 THEN 'Api' || ks END FROM sx WHERE v < 2""")
def q_sei_overlay(spark, sf_dir):
    return P.overlay_of(soap_facts(spark, sf_dir)).select(
        "repo_id", "class_fqn", "sei_fqn", "sei_path", "target_namespace", "port_type_name", "port_name", "service_name")


@register("sei_method_merge", f"""WITH {SX},
{METHODS}
SELECT repo_id, class_fqn, m AS method_name, CAST(arity AS INTEGER) AS arity,
       own || CASE WHEN own != '' AND sei != '' THEN '|' ELSE '' END || sei AS annotations FROM ms""")
def q_sei_method_merge(spark, sf_dir):
    return P.merged_methods(soap_facts(spark, sf_dir)).select(
        "repo_id", "class_fqn", "method_name", F.col("arity").cast("int").alias("arity"), F.array_join("merged", "|").alias("annotations"))


@register("soap_headers", f"""WITH {SX}
SELECT impl || '.' || m AS handler, direction, h || CASE WHEN v = 4 THEN ks ELSE '' END AS header, t AS type
FROM sx, (VALUES (2, 'put', 'request', 'auth', 'Token'), (2, 'del', 'request', 'p', 'B'), (2, 'del', 'response', 'trace', 'Trace'),
                 (3, 'ask', 'response', 'return', 'String'), (3, 'one', 'request', 't', 'Token'),
                 (4, 'pay', 'request', 'sig', 'Sig')) x(vv, m, direction, h, t) WHERE v = vv""")
def q_soap_headers(spark, sf_dir):
    e = P.soap_endpoints(soap_facts(spark, sf_dir))
    rows = [e.select("handler", F.lit(d).alias("direction"), F.explode(f"{d}_headers").alias("header", "type"))
            for d in ("request", "response")]
    return rows[0].unionByName(rows[1])


@register("soap_body_types", f"""WITH {SX}
SELECT impl || '.' || m AS handler, CASE v WHEN 4 THEN 'Pay' || ks ELSE m END AS operation_name,
       CASE v WHEN 2 THEN 'BARE' END AS parameter_style, replace(rq, '#', ks) AS request_body_type,
       replace(rs, '#', ks) AS response_body_type
FROM sx, (VALUES (0, 'find', 'findRequest', 'String'), (1, 'find', 'String', 'String'),
                 (2, 'put', 'Map<String, Order#>', 'Reply#'), (2, 'del', 'A', 'Trace'),
                 (3, 'save', 'Order#', NULL), (3, 'ask', 'askRequest', 'askResponse'), (3, 'one', NULL, 'int'),
                 (4, 'pay', 'payRequest', 'Ack')) x(vv, m, rq, rs) WHERE v = vv
UNION ALL
SELECT port || '.find', replace(op, '#', ks), NULL, replace(rq, '#', ks), 'String'
FROM sx, (VALUES (0, 'find#', 'com.acme.api.Find#'), (1, 'one#', 'String'), (1, 'two#', 'findRequest')) x(vv, op, rq) WHERE v = vv""")
def q_soap_body_types(spark, sf_dir):
    return P.soap_endpoints(soap_facts(spark, sf_dir)).select(
        "handler", "operation_name", "parameter_style", "request_body_type", "response_body_type")


@register("wsdl_bean_defs", f"""WITH {SX}
SELECT repo_id, CASE WHEN s % 3 = 0 THEN 'orders' || ks ELSE 'urn:w' || ks END AS wsdl_key,
       CASE WHEN s % 3 = 0 THEN 'bean' ELSE 'namespace' END AS keyed_by, 'orders' || ks AS bean_name,
       'Orders' || ks AS port_type_name, CASE WHEN s % 3 != 0 THEN 'urn:w' || ks END AS target_namespace,
       CASE WHEN s % 3 = 0 THEN '/ws' END AS location_uri, impl AS class_fqn FROM sx WHERE v = 5""")
def q_wsdl_bean_defs(spark, sf_dir):
    return P.wsdl_bean_defs(soap_facts(spark, sf_dir)).drop("path")


JAXWS_SOAP = f"""SELECT repo_id, class_fqn, m AS method_name,
       CASE v WHEN 0 THEN 'find' || ks WHEN 1 THEN CASE arity WHEN 1 THEN 'one' ELSE 'two' END || ks ELSE m END AS operation_name,
       CASE WHEN v = 0 THEN 'urn:api' || ks WHEN class_fqn LIKE 'com.acme.impl.%' THEN 'urn:impl' || ks END AS target_namespace,
       CASE WHEN v = 1 THEN 'Api' || ks WHEN class_fqn LIKE 'com.acme.impl.%' THEN 'Svc' || ks || 'Service' END AS service_name
FROM ms WHERE v < 4"""


# ------------------------------------------------------------ schema imports

YX = """yx AS (
  SELECT s_suppkey AS s, CAST(s_suppkey AS VARCHAR) AS ss, 'xs' || CAST(s_suppkey % 5 AS VARCHAR) AS repo_id,
         (s_suppkey // 5) % 4 AS place, CASE WHEN (s_suppkey // 5) % 4 < 3 THEN s_suppkey + 5 ELSE s_suppkey - 15 END AS nxt
  FROM supplier),
yi AS (
  SELECT y.*, n.s_suppkey IS NOT NULL AS there, 'src/main/resources/xsd/types/t' || ss || '.xsd' AS xsd,
         'src/main/resources/xsd/types/t' || CAST(nxt AS VARCHAR) || '.xsd' AS nxt_xsd FROM yx y LEFT JOIN supplier n ON n.s_suppkey = y.nxt)"""


@register("xsd_import_resolve", f"""WITH {YX}
SELECT repo_id, 'svc/s' || ss || '/main.wsdl' AS path, 0 AS ordinal, 'urn:t' || ss AS namespace,
       'types/t' || ss || '.xsd' AS schema_location, xsd AS resolved_path, 'suffix' AS matched, 'urn:t' || ss AS store_key FROM yi
UNION ALL SELECT repo_id, 'svc/s' || ss || '/main.wsdl', 1, NULL, 'missing' || ss || '.xsd', NULL, NULL, NULL FROM yi
UNION ALL SELECT repo_id, xsd, 0, CASE WHEN place != 2 THEN 'urn:t' || CAST(nxt AS VARCHAR) END,
       CASE WHEN place = 2 THEN '../types/' ELSE '' END || 't' || CAST(nxt AS VARCHAR) || '.xsd',
       CASE WHEN there THEN nxt_xsd END, CASE WHEN there THEN 'relative' END,
       CASE WHEN there THEN CASE WHEN place != 2 THEN 'urn:t' || CAST(nxt AS VARCHAR) ELSE nxt_xsd END END FROM yi""")
def q_xsd_import_resolve(spark, sf_dir):
    return W.xsd_import_resolve(schema_files(spark, sf_dir))


@register("xsd_import_closure", f"""WITH RECURSIVE {YX},
walk(s0, s, depth) AS (
  SELECT s, s, 1 FROM yi
  UNION ALL SELECT w.s0, y.nxt, w.depth + 1 FROM walk w JOIN yi y ON y.s = w.s WHERE y.there AND w.depth < 4)
SELECT 'xs' || CAST(s0 % 5 AS VARCHAR) AS repo_id, 'svc/s' || CAST(s0 AS VARCHAR) || '/main.wsdl' AS root,
       'src/main/resources/xsd/types/t' || CAST(s AS VARCHAR) || '.xsd' AS path, CAST(depth AS INTEGER) AS depth FROM walk""")
def q_xsd_import_closure(spark, sf_dir):
    return W.xsd_import_closure(W.xsd_import_resolve(schema_files(spark, sf_dir)))
