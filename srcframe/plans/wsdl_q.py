"""Queries for WSDL endpoints (section G, host X)."""

from __future__ import annotations

from srcframe.operators import endpoints as G
from srcframe.operators import wsdl as W
from srcframe.plans.facts_q import facts
from srcframe.plans.registry import register
from srcframe.sources.adapters import wsdl_files

WX = """wx AS (
  SELECT 'ws' || CAST(s_nationkey AS VARCHAR) AS repo_id,
         'src/main/resources/wsdl/supplier' || CAST(s_suppkey AS VARCHAR) || '.wsdl' AS path,
         s_suppkey AS s, s_nationkey AS nk, unnest(range(0, s_suppkey % 3 + 1)) AS i FROM supplier)"""


@register("wsdl_operations", f"""WITH {WX}
SELECT repo_id, path, 'Supplier' || CAST(s AS VARCHAR) || 'Binding' AS binding,
       'Supplier' || CAST(s AS VARCHAR) || 'PortType' AS port_type, 'op' || CAST(i AS VARCHAR) AS operation,
       'Supplier' || CAST(s AS VARCHAR) || 'PortType/op' || CAST(i AS VARCHAR) AS op_path,
       CASE WHEN i = 1 THEN 'RPC' ELSE 'DOCUMENT' END AS style,
       'urn:n' || CAST(nk AS VARCHAR) || '/op' || CAST(i AS VARCHAR) AS soap_action, 'LITERAL' AS use,
       'urn:n' || CAST(nk AS VARCHAR) AS target_namespace FROM wx""")
def q_wsdl_operations(spark, sf_dir):
    return W.wsdl_operations(wsdl_files(spark, sf_dir)).select(
        "repo_id", "path", "binding", "port_type", "operation", "op_path", "style", "soap_action", "use",
        "target_namespace")


@register("wsdl_service_port", """SELECT 'ws' || CAST(s_nationkey AS VARCHAR) AS repo_id,
  'src/main/resources/wsdl/supplier' || CAST(s_suppkey AS VARCHAR) || '.wsdl' AS path,
  'Supplier' || CAST(s_suppkey AS VARCHAR) || 'Binding' AS binding,
  'Supplier' || CAST(s_suppkey AS VARCHAR) || 'Service' AS service_name,
  'Supplier' || CAST(s_suppkey AS VARCHAR) || 'Port' AS port_name FROM supplier""")
def q_wsdl_service_port(spark, sf_dir):
    return W.wsdl_service_port(wsdl_files(spark, sf_dir))


@register("wsdl_messages", f"""WITH {WX}
SELECT repo_id, path, 'Supplier' || CAST(s AS VARCHAR) || 'PortType' AS port_type, 'op' || CAST(i AS VARCHAR) AS operation,
       'tns:Op' || CAST(i AS VARCHAR) || 'Request' AS request_message,
       'tns:Op' || CAST(i AS VARCHAR) || 'Response' AS response_message,
       'Operation ' || CAST(i AS VARCHAR) || ' of supplier ' || CAST(s AS VARCHAR) AS documentation FROM wx""")
def q_wsdl_messages(spark, sf_dir):
    return W.wsdl_messages(wsdl_files(spark, sf_dir))


@register("all_endpoints", f"""WITH {WX}
SELECT type, count(*) AS n_endpoints FROM (
  SELECT 'SOAP' AS type FROM wx
  UNION ALL SELECT 'REST' FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT 'REST' FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT 'SOAP' FROM part WHERE p_partkey % 6 = 4) GROUP BY type""")
def q_all_endpoints(spark, sf_dir):
    from pyspark.sql import functions as F
    ann = G.endpoints(facts(spark, sf_dir)).select("type")
    ws = W.wsdl_endpoints(wsdl_files(spark, sf_dir)).select("type")
    return ann.unionByName(ws).groupBy("type").agg(F.count(F.lit(1)).alias("n_endpoints"))


@register("combine_endpoints", f"""WITH {WX}
SELECT source, count(*) AS n FROM (
  SELECT 'wsdl' AS source FROM (SELECT DISTINCT repo_id, nk, i FROM wx)
  UNION ALL SELECT 'annotation' FROM part WHERE p_partkey % 6 = 4) GROUP BY source""")
def q_combine_endpoints(spark, sf_dir):
    from pyspark.sql import functions as F
    c = W.combine_endpoints(G.endpoints(facts(spark, sf_dir)), W.wsdl_endpoints(wsdl_files(spark, sf_dir)))
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


XX = """xx AS (
  SELECT 'ws' || CAST(s_nationkey AS VARCHAR) AS repo_id,
         'src/main/resources/xsd/supplier' || CAST(s_suppkey AS VARCHAR) || '.xsd' AS path,
         s_suppkey AS s, s_suppkey % 8 AS l, unnest(range(0, s_suppkey % 8 + 1)) AS j FROM supplier)"""


@register("xsd_elements", f"""WITH {XX}
SELECT repo_id, path, 'S' || CAST(s AS VARCHAR) || 'E' || CAST(j AS VARCHAR) AS element, 'child' AS member_kind,
       0 AS ordinal, NULL::VARCHAR AS name, 'S' || CAST(s AS VARCHAR) || 'E' || CAST(j + 1 AS VARCHAR) AS ref,
       NULL::VARCHAR AS type, '0' AS min_occurs, CASE WHEN j % 2 = 1 THEN 'unbounded' ELSE '1' END AS max_occurs,
       NULL::VARCHAR AS use FROM xx WHERE j < l
UNION ALL
SELECT repo_id, path, 'S' || CAST(s AS VARCHAR) || 'E' || CAST(j AS VARCHAR), 'child', CASE WHEN j < l THEN 1 ELSE 0 END,
       'code', NULL, 'xs:string', '1', '1', NULL FROM xx
UNION ALL
SELECT repo_id, path, 'S' || CAST(s AS VARCHAR) || 'E' || CAST(j AS VARCHAR), 'attribute', 0,
       CASE WHEN j % 2 = 0 THEN 'id' ELSE 'note' END, NULL, CASE WHEN j % 2 = 0 THEN 'xs:int' ELSE 'xs:string' END,
       NULL, NULL, CASE WHEN j % 2 = 0 THEN 'required' ELSE 'optional' END FROM xx""")
def q_xsd_elements(spark, sf_dir):
    from pyspark.sql import functions as F
    from srcframe.sources.adapters import xsd_files
    e = W.xsd_elements(xsd_files(spark, sf_dir))
    return e.select("repo_id", "path", "element", "member_kind", F.col("ordinal").cast("int").alias("ordinal"),
                    "name", "ref", "type", "min_occurs", "max_occurs", "use")


@register("xsd_expand", f"""WITH {XX},
roots AS (SELECT repo_id, path, s, l, j AS r FROM xx)
SELECT repo_id, path, 'S' || CAST(s AS VARCHAR) || 'E' || CAST(r AS VARCHAR) AS root,
       'S' || CAST(s AS VARCHAR) || 'E' || CAST(r + d AS VARCHAR) AS element, CAST(d AS INTEGER) AS depth
FROM (SELECT *, unnest(range(0, l - r + 1)) AS d FROM roots)""")
def q_xsd_expand(spark, sf_dir):
    from pyspark.sql import functions as F
    from srcframe.sources.adapters import xsd_files
    x = W.xsd_expand(W.xsd_elements(xsd_files(spark, sf_dir)))
    return x.select("repo_id", "path", "root", "element", F.col("depth").cast("int").alias("depth"))


@register("wsdl_message_part", f"""WITH {WX}
SELECT repo_id, path, 'Op' || CAST(i AS VARCHAR) || m AS message, 'parameters' AS part_name,
       'tns:Op' || CAST(i AS VARCHAR) || e AS part_element
FROM wx, (VALUES ('Request', 'Req'), ('Response', 'Resp')) v(m, e)""")
def q_wsdl_message_part(spark, sf_dir):
    return W.wsdl_message_part(wsdl_files(spark, sf_dir))


@register("wsdl_operation_details", f"""WITH {WX}
SELECT repo_id, path, 'Supplier' || CAST(s AS VARCHAR) || 'PortType' AS port_type, 'op' || CAST(i AS VARCHAR) AS operation,
       'Operation ' || CAST(i AS VARCHAR) || ' of supplier ' || CAST(s AS VARCHAR) AS documentation,
       'tns:Op' || CAST(i AS VARCHAR) || 'Request' AS request_message, 'tns:Op' || CAST(i AS VARCHAR) || 'Response' AS response_message,
       'tns:Op' || CAST(i AS VARCHAR) || 'Req' AS request_element, 'tns:Op' || CAST(i AS VARCHAR) || 'Resp' AS response_element
FROM wx""")
def q_wsdl_operation_details(spark, sf_dir):
    return W.wsdl_operation_details(wsdl_files(spark, sf_dir))
