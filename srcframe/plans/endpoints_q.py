"""Queries for section G (endpoints), hosts R and V."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.operators import endpoints as G
from srcframe.operators.soap import jaxws_endpoints
from srcframe.plans.facts_q import JX, facts
from srcframe.plans.registry import register
from srcframe.plans.soap_q import JAXWS_SOAP, METHODS, SX, soap_facts
from srcframe.plans.sqlsnip import s

EPX = """ep AS (
  SELECT repo_id, 'REST' AS type, class_fqn, 'getItem' AS method_name, class_fqn || '.getItem' AS handler,
         'GET' AS http_method, '/items/' || ks || '/{id}' AS path, 'id' AS path_variables, '' AS request_params,
         NULL::VARCHAR AS request_body_type, 'String' AS response_body_type, NULL::VARCHAR AS http_status,
         NULL::VARCHAR AS operation_name, NULL::VARCHAR AS target_namespace, NULL::VARCHAR AS service_name
  FROM jc WHERE t = 0
  UNION ALL
  SELECT repo_id, 'REST', class_fqn, 'createItem', class_fqn || '.createItem', 'POST', '/items/' || ks, '', '',
         'Item' || k3, 'String', NULL, NULL, NULL, NULL FROM jc WHERE t = 0
  UNION ALL
  SELECT repo_id, 'SOAP', class_fqn, 'getItem', class_fqn || '.getItem', NULL,
         'Item' || ks || 'Service/getItem' || ks, '', '', 'String', 'String', NULL,
         'getItem' || ks, 'urn:item' || ks, 'Item' || ks || 'Service' FROM jc WHERE t = 4)"""

EP_COLS = ("repo_id, type, class_fqn, method_name, handler, http_method, path, path_variables, request_params, "
           "request_body_type, response_body_type, http_status, operation_name, target_namespace, service_name")


def _eps(spark, sf_dir) -> DataFrame:
    return G.endpoints(facts(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("repo_id", "type", "class_fqn", "method_name", "handler", "http_method", "path",
                     F.array_join("path_variables", ",").alias("path_variables"),
                     F.array_join("request_params", ",").alias("request_params"), "request_body_type",
                     "response_body_type", "http_status", "operation_name", "target_namespace", "service_name")


@register("rest_endpoints", f"WITH {JX},\n{EPX}\nSELECT {EP_COLS} FROM ep WHERE type = 'REST'")
def q_rest_endpoints(spark, sf_dir):
    return _flat(G.rest_endpoints(facts(spark, sf_dir)))


@register("rest_params", f"""WITH {JX},
{EPX}
SELECT handler, http_method, path_variables, request_params, request_body_type FROM ep WHERE type = 'REST'""")
def q_rest_params(spark, sf_dir):
    return _flat(G.rest_endpoints(facts(spark, sf_dir))).select(
        "handler", "http_method", "path_variables", "request_params", "request_body_type")


@register("soap_endpoints", f"WITH {JX},\n{EPX}\nSELECT {EP_COLS} FROM ep WHERE type = 'SOAP'")
def q_soap_endpoints(spark, sf_dir):
    return _flat(G.soap_endpoints(facts(spark, sf_dir)))


@register("jaxws_endpoints", f"""WITH {JX},
{EPX},
{SX},
{METHODS}
SELECT repo_id, class_fqn, method_name, operation_name, target_namespace, service_name FROM ep WHERE type = 'SOAP'
UNION ALL
{JAXWS_SOAP}""")
def q_jaxws_endpoints(spark, sf_dir):
    rows = [jaxws_endpoints(fx).select("repo_id", "class_fqn", "method_name", "operation_name", "target_namespace", "service_name")
            for fx in (facts(spark, sf_dir), soap_facts(spark, sf_dir))]
    return rows[0].unionByName(rows[1])


@register("endpoints_by_type", f"""WITH {JX},
{EPX}
SELECT repo_id, type, count(*) AS n_endpoints FROM ep GROUP BY ALL""")
def q_endpoints_by_type(spark, sf_dir):
    return G.endpoints_by_type(_eps(spark, sf_dir))


@register("openapi_doc", f"""WITH {JX},
{EPX}
SELECT repo_id, path, lower(http_method) AS verb, handler AS summary, handler AS operation_id, 'Success' AS response_200
FROM ep WHERE type = 'REST'""")
def q_openapi_doc(spark, sf_dir):
    return G.openapi_paths(_eps(spark, sf_dir))


@register("request_param_details", f"""WITH {JX},
{EPX}
SELECT handler, NULL::VARCHAR AS details FROM ep WHERE type = 'REST'""")
def q_request_param_details(spark, sf_dir):
    e = G.rest_endpoints(facts(spark, sf_dir))
    return e.select("handler", F.to_json("request_param_details").alias("details"))


# annotation corner cases (FIXTURES case_annotations)
CASE_ANNS = [
    '@RequestMapping(value = "/a", method = RequestMethod.POST)', "@RequestMapping(method = GET)",
    '@RequestMapping("/plain")', '@RequestMapping(path = "/p", value = "/v")', '@GetMapping({"/x", "/y"})',
    "@RequestMapping", '@ResponseStatus(code = HttpStatus.CREATED)', "@ResponseStatus(HttpStatus.OK)",
    '@ResponseStatus(value = HttpStatus.NOT_FOUND, reason = "gone")', '@PostMapping(path="/nospace")',
]


def _anns(spark, sf_dir) -> DataFrame:
    m = facts(spark, sf_dir).methods.select(F.explode("annotations").alias("ann"))
    return m.unionByName(spark.createDataFrame([(x,) for x in CASE_ANNS], "ann string")).distinct()


_METHOD_ANNS_SQL = """anns AS (SELECT DISTINCT ann FROM (
  SELECT '@GetMapping("/items/' || ks || '/{id}")' AS ann FROM jc WHERE t = 0
  UNION ALL SELECT '@PostMapping(value = "/items/' || ks || '")' FROM jc WHERE t = 0
  UNION ALL SELECT '@Query("SELECT i FROM item_' || k1 || ' i WHERE i.id = ?1")' FROM jc WHERE t = 2
  UNION ALL SELECT '@WebMethod(operationName = "getItem' || ks || '")' FROM jc WHERE t = 4
  UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({s(x)})" for x in CASE_ANNS) + ") v(ann)))"


def _sql_attr(col: str, a: str) -> str:
    ws = "[ \\t\\r\\n\\f]"
    return (f"CASE WHEN regexp_matches({col}, '\\b{a}{ws}*={ws}*\"') "
            f"THEN regexp_extract({col}, '\\b{a}{ws}*={ws}*\"([^\"]*)\"', 1) "
            f"WHEN regexp_matches({col}, '\\b{a}{ws}*=') "
            f"THEN regexp_extract({col}, '\\b{a}{ws}*={ws}*([^ \\t\\r\\n\\f,)\"]*)', 1) END")


@register("mapping_path", f"""WITH {JX},
{_METHOD_ANNS_SQL}
SELECT ann,
  CASE WHEN regexp_matches(ann, 'path = "[^"]*"') THEN regexp_extract(ann, 'path = "([^"]*)"', 1)
       WHEN regexp_matches(ann, 'value = "[^"]*"') THEN regexp_extract(ann, 'value = "([^"]*)"', 1)
       WHEN regexp_matches(ann, '^[^"]*"(.*)"[^"]*$')
            AND NOT regexp_matches(regexp_extract(ann, '^[^"]*"(.*)"[^"]*$', 1), '[=,"]')
       THEN regexp_extract(ann, '^[^"]*"(.*)"[^"]*$', 1) END AS path
FROM anns""")
def q_mapping_path(spark, sf_dir):
    a = _anns(spark, sf_dir)
    return a.select("ann", G.mapping_path(F.col("ann")).alias("path"))


@register("request_mapping_verb", f"""WITH {JX},
{_METHOD_ANNS_SQL},
m AS (SELECT ann, {_sql_attr('ann', 'method')} AS m FROM anns WHERE starts_with(ann, '@RequestMapping'))
SELECT ann, upper(CASE WHEN m IS NULL OR m = '' THEN 'ANY' WHEN contains(m, '.') THEN regexp_extract(m, '([^.]*)$', 1)
                       ELSE m END) AS verb FROM m""")
def q_request_mapping_verb(spark, sf_dir):
    a = _anns(spark, sf_dir).where(F.startswith("ann", F.lit("@RequestMapping")))
    return a.select("ann", G.request_mapping_verb(F.col("ann")).alias("verb"))


@register("response_status", f"""WITH {JX},
{_METHOD_ANNS_SQL}
SELECT ann, coalesce({_sql_attr('ann', 'code')}, {_sql_attr('ann', 'value')}) AS status
FROM anns WHERE starts_with(ann, '@ResponseStatus')""")
def q_response_status(spark, sf_dir):
    a = _anns(spark, sf_dir).where(F.startswith("ann", F.lit("@ResponseStatus")))
    return a.select("ann", G.response_status(F.array(F.col("ann"))).alias("status"))
