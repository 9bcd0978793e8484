"""Endpoints (section G, annotation side).

``endpoints(repo_id, type, class_fqn, method_name, handler, http_method,
path, path_variables, request_params, request_body_type,
response_body_type, http_status, produces, consumes, operation_name,
target_namespace, service_name, soap_action)``: one row per mapping
annotation of a controller method (REST) and one per SOAP operation.  All
column expressions over the method fact table plus one join to classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcframe.functions.text import annotation_attr
from srcframe.operators.facts import JavaFacts
from srcframe.operators.soap import soap_endpoints

# Mapping annotations and their verbs.
MAPPINGS = [("@GetMapping", "GET"), ("@PostMapping", "POST"), ("@PutMapping", "PUT"),
            ("@DeleteMapping", "DELETE"), ("@RequestMapping", None)]
COMMON_TYPES = ["string", "int", "integer", "long", "double", "float", "boolean", "char", "byte", "short"]
COMMON_PREFIXES = ["list<", "set<", "map<"]


def request_mapping_verb(ann: Column) -> Column:
    """G2 ``request_mapping_verb``: ``method =`` attribute after the last
    dot, upper-case; ``ANY`` when absent or empty."""
    m = annotation_attr(ann, "method")
    v = F.when(m.contains("."), F.substring_index(m, ".", -1)).otherwise(m)
    return F.upper(F.when(m.isNull() | (m == ""), F.lit("ANY")).otherwise(v))


def mapping_path(ann: Column) -> Column:
    """G3 ``mapping_path``: ``path = "…"``, else ``value = "…"`` (exact
    spacing, as the reference searches), else the text between the first and
    the last quote when it holds no ``=``, ``,`` or quote."""
    p = F.regexp_extract(ann, r'path = "([^"]*)"', 1)
    has_p = ann.contains('path = "') & ann.rlike(r'path = "[^"]*"')
    v = F.regexp_extract(ann, r'value = "([^"]*)"', 1)
    has_v = ann.contains('value = "') & ann.rlike(r'value = "[^"]*"')
    between = F.regexp_extract(ann, r'(?s)^[^"]*"(.*)"[^"]*$', 1)
    ok = (between != "") | ann.rlike(r'^[^"]*""[^"]*$')
    plain = F.when(ok & ~between.contains("=") & ~between.contains(",") & ~between.contains('"'), between)
    return F.when(has_p, p).when(has_v, v).otherwise(plain)


def response_status(annotations: Column) -> Column:
    """G5 ``response_status``: ``code`` else ``value`` of the (last)
    ``@ResponseStatus``."""
    rs = F.filter(annotations, lambda a: F.startswith(a, F.lit("@ResponseStatus")))
    vals = F.filter(F.transform(rs, lambda a: F.coalesce(annotation_attr(a, "code"), annotation_attr(a, "value"))),
                    lambda x: x.isNotNull())
    return F.try_element_at(vals, F.lit(-1))


def _is_common(t: Column) -> Column:
    lt = F.lower(t)
    c = lt.isin(*COMMON_TYPES)
    for p in COMMON_PREFIXES:
        c = c | F.startswith(lt, F.lit(p))
    return c


def rest_params(params: Column, http_method: Column) -> Column:
    """G4 ``rest_params``: (path_variables, request_params,
    request_body_type): annotated parameters; for POST/PUT an unannotated
    parameter of a non-common type is the body; the last body wins."""
    def has(p, a):
        return F.exists(p["annotations"], lambda x: x.contains(a))
    pv = F.transform(F.filter(params, lambda p: has(p, "@PathVariable")), lambda p: p["name"])
    rp = F.transform(F.filter(params, lambda p: has(p, "@RequestParam")), lambda p: p["name"])
    implicit = http_method.isin("POST", "PUT")
    body = F.filter(params, lambda p: has(p, "@RequestBody") | (
        implicit & ~has(p, "@PathVariable") & ~has(p, "@RequestParam") & ~_is_common(p["type"])))
    return F.struct(pv.alias("path_variables"), rp.alias("request_params"),
                    F.try_element_at(F.transform(body, lambda p: p["type"]), F.lit(-1)).alias("request_body_type"))


def request_param_details(params: Column) -> Column:
    """G6 ``request_param_details``: parameter → {required, defaultValue}
    from its ``@RequestParam`` annotations; parameters without either are
    left out; null when empty."""
    def details(p):
        anns = F.filter(p["annotations"], lambda a: F.startswith(a, F.lit("@RequestParam")))
        req = F.try_element_at(F.filter(F.transform(anns, lambda a: annotation_attr(a, "required")),
                                        lambda x: x.isNotNull()), F.lit(-1))
        dv = F.try_element_at(F.filter(F.transform(anns, lambda a: annotation_attr(a, "defaultValue")),
                                       lambda x: x.isNotNull()), F.lit(-1))
        m = F.map_filter(F.create_map(F.lit("required"), req, F.lit("defaultValue"), dv), lambda k, v: v.isNotNull())
        return F.struct(p["name"].alias("name"), m.alias("m"))
    entries = F.filter(F.transform(params, details), lambda e: F.size(e["m"]) > 0)
    mp = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["m"])))
    return F.when(F.size(entries) > 0, mp)


def rest_endpoints(fx: JavaFacts) -> DataFrame:
    """G1 ``rest_endpoints``: one endpoint per mapping annotation of every
    method of a controller class (JSON media types by default)."""
    ctl = fx.classes.where(F.lower("kind") == "controller").select("repo_id", "path", "class_fqn")
    m = fx.methods.join(ctl, ["repo_id", "path", "class_fqn"], "left_semi")
    m = m.select("repo_id", "class_fqn", F.col("name").alias("method_name"), F.col("ordinal").alias("method_ordinal"),
                 "return_type", "params", "annotations", F.posexplode("annotations").alias("ann_no", "ann"))
    verb = None
    for prefix, v in MAPPINGS:
        cond = F.startswith(F.col("ann"), F.lit(prefix))
        val = F.lit(v) if v else request_mapping_verb(F.col("ann"))
        verb = F.when(cond, val) if verb is None else verb.when(cond, val)
    m = m.withColumn("http_method", verb).where(F.col("http_method").isNotNull())
    rp = rest_params(F.col("params"), F.col("http_method"))
    return m.select(
        "repo_id", F.lit("REST").alias("type"), "class_fqn", "method_name",
        F.concat_ws(".", "class_fqn", "method_name").alias("handler"), "http_method",
        mapping_path(F.col("ann")).alias("path"),
        rp["path_variables"].alias("path_variables"), rp["request_params"].alias("request_params"),
        rp["request_body_type"].alias("request_body_type"), F.col("return_type").alias("response_body_type"),
        response_status(F.col("annotations")).alias("http_status"),
        request_param_details(F.col("params")).alias("request_param_details"),
        F.lit("application/json").alias("produces"), F.lit("application/json").alias("consumes"),
        F.lit(None).cast("string").alias("operation_name"), F.lit(None).cast("string").alias("target_namespace"),
        F.lit(None).cast("string").alias("service_name"), F.lit(None).cast("string").alias("soap_action"),
        "method_ordinal", "ann_no")


def endpoints(fx: JavaFacts) -> DataFrame:
    """All annotation endpoints (REST then SOAP)."""
    return fx.memo("endpoints", lambda: rest_endpoints(fx).unionByName(soap_endpoints(fx), allowMissingColumns=True))


def endpoints_by_type(eps: DataFrame) -> DataFrame:
    """G25 ``endpoints_by_type``: count per repository and type."""
    return eps.groupBy("repo_id", F.upper("type").alias("type")).agg(F.count(F.lit(1)).alias("n_endpoints"))


def openapi_paths(eps: DataFrame) -> DataFrame:
    """G19 ``openapi_doc`` as rows: (path, verb) → summary and operationId
    (the handler), response 200 ``Success``; a path gets a leading ``/``;
    the same path and verb twice → the last one (class, method, annotation
    order) wins.  One row per operation, so no repository is gathered into
    one value; ``to_json`` of these rows gives the document's paths."""
    r = eps.where(F.upper("type") == "REST").where(F.col("path").isNotNull())
    path = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path")))
    verb = F.lower(F.coalesce("http_method", F.lit("get")))
    r = r.withColumn("path", path).withColumn("verb", verb)
    w = Window.partitionBy("repo_id", "path", "verb").orderBy(F.col("class_fqn").desc(), F.col("method_ordinal").desc(),
                                                             F.col("ann_no").desc())
    r = r.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return r.select("repo_id", "path", "verb", F.col("handler").alias("summary"),
                    F.col("handler").alias("operation_id"), F.lit("Success").alias("response_200"))
