"""SOAP endpoints of annotated classes (section G).

Class attributes of ``@WebService`` are overlaid by those of the endpoint
interface (G10), annotations of implementing methods are followed by those of
the interface's method of the same name and arity (G11); headers (G8) and
body types (G9) are column expressions over one method.  Every join is an
equi-join that starts with ``repo_id`` and carries the file's ``path``, so
two modules with one class name stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcframe.functions.text import annotation_attr, annotation_core
from srcframe.operators.facts import JavaFacts, masked_bodies, materialize, method_bodies

CLASS = ["repo_id", "path", "class_fqn"]

# Annotations that make a method of a SOAP class an operation.
SOAP_ANNOTATIONS = ["@WebMethod", "@PayloadRoot", "@SoapAction", "@SOAPBinding", "@RequestWrapper",
                    "@ResponseWrapper", "@WebResult"]
SOAP_PARAMETERS = ["@WebParam", "@SoapHeader"]
# Setters of a WSDL definition bean and the columns they fill.
WSDL_SETTERS = {"setPortTypeName": "port_type_name", "setTargetNamespace": "target_namespace",
                "setLocationUri": "location_uri"}


# ------------------------------------------------------------- annotations

def _starts(a: Column, *prefixes: str) -> Column:
    c = F.lit(False)
    for p in prefixes:
        c = c | F.startswith(a, F.lit(p))
    return c


def filled(x: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(x, F.lit(""))


def last_attr(annotations: Column, prefix: str, attr: str, empty: bool = False) -> Column:
    """Attribute of the last annotation that gives it (a later layer wins)."""
    got = F.transform(F.filter(annotations, lambda a: _starts(a, prefix)),
                      lambda a: annotation_attr(a, attr) if empty else filled(annotation_attr(a, attr)))
    return F.try_element_at(F.filter(got, lambda x: x.isNotNull()), F.lit(-1))


def style_name(x: Column) -> Column:
    """``SOAPBinding.ParameterStyle.BARE`` → ``BARE``."""
    return F.upper(F.substring_index(x, ".", -1))


def _true(ann: Column, attr: str) -> Column:
    return F.lower(F.coalesce(annotation_attr(ann, attr), F.lit(""))) == "true"


# ------------------------------------------------- G10 and G11: interfaces

def _first_of_name(classes: DataFrame) -> DataFrame:
    """One class per (repository, file, name): of local classes that share a name, the first."""
    w = Window.partitionBy(*CLASS).orderBy("body_open")
    return classes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _source_root(path: Column, package: Column) -> Column:
    """Folder that holds the package's folders (``m1/src`` of ``m1/src/a/b/C.java``, package ``a.b``)."""
    tail = F.length(F.substring_index(path, "/", -1)) + F.when(package == "", 0).otherwise(F.length(package) + 1)
    return F.left(path, F.greatest(F.length(path) - tail, F.lit(0)))


def interface_candidates(named: Column, imports: Column, package: Column) -> Column:
    """Qualified names that a type's name in an annotation may stand for, most
    likely first: itself if dotted; the import that ends with it; the own
    package; packages imported on demand."""
    base = F.regexp_replace(named, r"\.class$", "")
    dotted = F.when(base.contains("."), F.array(base)).otherwise(F.array().cast("array<string>"))
    single = F.filter(imports, lambda i: i.endswith(F.concat(F.lit("."), base)))
    own = F.array(F.when(package != "", F.concat(package, F.lit("."), base)).otherwise(base))
    demand = F.transform(F.filter(imports, lambda i: i.endswith(".*")),
                         lambda i: F.concat(F.regexp_replace(i, r"\*$", ""), base))
    return F.array_distinct(F.concat(dotted, single, own, demand))


def sei_overlay(classes: DataFrame) -> DataFrame:
    """G10 ``sei_overlay``: one row per SOAP class (kind soap or a
    ``@WebService`` annotation): ``(repo_id, path, class_fqn, name, kind,
    is_ws, endpoint_interface, sei_fqn, sei_path, target_namespace,
    port_type_name, port_name, service_name, own_service, wsdl_url, style,
    parameter_style)``.

    The interface named by ``endpointInterface`` (qualified, or a simple name
    resolved by the file's imports) may lie in any package or module of the
    repository; of several files that declare it, one below the same source
    root, then the first path, is taken.  Its non-empty namespace, name, port
    and service override the class's own; location and binding style stay
    with the class.  An interface that isn't in the repository overrides
    nothing (``sei_fqn`` null)."""
    c = _first_of_name(classes).withColumn("is_ws", F.exists("annotations", lambda a: _starts(a, "@WebService")))
    ws = lambda attr: last_attr(F.col("annotations"), "@WebService", attr)
    attrs = {"target_namespace": "targetNamespace", "port_type_name": "name", "port_name": "portName",
             "service_name": "serviceName"}
    values = [ws(a).alias(n) for n, a in attrs.items()]
    soap = c.where(F.col("is_ws") | (F.col("kind") == "soap")).select(
        *CLASS, "name", "kind", "is_ws", "package", "imports", ws("endpointInterface").alias("endpoint_interface"),
        ws("wsdlLocation").alias("wsdl_url"),
        *[style_name(last_attr(F.col("annotations"), "@SOAPBinding", a)).alias(n)
          for n, a in (("style", "style"), ("parameter_style", "parameterStyle"))], *values)
    wanted = soap.where(F.col("endpoint_interface").isNotNull()).select(
        *CLASS, _source_root(F.col("path"), F.col("package")).alias("root"),
        F.posexplode(interface_candidates(F.col("endpoint_interface"), F.col("imports"), F.col("package")))
        .alias("choice", "sei_fqn"))
    given = c.select("repo_id", F.col("class_fqn").alias("sei_fqn"), F.col("path").alias("sei_path"),
                     _source_root(F.col("path"), F.col("package")).alias("sei_root"),
                     F.struct(*values).alias("sei"))
    found = wanted.join(given, ["repo_id", "sei_fqn"]).groupBy(*CLASS).agg(F.min_by(
        F.struct("sei_fqn", "sei_path", "sei"),
        F.struct("choice", (F.col("root") != F.col("sei_root")).alias("other"), "sei_path")).alias("f"))
    over = lambda n: F.coalesce(F.col(f"f.sei.{n}"), F.col(n)).alias(n)
    return soap.join(found, CLASS, "left").select(
        *CLASS, "name", "kind", "is_ws", "endpoint_interface", F.col("f.sei_fqn").alias("sei_fqn"),
        F.col("f.sei_path").alias("sei_path"), *[over(n) for n in attrs],
        F.col("service_name").alias("own_service"), "wsdl_url", "style", "parameter_style")


def sei_method_merge(overlay: DataFrame, methods: DataFrame) -> DataFrame:
    """G11 ``sei_method_merge``: the methods of the overlay's classes;
    ``merged`` = the method's annotations followed by those of the
    interface's first method of the same name and number of parameters."""
    m = methods.select(*CLASS, "ordinal", F.col("name").alias("method_name"), "return_type", "params",
                       F.size("params").alias("arity"), "annotations")
    declared = m.groupBy("repo_id", F.col("path").alias("sei_path"), F.col("class_fqn").alias("sei_fqn"),
                         "method_name", "arity").agg(F.min_by("annotations", "ordinal").alias("_sei"))
    none = F.array().cast("array<string>")
    return m.join(overlay, CLASS).join(declared, ["repo_id", "sei_path", "sei_fqn", "method_name", "arity"], "left") \
        .withColumn("merged", F.concat("annotations", F.coalesce("_sei", none))).drop("_sei")


# ------------------------------------------------------ G8 and G9: columns

def header_qname(ann: Column) -> Column:
    """Value of ``@SoapHeader`` as written, named or not; null if empty."""
    bare = F.regexp_extract(ann, r'^@[\w.]+\s*\(\s*"([^"]*)"', 1)
    return F.coalesce(filled(annotation_attr(ann, "value")), filled(bare))


def request_headers(params: Column, by_part: bool = True) -> Column:
    """Header entries ``array<struct<name, type>>`` of a method's parameters,
    in order.  ``@WebParam(header = true)``: its part name (``by_part``), else
    its name, else the parameter's.  ``@SoapHeader``: the local part of its
    qualified name, else the parameter's name; not taken if not ``by_part``
    (there qualified names are a list of their own)."""
    def of(p):
        def one(a):
            name = F.coalesce(*([filled(annotation_attr(a, "partName"))] if by_part else []),
                              filled(annotation_attr(a, "name")), p["name"])
            n = F.when(_starts(a, "@WebParam"), F.when(_true(a, "header"), name))
            if by_part:
                n = n.when(_starts(a, "@SoapHeader"),
                           F.coalesce(F.regexp_replace(header_qname(a), r"^\{[^}]*\}", ""), p["name"]))
            return F.struct(n.alias("name"), p["type"].alias("type"))
        return F.filter(F.transform(p["annotations"], one), lambda e: e["name"].isNotNull())
    return F.flatten(F.transform(params, of))


def response_headers(annotations: Column, return_type: Column) -> Column:
    """Header entries of ``@WebResult(header = true)``: its name, else ``return``."""
    ws = F.filter(annotations, lambda a: _starts(a, "@WebResult") & _true(a, "header"))
    return F.transform(ws, lambda a: F.struct(F.coalesce(filled(annotation_attr(a, "name")), F.lit("return")).alias("name"),
                                              return_type.alias("type")))


def last_wins(entries: Column) -> Column:
    """Entries → map; a repeated name keeps its last type; null when empty."""
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
                                                    lambda o: o["name"] == e["name"]))
    return F.when(F.size(entries) > 0, F.map_from_entries(kept))


def soap_headers(m: DataFrame, annotations: str, by_part: bool = True) -> DataFrame:
    """G8 ``soap_headers``: adds ``request_headers`` and ``response_headers``
    (name → type, null without any)."""
    m = materialize(m, _rq=request_headers(F.col("params"), by_part),
                    _rs=response_headers(F.col(annotations), F.col("return_type")))
    return materialize(m, request_headers=last_wins(F.col("_rq")), response_headers=last_wins(F.col("_rs"))).drop("_rq", "_rs")


def soap_body_types(m: DataFrame, annotations: str) -> DataFrame:
    """G9 ``soap_body_types``: adds ``request_body_type`` and
    ``response_body_type``.  Request: the wrapper's class; BARE, the first
    parameter whose name is no header; else a single parameter that is no
    header, or ``<method>Request`` for several.  Response: the wrapper's
    class; the return type if BARE or without response headers, else
    ``<method>Response``; null for void."""
    bare = F.coalesce(F.col("parameter_style") == "BARE", F.lit(False))
    names = F.coalesce(F.map_keys("request_headers"), F.array().cast("array<string>"))
    body = F.filter("params", lambda p: ~F.array_contains(names, p["name"]))
    first = F.try_element_at(F.transform(body, lambda p: p["type"]), F.lit(1))
    n = F.size("params")
    request = F.when(bare | (n == 1), first).when(n > 1, F.concat("method_name", F.lit("Request")))
    response = F.when(F.lower("return_type") == "void", None).when(
        bare | F.col("response_headers").isNull(), F.col("return_type")).otherwise(F.concat("method_name", F.lit("Response")))
    return m.withColumns({
        "request_body_type": F.coalesce(last_attr(F.col(annotations), "@RequestWrapper", "className"), request),
        "response_body_type": F.coalesce(last_attr(F.col(annotations), "@ResponseWrapper", "className"), response)})


# ------------------------------------------------------ G7 and G12: endpoints

def _rows(m: DataFrame, annotations: str, by_part: bool, http_method: str | None) -> DataFrame:
    """Methods with an operation → endpoint rows, one per (file, class,
    method, operation): of overloads that share it, the first."""
    own = lambda prefix, attr: last_attr(F.col(annotations), prefix, attr, empty=True)
    for col, attr in (("style", "style"), ("parameter_style", "parameterStyle")):
        m = m.withColumn(col, F.coalesce(style_name(own("@SOAPBinding", attr)), col))
    m = soap_body_types(soap_headers(m, annotations, by_part), annotations)
    m = m.withColumn("operation_name", F.coalesce(
        last_attr(F.col(annotations), "@PayloadRoot", "localPart"),
        last_attr(F.col(annotations), "@WebMethod", "operationName"), "method_name"))
    w = Window.partitionBy(*CLASS, "method_name", "operation_name").orderBy("ordinal")
    m = m.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    text = lambda v: F.lit(v).cast("string")
    none = F.array().cast("array<string>")
    qnames = F.transform(F.flatten(F.transform("params", lambda p: F.filter(
        p["annotations"], lambda a: _starts(a, "@SoapHeader")))), header_qname)
    return m.select(
        "repo_id", F.lit("SOAP").alias("type"), "class_fqn", "method_name",
        F.concat_ws(".", "class_fqn", "method_name").alias("handler"), text(http_method).alias("http_method"),
        F.concat_ws("/", F.coalesce("own_service", "name"), "operation_name").alias("path"),
        none.alias("path_variables"), none.alias("request_params"), "request_body_type", "response_body_type",
        text(None).alias("http_status"), F.lit(None).cast("map<string,map<string,string>>").alias("request_param_details"),
        F.lit("application/soap+xml").alias("produces"), F.lit("application/soap+xml").alias("consumes"),
        "operation_name", F.coalesce(last_attr(F.col(annotations), "@PayloadRoot", "namespace"), "target_namespace")
        .alias("target_namespace"), "service_name",
        F.coalesce(own("@WebMethod", "action"), own("@SoapAction", "value")).alias("soap_action"),
        F.col("ordinal").alias("method_ordinal"), F.lit(0).alias("ann_no"), "port_type_name", "port_name", "wsdl_url",
        "style", "parameter_style", style_name(own("@SOAPBinding", "use")).alias("use"), "request_headers",
        "response_headers", F.filter(qnames, lambda q: q.isNotNull()).alias("header_qnames"),
        own("@RequestWrapper", "localName").alias("request_wrapper"), own("@ResponseWrapper", "localName").alias("response_wrapper"),
        F.col("_file").alias("file_path"))


def overlay_of(fx: JavaFacts) -> DataFrame:
    return fx.memo("sei_overlay", lambda: sei_overlay(fx.classes))


def merged_methods(fx: JavaFacts) -> DataFrame:
    return fx.memo("sei_methods", lambda: sei_method_merge(overlay_of(fx), fx.methods)).withColumn("_file", F.col("path"))


def soap_endpoints(fx: JavaFacts) -> DataFrame:
    """G7 ``soap_endpoints``: methods of SOAP classes that carry a SOAP
    annotation (on the method or a parameter), and every method of a
    ``@WebService`` class, unless excluded (``@WebMethod(exclude = true)``).
    Operation = ``localPart`` of ``@PayloadRoot``, ``operationName`` of
    ``@WebMethod``, else the method's name; namespace of ``@PayloadRoot``, else
    the class's after the interface's overlay."""
    m = merged_methods(fx)
    marked = F.exists("annotations", lambda a: _starts(a, *SOAP_ANNOTATIONS)) | F.exists(
        "params", lambda p: F.exists(p["annotations"], lambda a: _starts(a, *SOAP_PARAMETERS)))
    excluded = F.exists("annotations", lambda a: _starts(a, "@WebMethod") & _true(a, "exclude"))
    return _rows(m.where((marked | F.col("is_ws")) & ~excluded), "annotations", True, None)


def jaxws_endpoints(fx: JavaFacts) -> DataFrame:
    """G12 ``jaxws_endpoints``: methods with ``@WebMethod``, their own or their
    interface's, of ``@WebService`` classes of kind service, component or
    soap, or with an endpoint interface; not excluded ones."""
    m = merged_methods(fx)
    cls = F.col("is_ws") & (F.col("kind").isin("service", "component", "soap") | F.col("endpoint_interface").isNotNull())
    web = F.filter("merged", lambda a: _starts(a, "@WebMethod"))
    return _rows(m.where(cls & (F.size(web) > 0) & ~F.exists(web, lambda a: _true(a, "exclude"))), "merged", False, "SOAP")


# ------------------------------------------------------- G13: bean methods

def wsdl_bean_defs(fx: JavaFacts) -> DataFrame:
    """G13 ``wsdl_bean_defs``: ``@Bean`` methods of ``@Configuration`` classes
    that return a ``DefaultWsdl11Definition``: ``(repo_id, wsdl_key, keyed_by,
    bean_name, port_type_name, target_namespace, location_uri, class_fqn,
    path)``.

    A setter counts if it is called on the returned variable or one that it
    was copied from (any scope, if something else is returned) with one
    string literal; an empty one doesn't, and the last one wins.  The key is
    the namespace, else the bean's name; of several beans of a repository
    with one key the last (by path, then place) stays."""
    has = lambda c, name: F.exists(c, lambda a: annotation_core(a) == name)
    conf = fx.classes.where(has("annotations", "Configuration")).select(*CLASS).distinct()
    key = [*CLASS, "ordinal"]
    beans = fx.methods.where(has("annotations", "Bean") & F.col("return_type").endswith("DefaultWsdl11Definition")) \
        .join(conf, CLASS, "left_semi")
    body = F.col("body_masked")
    copies = F.arrays_zip(F.regexp_extract_all(body, F.lit(r"([\w$]+)\s*=\s*([\w$]+)\s*;"), 1).alias("to"),
                          F.regexp_extract_all(body, F.lit(r"([\w$]+)\s*=\s*([\w$]+)\s*;"), 2).alias("from"))
    returned = F.try_element_at(F.regexp_extract_all(body, F.lit(r"\breturn\s+([\w$]+)\s*;"), 1), F.lit(-1))
    b = materialize(masked_bodies(method_bodies(beans, fx.texts)), _copies=copies, _returned=returned)
    names = F.aggregate(F.reverse("_copies"), F.array("_returned"), lambda acc, x: F.when(
        F.array_contains(acc, x["to"]), F.array_append(acc, x["from"])).otherwise(acc))
    b = b.select(*key, F.col("name").alias("bean_name"), F.when(F.col("_returned").isNotNull(), names).alias("names"))
    calls = fx.raw_calls.where(F.col("name").isin(*WSDL_SETTERS) & (F.size("arg_texts") == 1)).select(
        *CLASS, F.col("method_ordinal").alias("ordinal"), F.col("name").alias("setter"), "scope",
        F.col("ordinal").alias("at"), F.regexp_extract(F.col("arg_texts")[0], r'^"((?:[^"\\]|\\.)*)"$', 1).alias("value"))
    x = b.join(calls.where("value != ''"), key, "left")
    x = x.withColumn("value", F.when(F.col("names").isNull() | F.array_contains("names", F.coalesce("scope", F.lit(""))),
                                     F.col("value")))
    picked = [F.max_by(F.when(F.col("setter") == s, F.col("value")),
                       F.when((F.col("setter") == s) & F.col("value").isNotNull(), F.col("at"))).alias(c)
              for s, c in WSDL_SETTERS.items()]
    d = x.groupBy(*key, "bean_name").agg(*picked)
    d = d.withColumn("wsdl_key", F.coalesce("target_namespace", "bean_name")).withColumn(
        "keyed_by", F.when(F.col("target_namespace").isNotNull(), "namespace").otherwise("bean"))
    w = Window.partitionBy("repo_id", "keyed_by", "wsdl_key").orderBy(F.col("path").desc(), F.col("class_fqn").desc(),
                                                                     F.col("ordinal").desc())
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "repo_id", "wsdl_key", "keyed_by", "bean_name", "port_type_name", "target_namespace", "location_uri", "class_fqn", "path")
