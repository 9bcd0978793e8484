"""WSDL endpoints (section G, document side).

A WSDL file is parsed with ``from_xml`` (PERMISSIVE: a malformed file
gives nulls, not a failed job; namespaces ignored, so ``soap:`` and
``soap12:`` elements read alike), then ``explode`` gives one row per binding
operation.  Service/port and portType/message lookups are joins on the
file and local names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcframe.session import Scratch
from srcframe.sources.files import dedupe_by_path, files_of_kind

WSDL_SCHEMA = (
    "_targetNamespace STRING, "
    "message ARRAY<STRUCT<_name: STRING, part: ARRAY<STRUCT<_name: STRING, _element: STRING, _type: STRING>>>>, "
    "portType ARRAY<STRUCT<_name: STRING, operation: ARRAY<STRUCT<_name: STRING, documentation: STRING, "
    "input: STRUCT<_message: STRING>, output: STRUCT<_message: STRING>>>>>, "
    "binding ARRAY<STRUCT<_name: STRING, _type: STRING, binding: STRUCT<_style: STRING>, "
    "operation: ARRAY<STRUCT<_name: STRING, operation: STRUCT<_soapAction: STRING, _style: STRING>, "
    "input: STRUCT<body: STRUCT<_use: STRING>>, output: STRUCT<body: STRUCT<_use: STRING>>>>>>, "
    "service ARRAY<STRUCT<_name: STRING, port: ARRAY<STRUCT<_name: STRING, _binding: STRING>>>>")
XML_OPTS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def local(name):
    """Part after the namespace prefix (``tns:X`` → ``X``)."""
    return F.when(name.contains(":"), F.substring_index(name, ":", -1)).otherwise(name)


def parse_wsdl(files: DataFrame) -> DataFrame:
    w = dedupe_by_path(files_of_kind(files, "wsdl"))
    return w.select("repo_id", "path", F.from_xml("content", WSDL_SCHEMA, XML_OPTS).alias("d"))


def wsdl_operations(files: DataFrame) -> DataFrame:
    """G14 ``wsdl_operations``: one row per binding operation with port
    type, style (operation overrides binding), soapAction, use (input,
    else output; upper-case) and the document's target namespace."""
    d = parse_wsdl(files)
    b = d.select("repo_id", "path", F.col("d._targetNamespace").alias("target_namespace"),
                 F.posexplode("d.binding").alias("bi", "b"))
    o = b.select("repo_id", "path", "target_namespace", "bi", F.col("b._name").alias("binding"),
                 local(F.col("b._type")).alias("port_type"), F.col("b.binding._style").alias("binding_style"),
                 F.posexplode("b.operation").alias("oi", "op"))
    use = F.coalesce(F.nullif(F.col("op.input.body._use"), F.lit("")), F.col("op.output.body._use"))
    return o.select("repo_id", "path", "bi", "oi", "binding", "port_type", "target_namespace",
                    F.col("op._name").alias("operation"),
                    F.concat_ws("/", "port_type", F.col("op._name")).alias("op_path"),
                    F.upper(F.coalesce(F.col("op.operation._style"), F.col("binding_style"))).alias("style"),
                    F.col("op.operation._soapAction").alias("soap_action"), F.upper(use).alias("use"))


def wsdl_service_port(files: DataFrame) -> DataFrame:
    """G15 ``wsdl_service_port``: per binding, the first service/port (in
    document order) whose binding local name equals it."""
    d = parse_wsdl(files)
    s = d.select("repo_id", "path", F.posexplode("d.service").alias("si", "s")) \
        .select("repo_id", "path", "si", F.col("s._name").alias("service_name"), F.posexplode("s.port").alias("pi", "p")) \
        .select("repo_id", "path", "si", "pi", "service_name", F.col("p._name").alias("port_name"),
                local(F.col("p._binding")).alias("binding"))
    w = Window.partitionBy("repo_id", "path", "binding").orderBy("si", "pi")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "repo_id", "path", "binding", "service_name", "port_name")


def wsdl_messages(files: DataFrame) -> DataFrame:
    """G16 ``wsdl_messages``: the portType operation's input and output
    message, and its documentation."""
    d = parse_wsdl(files)
    p = d.select("repo_id", "path", F.explode("d.portType").alias("pt")) \
        .select("repo_id", "path", F.col("pt._name").alias("port_type"), F.explode("pt.operation").alias("op"))
    return p.select("repo_id", "path", "port_type", F.col("op._name").alias("operation"),
                    F.col("op.input._message").alias("request_message"),
                    F.col("op.output._message").alias("response_message"),
                    F.col("op.documentation").alias("documentation"))


def wsdl_endpoints(files: DataFrame) -> DataFrame:
    """G14-G16 together: WSDL endpoints in the shape of annotation
    endpoints (type SOAP, http method ``SOAP``)."""
    ops = wsdl_operations(files)
    sp = wsdl_service_port(files)
    msg = wsdl_messages(files)
    j = ops.join(sp, ["repo_id", "path", "binding"], "left") \
        .join(msg, ["repo_id", "path", "port_type", "operation"], "left")
    return j.select("repo_id", F.lit("SOAP").alias("type"), "path", "binding", "operation", "port_type", "op_path",
                    "style", "soap_action", "use", "target_namespace", "service_name", "port_name",
                    "request_message", "response_message", "documentation")


def combine_endpoints(annotated: DataFrame, wsdl_eps: DataFrame) -> DataFrame:
    """G18 ``combine_endpoints``: SOAP endpoints from annotations and from
    WSDL files matched on (repository, lower namespace, lower operation).
    WSDL facts win for the document fields (style, soapAction, use, service,
    port, port type, messages), annotations for the code fields (handler,
    class, method); unmatched rows of both sides are kept.  A WSDL key seen
    twice keeps its last occurrence."""
    a = annotated.where(F.upper("type") == "SOAP").select(
        "repo_id", F.lower("target_namespace").alias("_ns"), F.lower("operation_name").alias("_op"),
        F.col("operation_name").alias("a_operation"), F.col("target_namespace").alias("a_namespace"),
        "handler", "class_fqn", "method_name", F.col("service_name").alias("a_service"),
        F.col("soap_action").alias("a_action"))
    w = wsdl_eps.withColumn("_ns", F.lower("target_namespace")).withColumn("_op", F.lower("operation"))
    win = Window.partitionBy("repo_id", "_ns", "_op").orderBy(F.col("path").desc(), F.col("op_path").desc())
    w = w.withColumn("_r", F.row_number().over(win)).where("_r = 1").select(
        "repo_id", "_ns", "_op", F.col("operation").alias("w_operation"), F.col("target_namespace").alias("w_namespace"),
        "style", F.col("soap_action").alias("w_action"), "use", F.col("service_name").alias("w_service"),
        "port_name", "port_type", "request_message", "response_message")
    j = a.join(w, ["repo_id", "_ns", "_op"], "full_outer")
    src = (F.when(F.col("handler").isNotNull() & F.col("w_operation").isNotNull(), "both")
           .when(F.col("handler").isNotNull(), "annotation").otherwise("wsdl"))
    return j.select("repo_id", F.coalesce("w_operation", "a_operation").alias("operation_name"),
                    F.coalesce("w_namespace", "a_namespace").alias("target_namespace"),
                    F.coalesce("w_action", "a_action").alias("soap_action"),
                    F.coalesce("w_service", "a_service").alias("service_name"),
                    "style", "use", "port_name", "port_type", "request_message", "response_message",
                    "handler", "class_fqn", "method_name", src.alias("source"))


XSD_SCHEMA = (
    "_targetNamespace STRING, "
    "element ARRAY<STRUCT<_name: STRING, complexType: STRUCT<"
    "sequence: STRUCT<element: ARRAY<STRUCT<_name: STRING, _ref: STRING, _type: STRING, _minOccurs: STRING, "
    "_maxOccurs: STRING>>>, attribute: ARRAY<STRUCT<_name: STRING, _type: STRING, _use: STRING>>>>>")


def xsd_elements(files: DataFrame) -> DataFrame:
    """G22 ``xsd_elements``: per top-level element its sequence children
    (name or referenced element, type, minOccurs / maxOccurs defaulting to
    1) and its attributes (type defaulting to ``xs:string``, use to
    ``optional``), as rows ``(element, member_kind, ordinal, name, ref,
    type, min_occurs, max_occurs, use)``."""
    x = dedupe_by_path(files_of_kind(files, "xsd")).select(
        "repo_id", "path", F.from_xml("content", XSD_SCHEMA, XML_OPTS).alias("d"))
    e = x.select("repo_id", "path", F.explode("d.element").alias("e"))
    kids = e.select("repo_id", "path", F.col("e._name").alias("element"),
                    F.posexplode("e.complexType.sequence.element").alias("ordinal", "c")).select(
        "repo_id", "path", "element", F.lit("child").alias("member_kind"), "ordinal",
        F.col("c._name").alias("name"), local(F.col("c._ref")).alias("ref"), F.col("c._type").alias("type"),
        F.coalesce(F.col("c._minOccurs"), F.lit("1")).alias("min_occurs"),
        F.coalesce(F.col("c._maxOccurs"), F.lit("1")).alias("max_occurs"), F.lit(None).cast("string").alias("use"))
    attrs = e.select("repo_id", "path", F.col("e._name").alias("element"),
                     F.posexplode("e.complexType.attribute").alias("ordinal", "a")).select(
        "repo_id", "path", "element", F.lit("attribute").alias("member_kind"), "ordinal",
        F.col("a._name").alias("name"), F.lit(None).cast("string").alias("ref"),
        F.coalesce(F.col("a._type"), F.lit("xs:string")).alias("type"), F.lit(None).cast("string").alias("min_occurs"),
        F.lit(None).cast("string").alias("max_occurs"), F.coalesce(F.col("a._use"), F.lit("optional")).alias("use"))
    return kids.unionByName(attrs)


def xsd_expand(elements: DataFrame, max_depth: int | None = None) -> DataFrame:
    """G23 ``xsd_expand``: from every top-level element follow ``ref``
    children: rows (root, depth, element).  One join per level on (repository,
    file, element name); a path that meets one of its own elements again ends
    there, so cycles do not repeat.  ``max_depth`` cuts the expansion."""
    refs = elements.where(F.col("ref").isNotNull()).select("repo_id", "path", "element", "ref")
    scratch = Scratch(elements.sparkSession, "xsd")
    level = elements.select("repo_id", "path", F.col("element").alias("root")).distinct() \
        .withColumn("element", F.col("root")).withColumn("depth", F.lit(0)).withColumn("_seen", F.array("root"))
    out, d = level, 0
    while max_depth is None or d < max_depth:
        d += 1
        level = scratch.save(level.join(refs, ["repo_id", "path", "element"])
                             .where(~F.array_contains("_seen", F.col("ref"))).select(
            "repo_id", "path", "root", F.col("ref").alias("element"), F.lit(d).alias("depth"),
            F.array_append("_seen", F.col("ref")).alias("_seen")), f"level{d}")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("_seen")


def wsdl_message_part(files: DataFrame) -> DataFrame:
    """G21 ``wsdl_message_part``: message → its first part's element (or
    type); looked up by local name, so ``tns:X`` and ``X`` both resolve."""
    d = parse_wsdl(files)
    m = d.select("repo_id", "path", F.explode("d.message").alias("m")).select(
        "repo_id", "path", F.col("m._name").alias("message"),
        F.try_element_at(F.col("m.part"), F.lit(1)).alias("p"))
    return m.select("repo_id", "path", "message", F.col("p._name").alias("part_name"),
                    F.coalesce(F.col("p._element"), F.col("p._type")).alias("part_element"))


def wsdl_operation_details(files: DataFrame, xsd: DataFrame | None = None) -> DataFrame:
    """G24 ``wsdl_operation_details``: per portType operation its
    documentation, input/output message, the messages' part elements and
    whether the XSDs of the repository define those elements."""
    msg = wsdl_messages(files)
    parts = wsdl_message_part(files).select("repo_id", "path", F.col("message").alias("_m"), "part_element")
    j = msg.withColumn("_rq", local(F.col("request_message"))).withColumn("_rs", local(F.col("response_message")))
    j = j.join(parts.withColumnRenamed("_m", "_rq").withColumnRenamed("part_element", "request_element"),
               ["repo_id", "path", "_rq"], "left")
    j = j.join(parts.withColumnRenamed("_m", "_rs").withColumnRenamed("part_element", "response_element"),
               ["repo_id", "path", "_rs"], "left")
    out = j.select("repo_id", "path", "port_type", "operation", "documentation", "request_message", "response_message",
                   "request_element", "response_element")
    if xsd is not None:
        known = xsd_elements(xsd).select("repo_id", F.col("element").alias("_e")).distinct() \
            .withColumn("request_element_defined", F.lit(True))
        out = out.withColumn("_e", local(F.col("request_element"))).join(known, ["repo_id", "_e"], "left") \
            .withColumn("request_element_defined", F.coalesce("request_element_defined", F.lit(False))).drop("_e")
    return out


# ------------------------------------------------------- G20: schema imports

IMPORT = "ARRAY<STRUCT<_namespace: STRING, _schemaLocation: STRING>>"
IMPORT_SCHEMA = f"import {IMPORT}, include {IMPORT}, types STRUCT<schema: ARRAY<STRUCT<import: {IMPORT}, include: {IMPORT}>>>"


def plain_path(path):
    """Path without ``.`` and empty steps, ``..`` taken back; null if it leaves the root."""
    def step(acc, x):
        return (F.when(acc.isNull() | x.isin("", "."), acc)
                .when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(x == "..", F.lit(None)).otherwise(F.array_append(acc, x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def schema_imports(files: DataFrame) -> DataFrame:
    """``import`` and ``include`` elements with a location, of the schemas in
    WSDL and XSD files: ``(repo_id, path, ordinal, namespace, schema_location)``."""
    both = files_of_kind(files, "wsdl").unionByName(files_of_kind(files, "xsd"))
    d = dedupe_by_path(both).select("repo_id", "path", F.from_xml("content", IMPORT_SCHEMA, XML_OPTS).alias("d"))
    none = F.array().cast("array<struct<_namespace: string, _schemaLocation: string>>")
    of = lambda s: F.concat(F.coalesce(s["import"], none), F.coalesce(s["include"], none))
    inner = F.coalesce(F.flatten(F.transform(F.col("d.types.schema"), of)), none)
    found = F.filter(F.concat(of(F.col("d")), inner), lambda x: F.length(x["_schemaLocation"]) > 0)
    return d.select("repo_id", "path", F.posexplode(found).alias("ordinal", "x")).select(
        "repo_id", "path", "ordinal", F.nullif(F.col("x._namespace"), F.lit("")).alias("namespace"),
        F.col("x._schemaLocation").alias("schema_location"))


def xsd_import_resolve(files: DataFrame) -> DataFrame:
    """G20 ``xsd_import_resolve``: every import with the schema file it names:
    ``(repo_id, path, ordinal, namespace, schema_location, resolved_path,
    matched, store_key)``.

    Tried in order: the location as a path of the repository (``exact``);
    relative to the importing file (``relative``); a file whose path ends with
    the whole location, step by step (``suffix``; of several the first path).
    ``store_key`` is the namespace, else the file's path; null if nothing is
    found.  Files are keyed by each of their path suffixes, one row a key
    after a partial aggregate, so this is one equi-join and a location that
    many files share meets a single row."""
    segs = F.split("path", "/")
    keys = files_of_kind(files, "xsd").select("repo_id", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(segs)), lambda i: F.struct(
            F.array_join(F.slice(segs, i, F.size(segs)), "/").alias("key"), (i == 1).alias("whole")))).alias("k"))
    keys = keys.groupBy("repo_id", F.col("k.key").alias("key")).agg(
        F.min("path").alias("any_path"), F.max("k.whole").alias("whole"))
    imports = schema_imports(files)
    loc = F.col("schema_location")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "/")).otherwise("")
    tries = F.array(F.struct(F.lit("exact").alias("matched"), loc.alias("key")),
                    F.struct(F.lit("relative").alias("matched"), plain_path(F.concat(folder, loc)).alias("key")),
                    F.struct(F.lit("suffix").alias("matched"), F.regexp_replace(loc, r"^(\./)+", "").alias("key")))
    own = ["repo_id", "path", "ordinal"]
    t = imports.select(*own, F.posexplode(tries).alias("rank", "t")).select(*own, "rank", "t.*")
    hit = t.join(keys, ["repo_id", "key"]).where(F.col("whole") | (F.col("matched") == "suffix"))
    best = hit.groupBy(*own).agg(F.min_by(F.struct(
        F.when(F.col("matched") == "suffix", F.col("any_path")).otherwise(F.col("key")).alias("resolved_path"), "matched"),
        "rank").alias("b"))
    return imports.join(best, own, "left").select(
        *own, "namespace", "schema_location", F.col("b.resolved_path").alias("resolved_path"), F.col("b.matched").alias("matched"),
        F.when(F.col("b").isNotNull(), F.coalesce("namespace", F.col("b.resolved_path"))).alias("store_key"))


def xsd_import_closure(resolved: DataFrame) -> DataFrame:
    """Schema files that a WSDL reaches over any number of imports:
    ``(repo_id, root, path, depth)``, ``depth`` = fewest imports.  A level is
    one join of the new rows with the resolved imports; rows seen before drop
    out, so cycles end."""
    edges = resolved.where(F.col("resolved_path").isNotNull()).select("repo_id", "path", F.col("resolved_path").alias("next")).distinct()
    scratch = Scratch(resolved.sparkSession, "xsdimports")
    edges = scratch.save(edges, "edges")
    level = scratch.save(edges.where(F.lower("path").endswith(".wsdl")).select(
        "repo_id", F.col("path").alias("root"), F.col("next").alias("path"), F.lit(1).alias("depth")), "level1")
    seen, d = level, 1
    while not level.isEmpty():
        d += 1
        new = level.join(edges, ["repo_id", "path"]).select("repo_id", "root", F.col("next").alias("path")).distinct() \
            .join(seen.select("repo_id", "root", "path"), ["repo_id", "root", "path"], "left_anti")
        level = scratch.save(new.withColumn("depth", F.lit(d)), f"level{d}")
        seen = seen.unionByName(level)
    return seen
