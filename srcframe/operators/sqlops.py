"""SQL in code and entity analysis (section F).

``sql_ops(repo_id, class_fqn, method_name, sql, op_type, tables, source)``
comes from three sources, merged per (class, method) by priority: source
SQL (``@Query`` annotations, JDBC call arguments, SQL-like literals), then
operations inferred from CRUD-like method names, then Spring Data
repository operations.  Tables are validated against the repository's
entities with equi-joins on alias rows (one row per name form), never by a
nested loop.  Every key starts with ``repo_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcframe.functions import text as X
from srcframe.operators.facts import ANN, JavaFacts, spans

# JDBC calls whose first argument is SQL.
JDBC_METHODS = ["prepareStatement", "createStatement", "execute", "executeQuery", "executeUpdate", "addBatch"]
# DAO hints in class names / interfaces / annotations.
DAO_NAME_WORDS = ["dao", "repository", "mapper"]
DAO_IFACE_WORDS = ["repository", "dao", "crudrepository", "jparepository"]
DAO_ANN_WORDS = ["Repository", "DAO"]

OP_COLS = ["repo_id", "class_fqn", "method_name", "sql", "op_type", "tables"]


def _op(df: DataFrame, sql: Column) -> DataFrame:
    return df.withColumn("sql", sql).withColumn("op_type", X.sql_op_type(F.col("sql"))) \
        .withColumn("tables", X.sql_tables(F.col("sql")))


def _unquote(lit: Column) -> Column:
    return F.regexp_extract(lit, r'(?s)^"(.*)"$', 1)


def string_variables(fx: JavaFacts) -> DataFrame:
    """``String`` locals initialised with a literal, or with an earlier
    such variable, along any chain of copies: (method key, var, value)."""
    rx = r'(?<![\w$.])String\s+([\w$]+)\s*=\s*("[^"\n]*"|[\w$]+)\s*;'
    b = fx.bodies.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                         F.col("ordinal").alias("method_ordinal"), "body",
                         F.posexplode(spans(F.col("body_masked"), rx)).alias("o", "s"))
    txt = F.substr(F.col("body"), F.col("s.start"), F.col("s.len"))
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    v = b.select(*key, "o", F.regexp_extract(txt, rx, 1).alias("var"), F.regexp_extract(txt, rx, 2).alias("init"))
    # in declaration order; a later declaration of the same name wins (map put)
    order = v.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "var", "init"))).alias("decls"))

    def put(known: Column, d: Column) -> Column:
        value = F.when(F.startswith(d["init"], F.lit('"')), _unquote(d["init"])).otherwise(F.try_element_at(known, d["init"]))
        rest = F.map_filter(known, lambda k, _: k != d["var"])
        return F.when(value.isNotNull(), F.map_concat(rest, F.create_map(d["var"], value))).otherwise(known)

    known = F.aggregate("decls", F.create_map().cast("map<string,string>"), put)
    return order.select(*key, F.explode(known).alias("var", "value"))


def jdbc_sql(fx: JavaFacts) -> DataFrame:
    """F5 ``jdbc_sql``: first argument of the six JDBC calls — a string
    literal, or a ``String`` variable holding one — when it looks like SQL."""
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    c = fx.raw_calls.where(F.col("name").isin(*JDBC_METHODS) & (F.size("arg_texts") > 0)) \
        .withColumn("a0", F.col("arg_texts")[0])
    sv = string_variables(fx).withColumnRenamed("var", "a0")
    j = c.join(sv, key + ["a0"], "left")
    sql = F.when(F.startswith("a0", F.lit('"')), _unquote(F.col("a0"))).otherwise(F.col("value"))
    j = j.withColumn("sql", sql).where(F.col("sql").isNotNull() & X.is_sql(F.col("sql")))
    return _op(j.select(*key, "ordinal", "sql"), F.col("sql"))


def string_literals(fx: JavaFacts) -> DataFrame:
    """Every string literal of every method body, in order."""
    b = fx.bodies.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                         F.col("ordinal").alias("method_ordinal"), "body",
                         F.posexplode(spans(F.col("body_masked"), r'"[^"\n]*"')).alias("ordinal", "s"))
    return b.select("repo_id", "path", "class_fqn", "method_name", "method_ordinal", "ordinal",
                    _unquote(F.substr(F.col("body"), F.col("s.start"), F.col("s.len"))).alias("literal"))


def literal_sql_fallback(fx: JavaFacts, jdbc: DataFrame | None = None) -> DataFrame:
    """F6 ``literal_sql_fallback``: SQL-like literals of methods that have
    no JDBC-derived SQL (anti join)."""
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    jdbc = jdbc if jdbc is not None else jdbc_sql(fx)
    lits = string_literals(fx).join(jdbc.select(*key).distinct(), key, "left_anti")
    lits = lits.where(X.is_sql(F.col("literal")))
    return _op(lits, F.col("literal")).drop("literal")


def annotated_query_sql(fx: JavaFacts) -> DataFrame:
    """F8 ``annotated_query_sql``: ``@Query("…")`` / ``value =`` /
    ``query =`` on a method; the first such annotation gives the SQL."""
    m = fx.methods.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                          F.col("ordinal").alias("method_ordinal"),
                          F.posexplode("annotations").alias("ai", "ann"))
    core = F.regexp_extract("ann", r"^@([\w.$]+)", 1)
    m = m.where((core == "Query") | core.endswith(".Query"))
    single = F.regexp_extract("ann", r'(?s)^@[\w.$]+\s*\(\s*"((?:[^"\\]|\\.)*)"\s*\)$', 1)
    named = F.coalesce(X.annotation_attr(F.col("ann"), "value"), X.annotation_attr(F.col("ann"), "query"))
    quoted_named = F.regexp_like(F.col("ann"), F.lit(r'(?<![A-Za-z0-9_])(?:value|query)\s*=\s*"'))
    sql = F.when(single != "", single).when(quoted_named, named)
    m = m.withColumn("sql", sql).where(F.col("sql").isNotNull() & (F.trim("sql") != ""))
    w = Window.partitionBy("repo_id", "path", "class_fqn", "method_name", "method_ordinal").orderBy("ai")
    m = m.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "ai", "ann")
    return _op(m, F.col("sql"))


def source_ops(fx: JavaFacts) -> DataFrame:
    """Source SQL per method: ``@Query`` beats body SQL; body SQL is the
    JDBC arguments, else the literal fallback.  F7: duplicates by value
    (method, sql, type, tables) dropped."""
    return fx.memo("source_ops", lambda: _source_ops(fx))


def _source_ops(fx: JavaFacts) -> DataFrame:
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    ann = annotated_query_sql(fx)
    jd = jdbc_sql(fx)
    body = jd.select(*key, "sql", "op_type", "tables").unionByName(
        literal_sql_fallback(fx, jd).select(*key, "sql", "op_type", "tables"))
    body = body.join(ann.select(*key), key, "left_anti")
    return dedupe_ops(ann.select(*key, "sql", "op_type", "tables").unionByName(body).drop("path"))


def dedupe_ops(ops: DataFrame) -> DataFrame:
    """F7 ``dedupe_ops``: value equality on (method, sql, type, tables)."""
    return ops.dropDuplicates(["repo_id", "class_fqn", "method_name", "sql", "op_type", "tables"])


def dao_candidates(fx: JavaFacts) -> DataFrame:
    """F9 ``dao_candidates``: repository/dao kind, a DAO word in the name,
    an interface or annotation hint, or any method with a CRUD prefix."""
    return fx.memo("dao_candidates", lambda: _dao_candidates(fx))


def _dao_candidates(fx: JavaFacts) -> DataFrame:
    c = fx.classes
    low = F.lower("name")
    by_name = None
    for w in DAO_NAME_WORDS:
        x = low.contains(w)
        by_name = x if by_name is None else (by_name | x)
    by_iface = F.exists(F.coalesce("interfaces", F.array().cast("array<string>")),
                        lambda i: F.lower(i).rlike("|".join(DAO_IFACE_WORDS)))
    by_ann = F.exists("annotations", lambda a: a.contains(DAO_ANN_WORDS[0]) | a.contains(DAO_ANN_WORDS[1]))
    direct = c.where(F.lower("kind").isin("repository", "dao") | by_name | by_iface | by_ann) \
        .select("repo_id", "class_fqn")
    by_method = fx.methods.where(X.method_prefix(F.col("name")) != "").select("repo_id", "class_fqn")
    return direct.unionByName(by_method).distinct()


def ops_from_method_names(fx: JavaFacts, candidates: DataFrame | None = None) -> DataFrame:
    """F15 ``ops_from_method_names``: one synthetic operation per method
    whose name starts with a CRUD prefix and names an entity (F10, F11,
    F14).  The method name is kept (K7)."""
    cand = candidates if candidates is not None else dao_candidates(fx)
    m = fx.methods.join(cand, ["repo_id", "class_fqn"], "left_semi") \
        .select("repo_id", "class_fqn", F.col("name").alias("method_name"),
                F.col("ordinal").alias("method_ordinal"))
    pref = X.method_prefix(F.col("method_name"))
    ent = X.entity_from_method(F.col("method_name"), pref)
    m = m.withColumn("entity", ent).where((pref != "") & (F.col("entity") != ""))
    op = X.op_type_from_method(F.col("method_name"))
    return m.select("repo_id", "class_fqn", "method_name", "method_ordinal",
                    X.synthetic_sql(op, F.col("entity")).alias("sql"), op.alias("op_type"),
                    F.array(F.col("entity")).alias("tables"))


def spring_data_repos(fx: JavaFacts) -> DataFrame:
    """F21 ``spring_data_repos``: an interface names a Spring Data base;
    with the entity name (F22)."""
    c = fx.classes.where(F.exists(F.coalesce("interfaces", F.array().cast("array<string>")),
                                  X.is_repository_base))
    return c.select("repo_id", "path", "class_fqn", "name", "interfaces",
                    X.repo_entity_name(F.col("interfaces"), F.col("name")).alias("entity"))


def spring_data_ops(fx: JavaFacts) -> DataFrame:
    """F23 ``spring_data_ops``: per repository method with a known
    operation: SQL template naming entity and method; tables = entity plus
    the capitalised-word runs of the method name."""
    r = spring_data_repos(fx).where(F.col("entity").isNotNull()).select("repo_id", "path", "class_fqn", "entity")
    m = fx.methods.join(r, ["repo_id", "path", "class_fqn"]).select(
        "repo_id", "class_fqn", F.col("name").alias("method_name"), F.col("ordinal").alias("method_ordinal"), "entity")
    op = X.op_type_from_method(F.col("method_name"))
    words = F.filter(F.regexp_extract_all(F.col("method_name"), F.lit(r"((?:[A-Z][a-z]+)+)"), 1),
                     lambda w: w != F.col("entity"))
    return m.where(op != "UNKNOWN").select(
        "repo_id", "class_fqn", "method_name", "method_ordinal",
        X.synthetic_sql(op, F.col("entity"), F.col("method_name")).alias("sql"), op.alias("op_type"),
        F.array_distinct(F.concat(F.array(F.col("entity")), words)).alias("tables"))


def merge_op_sources(fx: JavaFacts) -> DataFrame:
    """F17 ``merge_op_sources``: per (class, method) keep every operation
    of the best source — 1 source SQL, 2 method-name inference, 3 Spring
    Data — for DAO candidates."""
    return fx.memo("merged_ops", lambda: _merge_op_sources(fx))


def _merge_op_sources(fx: JavaFacts) -> DataFrame:
    key = ["repo_id", "class_fqn", "method_name"]
    cand = dao_candidates(fx)
    src = source_ops(fx).join(cand, ["repo_id", "class_fqn"], "left_semi").withColumn("prio", F.lit(1))
    meta = ops_from_method_names(fx, cand).withColumn("prio", F.lit(2))
    spring = spring_data_ops(fx).join(cand, ["repo_id", "class_fqn"], "left_semi").withColumn("prio", F.lit(3))
    cols = key + ["sql", "op_type", "tables", "prio"]
    u = src.select(*cols).unionByName(meta.select(*cols)).unionByName(spring.select(*cols))
    w = Window.partitionBy(*key).orderBy("prio")
    return u.withColumn("_r", F.dense_rank().over(w)).where("_r = 1").drop("_r")


def is_entity(classes: DataFrame) -> Column:
    """Entity test of the DAO analysis: kind entity or an ``@Entity``
    annotation text."""
    return (F.lower("kind") == "entity") | F.exists("annotations", lambda a: a.contains("@Entity"))


def entity_table_name(classes: DataFrame) -> DataFrame:
    """F16 ``entity_table_name``: ``@Table(name = "…")`` else the class
    name in snake case; for every entity of the repository."""
    e = classes.where(is_entity(classes))
    tbl = F.try_element_at(F.filter(F.transform(
        F.filter("annotations", lambda a: F.startswith(a, F.lit("@Table"))),
        lambda a: F.trim(F.regexp_extract(a, r'name\s*=\s*"([^"]*)"', 1))), lambda t: t != ""), F.lit(1))
    return e.select("repo_id", "class_fqn", "name", F.coalesce(tbl, X.camel_to_snake(F.col("name"))).alias("table_name"))


def entity_aliases(classes: DataFrame) -> DataFrame:
    """One row per (entity, lower-case name form): table name, class name,
    snake-case class name.  Joined by equality, like a hash map."""
    t = entity_table_name(classes)
    forms = F.array_distinct(F.array(F.lower("table_name"), F.lower("name"), F.lower(X.camel_to_snake(F.col("name")))))
    return t.select("repo_id", F.col("name").alias("entity"), "class_fqn", "table_name",
                    F.explode(forms).alias("alias"))


def validate_tables(ops: DataFrame, classes: DataFrame) -> DataFrame:
    """F18 ``validate_tables``: keep the tables that name an entity (table
    name, class name, or snake/camel forms, case-insensitive); drop
    operations left with none; keep operations that had no tables."""
    key = ["repo_id", "class_fqn", "method_name", "sql", "op_type"]
    al = entity_aliases(classes).select("repo_id", "alias").distinct()
    o = ops.withColumn("_oid", F.xxhash64(*key, F.array_join("tables", "\u0001")))
    t = o.select("repo_id", "_oid", F.posexplode("tables").alias("pos", "table"))
    a1 = t.withColumn("_k", F.lower("table"))
    a2 = t.withColumn("_k", F.lower(X.snake_to_camel(F.col("table"), True)))
    ok = a1.join(al.withColumnRenamed("alias", "_k"), ["repo_id", "_k"], "left_semi") \
        .unionByName(a2.join(al.withColumnRenamed("alias", "_k"), ["repo_id", "_k"], "left_semi")) \
        .select("repo_id", "_oid", "pos", "table").distinct()
    kept = ok.groupBy("repo_id", "_oid").agg(F.array_sort(F.collect_list(F.struct("pos", "table"))).alias("_t")) \
        .select("repo_id", "_oid", F.transform("_t", lambda x: x["table"]).alias("_valid"))
    j = o.join(kept, ["repo_id", "_oid"], "left")
    return (j.where((F.size("tables") == 0) | F.col("_valid").isNotNull())
            .withColumn("tables", F.when(F.size("tables") == 0, F.col("tables")).otherwise(F.col("_valid")))
            .drop("_oid", "_valid"))


def drop_redundant_interfaces(ops: DataFrame, classes: DataFrame) -> DataFrame:
    """an interface with operations is dropped when a non-interface
    class with operations implements it (matched by FQN or, within the
    repository, by simple name — K9)."""
    with_ops = ops.select("repo_id", "class_fqn").distinct()
    c = classes.select("repo_id", "class_fqn", "name", "kind", "interfaces").join(with_ops, ["repo_id", "class_fqn"],
                                                                                   "left_semi")
    impl = c.where(F.lower("kind") != "interface").select(
        "repo_id", F.explode("interfaces").alias("_if")).select(
        "repo_id", F.regexp_replace("_if", r"<.*$", "").alias("_if")).hint("merge")
    ifaces = c.where(F.lower("kind") == "interface")
    drop1 = ifaces.join(impl.withColumnRenamed("_if", "class_fqn"), ["repo_id", "class_fqn"], "left_semi")
    drop2 = ifaces.join(impl.withColumnRenamed("_if", "name"), ["repo_id", "name"], "left_semi")
    drop = drop1.select("repo_id", "class_fqn").unionByName(drop2.select("repo_id", "class_fqn")).hint("merge")
    return ops.join(drop, ["repo_id", "class_fqn"], "left_anti")


def sql_ops(fx: JavaFacts) -> DataFrame:
    """The whole DAO analysis: candidates → merged sources → validated
    tables → redundant interfaces dropped."""
    def build():
        valid = validate_tables(merge_op_sources(fx), fx.classes)
        return drop_redundant_interfaces(valid, fx.classes)
    return fx.memo("sql_ops", build)


def entity_classes(ops: DataFrame, classes: DataFrame) -> DataFrame:
    """F20 ``entity_classes``: (entity, DAO class) pairs, one row each (the
    reference's set per entity).  A table maps to the first entity by class
    FQN whose alias equals it (or whose name equals its camel form)."""
    al = entity_aliases(classes)
    t = ops.select("repo_id", "class_fqn", F.explode("tables").alias("table")).distinct()
    a1 = t.withColumn("_k", F.lower("table"))
    a2 = t.withColumn("_k", F.lower(X.snake_to_camel(F.col("table"), True)))
    m = a1.unionByName(a2).join(al.select("repo_id", F.col("alias").alias("_k"), "entity",
                                          F.col("class_fqn").alias("_efqn")), ["repo_id", "_k"])
    w = Window.partitionBy("repo_id", "class_fqn", "table").orderBy("_efqn")
    m = m.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return m.select("repo_id", "entity", "class_fqn").distinct()


def entity_schema(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """F25 ``entity_schema``: entity fields with a PK mark (an ``@Id``
    annotation) and simple type; a synthetic ``id : long`` PK row for an
    entity without one."""
    e = classes.where(is_entity(classes)).select("repo_id", "path", "class_fqn", F.col("name").alias("entity"))
    f = fields.join(e, ["repo_id", "path", "class_fqn"]).select(
        "repo_id", "path", "entity", "ordinal", F.col("name").alias("field"),
        F.substring_index(F.coalesce("declared_type", F.lit("Object")), ".", -1).alias("type"),
        F.exists("annotations", lambda a: a.contains("@Id")).alias("is_pk"))
    has_pk = f.groupBy("repo_id", "path", "entity").agg(F.bool_or("is_pk").alias("_pk"))
    synth = e.join(has_pk.where("_pk"), ["repo_id", "path", "entity"], "left_anti").select(
        "repo_id", "path", "entity", F.lit(-1).alias("ordinal"), F.lit("id").alias("field"), F.lit("long").alias("type"),
        F.lit(True).alias("is_pk"))
    return f.unionByName(synth).drop("path")


def jpa_relation_edges(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """F26 ``jpa_relation_edges``: entity field whose (element) type is an
    entity → edge with the arrow of its JPA annotation, or a collection
    edge."""
    e = classes.where(is_entity(classes)).select("repo_id", "path", "class_fqn", F.col("name").alias("src"))
    names = classes.where(is_entity(classes)).select("repo_id", F.col("name").alias("dst")).distinct()
    f = fields.join(e, ["repo_id", "path", "class_fqn"]).where(F.size("annotations") > 0)
    simple = F.substring_index("declared_type", ".", -1)
    target = F.replace(F.regexp_replace(simple, r".*<", ""), F.lit(">"), F.lit(""))
    f = f.select("repo_id", "src", F.col("name").alias("field"), simple.alias("_simple"), target.alias("dst"),
                 "annotations")
    f = f.join(names, ["repo_id", "dst"])

    def has(a):
        return F.exists("annotations", lambda x: x.contains(a))
    coll = F.startswith("_simple", F.lit("List")) | F.startswith("_simple", F.lit("Set")) | \
        F.startswith("_simple", F.lit("Collection"))
    arrow = (F.when(has("@OneToMany"), "||--o{").when(has("@ManyToOne"), "}o--||")
             .when(has("@OneToOne"), "||--||").when(has("@ManyToMany"), "}o--o{").when(coll, ".."))
    label = (F.when(has("@OneToMany") | has("@ManyToOne") | has("@OneToOne"), F.col("field"))
             .when(has("@ManyToMany"), F.concat("field", F.lit(" (ManyToMany)")))
             .when(coll, F.concat("field", F.lit(" (collection)"))))
    return f.select("repo_id", "src", "dst", arrow.alias("arrow"), label.alias("label")).where(F.col("arrow").isNotNull())


def dao_entity_edges(ops: DataFrame, classes: DataFrame) -> DataFrame:
    """F27 ``dao_entity_edges``: DAO class ``..>`` entity "operates on",
    distinct; a table names the entity by camel form, else by snake form."""
    names = classes.where(is_entity(classes)).select("repo_id", F.col("name").alias("entity")).distinct()
    t = ops.select("repo_id", "class_fqn", F.explode("tables").alias("table")).distinct()
    guess = t.withColumn("entity", X.snake_to_camel(F.col("table"), True)).join(names, ["repo_id", "entity"])
    sn = names.withColumn("_s", F.lower(X.camel_to_snake(F.col("entity"))))
    by_snake = t.withColumn("_s", F.lower("table")).join(sn, ["repo_id", "_s"]).drop("_s")
    u = guess.select("repo_id", "class_fqn", "entity").unionByName(by_snake.select("repo_id", "class_fqn", "entity"))
    return u.distinct().select("repo_id", F.substring_index("class_fqn", ".", -1).alias("dao"), "entity",
                               F.lit("..>").alias("arrow"), F.lit("operates on").alias("label"))


def is_entity_ui(annotations: Column, kind: Column) -> Column:
    """F28 ``is_entity`` (UI rule): kind entity, or an annotation whose
    core name ends with ``Entity``."""
    return (F.lower(kind) == "entity") | F.exists(annotations, lambda a: a.rlike(r"^@?[^(]*Entity(\(|$)"))


def entity_endpoints(classes: DataFrame, eps: DataFrame) -> DataFrame:
    """F29 ``entity_endpoints``: endpoints that use an entity — its simple
    name or FQN equals the request or response body type or the class, or
    the handler text contains its name — deduplicated per entity on
    (method, path, handler).

    The "contains" test is exact without pairing every endpoint with every
    entity: an entity name has no dot, so it can only occur inside one
    identifier run of the handler; every substring of every run becomes a
    key (bounded by identifier length) and meets the names in an
    equi-join.  A contained FQN implies a contained simple name, so the
    name join covers it."""
    ents = classes.where(is_entity_ui(F.col("annotations"), F.col("kind"))).select(
        "repo_id", F.col("name").alias("entity"), F.col("class_fqn").alias("entity_fqn"))
    keys = ents.select("repo_id", "entity", F.explode(F.array("entity", "entity_fqn")).alias("k"))
    e = eps.select("repo_id", "http_method", "path", "handler", "class_fqn", "request_body_type", "response_body_type")
    eq = None
    for c in ["request_body_type", "response_body_type", "class_fqn"]:
        j = e.join(keys, (e.repo_id == keys.repo_id) & (e[c] == keys.k)).select(
            e.repo_id, "entity", "http_method", "path", "handler")
        eq = j if eq is None else eq.unionByName(j)
    runs = F.regexp_extract_all("handler", F.lit(r"[\w$]+"), 0)
    subs = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(
            F.sequence(i, F.length(r)), lambda j: F.substr(r, i, j - i + 1)))))))
    sub = e.select("repo_id", "http_method", "path", "handler", F.explode(subs).alias("entity"))
    contains = sub.join(ents.select("repo_id", "entity").distinct(), ["repo_id", "entity"]).select(
        "repo_id", "entity", "http_method", "path", "handler")
    return eq.unionByName(contains).dropDuplicates(["repo_id", "entity", "http_method", "path", "handler"])
