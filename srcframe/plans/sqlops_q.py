"""Queries for section F (SQL in code, entities), hosts R and V."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.functions import text as X
from srcframe.operators import sqlops as S
from srcframe.plans.facts_q import JX, facts
from srcframe.plans.registry import register
from srcframe.plans.sqlsnip import s


def _ops_out(df: DataFrame) -> DataFrame:
    return df.select("repo_id", "class_fqn", "method_name", "sql", "op_type",
                     F.array_join("tables", ",").alias("tables"))


OPS_COLS = "repo_id, class_fqn, method_name, sql, op_type, tables"

# expected operations per template, before merging (src: 1 source SQL, 2 names, 3 Spring Data)
EXPECTED_OPS = """ops AS (
  SELECT repo_id, class_fqn, 'executeAudit' AS method_name, 'SELECT * FROM item_' || CAST(k - 2 AS VARCHAR) || ' WHERE id = 1' AS sql,
         'SELECT' AS op_type, 'item_' || CAST(k - 2 AS VARCHAR) AS tables, 'jdbc' AS src FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 'DELETE FROM audit_' || ks || ' WHERE id = 2', 'DELETE', 'audit_' || ks, 'jdbc'
    FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'auditQuery', 'UPDATE item_' || CAST(k - 2 AS VARCHAR) || ' SET name = ''x'' WHERE id = 3', 'UPDATE',
    'item_' || CAST(k - 2 AS VARCHAR), 'literal' FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'loadById', 'SELECT i FROM item_' || k1 || ' i WHERE i.id = ?1', 'SELECT', 'item_' || k1, 'query'
    FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 'getItem', 'SELECT * FROM Item', 'SELECT', 'Item', 'name' FROM jc WHERE t IN (0, 4)
  UNION ALL SELECT repo_id, class_fqn, 'findByNameAndStatus', 'SELECT * FROM Name', 'SELECT', 'Name', 'name' FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 'saveItem', 'INSERT INTO Item (...) VALUES (...)', 'INSERT', 'Item', 'name' FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 'loadById', 'SELECT * FROM id', 'SELECT', 'id', 'name' FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', '/* Operation on Audit */', 'UNKNOWN', 'Audit', 'name'
    FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'findByNameAndStatus',
    'SELECT * FROM Item' || k1 || ' (based on method: findByNameAndStatus)', 'SELECT', 'Item' || k1 || ',ByNameAndStatus', 'spring'
    FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 'saveItem', 'INSERT INTO Item' || k1 || ' (...) VALUES (...) (based on method: saveItem)',
    'INSERT', 'Item' || k1 || ',Item', 'spring' FROM jc WHERE t = 2
  UNION ALL SELECT repo_id, class_fqn, 'loadById', 'SELECT * FROM Item' || k1 || ' (based on method: loadById)', 'SELECT',
    'Item' || k1 || ',ById', 'spring' FROM jc WHERE t = 2),
final_ops AS (
  SELECT repo_id, class_fqn, 'loadById' AS method_name, 'SELECT i FROM item_' || k1 || ' i WHERE i.id = ?1' AS sql,
         'SELECT' AS op_type, 'item_' || k1 AS tables FROM jc WHERE t = 2 AND has1
  UNION ALL SELECT repo_id, class_fqn, 'executeAudit', 'SELECT * FROM item_' || CAST(k - 2 AS VARCHAR) || ' WHERE id = 1', 'SELECT',
    'item_' || CAST(k - 2 AS VARCHAR) FROM jc WHERE t = 5 AND variant = 'util'
  UNION ALL SELECT repo_id, class_fqn, 'auditQuery', 'UPDATE item_' || CAST(k - 2 AS VARCHAR) || ' SET name = ''x'' WHERE id = 3',
    'UPDATE', 'item_' || CAST(k - 2 AS VARCHAR) FROM jc WHERE t = 5 AND variant = 'util')"""


def _q(body: str) -> str:
    return f"WITH {JX},\n{EXPECTED_OPS}\n{body}"


@register("jdbc_sql", _q(f"SELECT {OPS_COLS} FROM ops WHERE src = 'jdbc'"))
def q_jdbc_sql(spark, sf_dir):
    return _ops_out(S.jdbc_sql(facts(spark, sf_dir)))


@register("literal_sql_fallback", _q(f"SELECT {OPS_COLS} FROM ops WHERE src = 'literal'"))
def q_literal_sql_fallback(spark, sf_dir):
    return _ops_out(S.literal_sql_fallback(facts(spark, sf_dir)))


@register("annotated_query_sql", _q(f"SELECT {OPS_COLS} FROM ops WHERE src = 'query'"))
def q_annotated_query_sql(spark, sf_dir):
    return _ops_out(S.annotated_query_sql(facts(spark, sf_dir)))


@register("dedupe_ops", _q(f"SELECT DISTINCT {OPS_COLS} FROM ops WHERE src IN ('jdbc', 'literal', 'query')"))
def q_dedupe_ops(spark, sf_dir):
    return _ops_out(S.source_ops(facts(spark, sf_dir)))


@register("dao_candidates", f"""WITH {JX}
SELECT repo_id, class_fqn FROM jc WHERE t IN (0, 1, 2, 4) OR (t = 5 AND variant = 'util')""")
def q_dao_candidates(spark, sf_dir):
    return S.dao_candidates(facts(spark, sf_dir))


@register("ops_from_method_names", _q(f"SELECT {OPS_COLS} FROM ops WHERE src = 'name'"))
def q_ops_from_method_names(spark, sf_dir):
    return _ops_out(S.ops_from_method_names(facts(spark, sf_dir)))


@register("spring_data_repos", f"""WITH {JX}
SELECT repo_id, class_fqn, 'Item' || k1 AS entity FROM jc WHERE t = 2""")
def q_spring_data_repos(spark, sf_dir):
    return S.spring_data_repos(facts(spark, sf_dir)).select("repo_id", "class_fqn", "entity")


@register("spring_data_ops", _q(f"SELECT {OPS_COLS} FROM ops WHERE src = 'spring'"))
def q_spring_data_ops(spark, sf_dir):
    return _ops_out(S.spring_data_ops(facts(spark, sf_dir)))


@register("merge_op_sources", _q("""SELECT repo_id, class_fqn, method_name, sql, op_type, tables FROM ops
WHERE src IN ('jdbc', 'literal', 'query')
   OR (src = 'name' AND (class_fqn, method_name) NOT IN (SELECT (class_fqn, method_name) FROM ops
                                                          WHERE src IN ('jdbc', 'literal', 'query')))"""))
def q_merge_op_sources(spark, sf_dir):
    return _ops_out(S.merge_op_sources(facts(spark, sf_dir)))


@register("validate_tables", _q(f"SELECT {OPS_COLS} FROM final_ops"))
def q_validate_tables(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return _ops_out(S.validate_tables(S.merge_op_sources(fx), fx.classes))


@register("drop_redundant_interfaces", _q(f"SELECT {OPS_COLS} FROM final_ops"))
def q_drop_redundant_interfaces(spark, sf_dir):
    return _ops_out(S.sql_ops(facts(spark, sf_dir)))


@register("entity_classes", _q("""SELECT DISTINCT f.repo_id, 'Item' || regexp_extract(f.tables, '([0-9]+)$', 1) AS entity,
  f.class_fqn FROM final_ops f"""))
def q_entity_classes(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return S.entity_classes(S.sql_ops(fx), fx.classes)


@register("entity_table_name", f"""WITH {JX}
SELECT repo_id, class_fqn, name, 'item_' || ks AS table_name FROM jc WHERE t = 3""")
def q_entity_table_name(spark, sf_dir):
    return S.entity_table_name(facts(spark, sf_dir).classes)


@register("entity_schema", f"""WITH {JX}
SELECT repo_id, name AS entity, 0 AS ordinal, 'id' AS field, 'Long' AS type, true AS is_pk FROM jc WHERE t = 3
UNION ALL SELECT repo_id, name, 1, 'name', 'String', false FROM jc WHERE t = 3
UNION ALL SELECT repo_id, name, 2, 'parent', 'Item' || CAST(k - 6 AS VARCHAR), false FROM jc WHERE t = 3 AND k >= 6""")
def q_entity_schema(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return S.entity_schema(fx.classes, fx.fields)


@register("jpa_relation_edges", f"""WITH {JX}
SELECT a.repo_id, a.name AS src, b.name AS dst, '}}o--||' AS arrow, 'parent' AS label
FROM jc a JOIN jc b ON b.k = a.k - 6 AND b.repo_id = a.repo_id WHERE a.t = 3""")
def q_jpa_relation_edges(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return S.jpa_relation_edges(fx.classes, fx.fields)


@register("dao_entity_edges", _q("""SELECT DISTINCT f.repo_id, regexp_extract(f.class_fqn, '([^.]+)$', 1) AS dao,
  'Item' || regexp_extract(f.tables, '([0-9]+)$', 1) AS entity, '..>' AS arrow, 'operates on' AS label FROM final_ops f"""))
def q_dao_entity_edges(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return S.dao_entity_edges(S.sql_ops(fx), fx.classes)


@register("is_entity", f"""WITH {JX}
SELECT repo_id, class_fqn, t = 3 AS is_entity FROM jc""")
def q_is_entity(spark, sf_dir):
    c = facts(spark, sf_dir).classes
    return c.select("repo_id", "class_fqn", S.is_entity_ui(F.col("annotations"), F.col("kind")).alias("is_entity"))


# --------------------------------------------------------------- scalars (V)

CASE_METHODS = ["findAll", "getAllOrders", "findByUserIdAndStatus", "findByEmailOrPhoneOrderByName", "loadById",
                "queryCustomers", "selectAccounts", "saveOrder", "insertLine", "persistCart", "storeFiles",
                "updateUser", "mergeProfiles", "deleteByIdAndType", "removeCategories", "execute", "process",
                "countActive", "findByStatus", "getByOrderIdAndCustomerId", "findByAddressesAndAddresses"]
CASE_WORDS = ["categories", "boxes", "items", "class", "status", "bus", "s", "", "houses", "Orders"]
CASE_NAMES = ["userAccount", "HTTPServer", "order_line_item", "a__b", "_lead", "trail_", "Item42Repository",
              "x", "", "already_snake", "ABCd"]
CASE_SQL = [
    "SELECT * FROM orders o", "select a.id from sales.orders AS a join `crm`.`customers` as c on 1=1",
    "INSERT INTO line_items (a) VALUES (1)", "update accounts set x = 1", "DELETE FROM audit_log WHERE id = 1",
    "TRUNCATE TABLE staging", "please select the from list", "  Select x From t1 JOIN t2 ON t1.a = t2.a  ",
    "delete from Carts", "SELECT 1", "with x as (select 1) select * from x",
]


def _method_names(spark, sf_dir) -> DataFrame:
    m = facts(spark, sf_dir).methods.select(F.col("name")).distinct()
    return m.unionByName(spark.createDataFrame([(x,) for x in CASE_METHODS], "name string")).distinct()


def _vals(xs):
    return ", ".join(f"({s(x)})" for x in xs)


# SQL twins of the scalar name functions
def sql_camel_to_snake(c: str) -> str:
    return f"lower(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g'))"


def sql_snake_to_camel(c: str) -> str:
    return (f"coalesce(list_aggr(list_transform(string_split({c}, '_'), "
            f"lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), 'string_agg', ''), '')")


def sql_singularize(c: str) -> str:
    lw = f"lower({c})"
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN {c} "
            f"WHEN ends_with({lw}, 'ies') THEN left({c}, length({c}) - 3) || 'y' "
            f"WHEN ends_with({lw}, 'es') THEN left({c}, length({c}) - 2) "
            f"WHEN ends_with({lw}, 's') AND NOT ends_with({lw}, 'ss') AND NOT ends_with({lw}, 'us') "
            f"THEN left({c}, length({c}) - 1) ELSE {c} END")


def sql_op_type_from_method(c: str) -> str:
    lw = f"lower({c})"

    def st(ps):
        return " OR ".join(f"starts_with({lw}, '{p}')" for p in ps)
    return (f"CASE WHEN {st(X.SELECT_PREFIXES)} THEN 'SELECT' WHEN {st(X.INSERT_PREFIXES)} THEN 'INSERT' "
            f"WHEN {st(X.UPDATE_PREFIXES)} THEN 'UPDATE' WHEN {st(X.DELETE_PREFIXES)} THEN 'DELETE' ELSE 'UNKNOWN' END")


def sql_method_prefix(c: str) -> str:
    return f"regexp_extract({c}, '(?i)^({'|'.join(X.CRUD_PREFIXES)})', 1)"


@register("op_type_from_method", f"""WITH {JX},
names AS (SELECT DISTINCT name FROM (
  SELECT unnest(['getItem', 'createItem', 'process', 'save', 'findByNameAndStatus', 'saveItem', 'loadById', 'executeAudit',
                 'auditQuery']) AS name
  UNION ALL SELECT * FROM (VALUES {_vals(CASE_METHODS)}) v(name)))
SELECT name, {sql_op_type_from_method('name')} AS op_type FROM names""")
def q_op_type_from_method(spark, sf_dir):
    return _method_names(spark, sf_dir).select("name", X.op_type_from_method(F.col("name")).alias("op_type"))


def _sql_entity_from_method(name: str, prefix: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.ENTITY_STOP_FIELDS)
    return f"""(SELECT CASE WHEN {name} IS NULL THEN ''
    WHEN starts_with(rem, 'By') THEN
      CASE WHEN cut IS NOT NULL AND len(ents) > 0
           THEN (SELECT e FROM unnest(ents) u(e) GROUP BY e ORDER BY count(*) DESC, e LIMIT 1)
           ELSE {sql_singularize(f"replace({sql_camel_to_snake('by_')}, '_', '')")} END
    ELSE {sql_singularize("CASE WHEN starts_with(rem, 'All') THEN substr(rem, 4) ELSE rem END")} END
  FROM (SELECT rem, by_, cut,
          list_filter(list_transform(list_filter(string_split_regex(left(by_, cut - 1), 'And|Or'), lambda p: p <> ''),
            lambda f: CASE WHEN lower(f) IN ({stop}) THEN '' WHEN ends_with(f, 'Id') THEN left(f, length(f) - 2)
                           ELSE regexp_extract(f, '^(.[^A-Z]*)', 1) END), lambda e: e <> '') AS ents
        FROM (SELECT rem, by_, list_min(list_filter([instr(by_, 'And'), instr(by_, 'Or'), instr(by_, 'OrderBy')],
                                                    lambda i: i > 1)) AS cut
              FROM (SELECT rem, substr(rem, 3) AS by_
                    FROM (SELECT CASE WHEN starts_with(lower({name}), lower({prefix})) THEN substr({name}, length({prefix}) + 1)
                                      ELSE {name} END AS rem)))))"""


@register("entity_from_method", f"""WITH names AS (SELECT DISTINCT name FROM (
  SELECT unnest(['getItem', 'createItem', 'process', 'save', 'findByNameAndStatus', 'saveItem', 'loadById', 'executeAudit',
                 'auditQuery']) AS name
  UNION ALL SELECT * FROM (VALUES {_vals(CASE_METHODS)}) v(name))),
p AS (SELECT name, {sql_method_prefix('name')} AS prefix FROM names)
SELECT name, prefix, {_sql_entity_from_method('name', 'prefix')} AS entity FROM p WHERE prefix <> ''""")
def q_entity_from_method(spark, sf_dir):
    n = _method_names(spark, sf_dir).withColumn("prefix", X.method_prefix(F.col("name"))).where(F.col("prefix") != "")
    return n.select("name", "prefix", X.entity_from_method(F.col("name"), F.col("prefix")).alias("entity"))


@register("singularize", f"""WITH {JX},
w AS (SELECT DISTINCT word FROM (SELECT name AS word FROM jc UNION ALL SELECT * FROM (VALUES {_vals(CASE_WORDS)}) v(word)))
SELECT word, {sql_singularize('word')} AS singular FROM w""")
def q_singularize(spark, sf_dir):
    w = facts(spark, sf_dir).classes.select(F.col("name").alias("word")) \
        .unionByName(spark.createDataFrame([(x,) for x in CASE_WORDS], "word string")).distinct()
    return w.select("word", X.singularize(F.col("word")).alias("singular"))


@register("camel_to_snake", f"""WITH {JX},
n AS (SELECT DISTINCT name FROM (SELECT name FROM jc UNION ALL SELECT 'item_' || ks FROM jc WHERE t = 3
      UNION ALL SELECT * FROM (VALUES {_vals(CASE_NAMES)}) v(name)))
SELECT name, {sql_camel_to_snake('name')} AS snake, {sql_snake_to_camel('name')} AS camel FROM n""")
def q_camel_to_snake(spark, sf_dir):
    c = facts(spark, sf_dir).classes
    n = c.select("name").unionByName(
        S.entity_table_name(c).select(F.col("table_name").alias("name"))) \
        .unionByName(spark.createDataFrame([(x,) for x in CASE_NAMES], "name string")).distinct()
    return n.select("name", X.camel_to_snake(F.col("name")).alias("snake"),
                    X.snake_to_camel(F.col("name"), True).alias("camel"))


def _sql_synth(op: str, t: str, m: str | None = None) -> str:
    if m is None:
        return (f"CASE {op} WHEN 'SELECT' THEN 'SELECT * FROM ' || {t} WHEN 'INSERT' THEN 'INSERT INTO ' || {t} || ' (...) VALUES (...)' "
                f"WHEN 'UPDATE' THEN 'UPDATE ' || {t} || ' SET ... WHERE ...' WHEN 'DELETE' THEN 'DELETE FROM ' || {t} || ' WHERE ...' "
                f"ELSE '/* Operation on ' || {t} || ' */' END")
    return (f"CASE {op} WHEN 'SELECT' THEN 'SELECT * FROM ' || {t} WHEN 'INSERT' THEN 'INSERT INTO ' || {t} || ' (...) VALUES (...)' "
            f"WHEN 'UPDATE' THEN 'UPDATE ' || {t} || ' SET ... WHERE ...' WHEN 'DELETE' THEN 'DELETE FROM ' || {t} || ' WHERE ...' "
            f"ELSE 'Custom operation on ' || {t} END || ' (based on method: ' || {m} || ')'")


@register("synthetic_sql", f"""WITH {JX},
p AS (SELECT DISTINCT op, name FROM jc, (VALUES ('SELECT'), ('INSERT'), ('UPDATE'), ('DELETE'), ('UNKNOWN')) v(op) WHERE t = 3)
SELECT op AS op_type, name AS entity, {_sql_synth('op', 'name')} AS sql, {_sql_synth('op', 'name', "'m'")} AS sql_with_method
FROM p""")
def q_synthetic_sql(spark, sf_dir):
    c = facts(spark, sf_dir).classes.where(F.col("kind") == "entity").select(F.col("name").alias("entity"))
    ops = ["SELECT", "INSERT", "UPDATE", "DELETE", "UNKNOWN"]
    p = c.select("entity", F.explode(F.array(*[F.lit(o) for o in ops])).alias("op_type")).distinct()
    return p.select("op_type", "entity", X.synthetic_sql(F.col("op_type"), F.col("entity")).alias("sql"),
                    X.synthetic_sql(F.col("op_type"), F.col("entity"), F.lit("m")).alias("sql_with_method"))


@register("method_name_from_op", _q("""SELECT DISTINCT op_type, split_part(tables, ',', 1) AS first_table,
  CASE op_type WHEN 'SELECT' THEN 'find' || """ + sql_snake_to_camel("split_part(tables, ',', 1)") + """ || 's'
    WHEN 'INSERT' THEN 'save' || """ + sql_snake_to_camel("split_part(tables, ',', 1)") + """
    WHEN 'UPDATE' THEN 'update' || """ + sql_snake_to_camel("split_part(tables, ',', 1)") + """
    WHEN 'DELETE' THEN 'delete' || """ + sql_snake_to_camel("split_part(tables, ',', 1)") + """
    ELSE 'access' || """ + sql_snake_to_camel("split_part(tables, ',', 1)") + """ END AS method_name
FROM ops"""))
def q_method_name_from_op(spark, sf_dir):
    fx = facts(spark, sf_dir)
    ops = S.source_ops(fx).unionByName(S.ops_from_method_names(fx).select(*S.source_ops(fx).columns)) \
        .unionByName(S.spring_data_ops(fx).select(*S.source_ops(fx).columns))
    t0 = F.try_element_at(F.col("tables"), F.lit(1))
    return ops.select("op_type", t0.alias("first_table"),
                      X.method_name_from_op(F.col("op_type"), t0).alias("method_name")).distinct()


# SQL-like strings: every literal of every method body and @Query text,
# plus corner cases (FIXTURES case_sql)
SQL_STRINGS = f"""lits AS (SELECT DISTINCT sql FROM (
  SELECT * FROM (VALUES {_vals(CASE_SQL)}) v(sql)
  UNION ALL SELECT 'service.process(fake)' FROM jc WHERE t = 0
  UNION ALL SELECT 'value' || ks FROM jc WHERE t = 1
  UNION ALL SELECT unnest(['Processing item {{}} for {{}}', 'ok', 'saved']) FROM jc WHERE t = 1
  UNION ALL SELECT 'saving item' FROM jc WHERE t = 1 AND s % 7 = 0
  UNION ALL SELECT 'SELECT i FROM item_' || k1 || ' i WHERE i.id = ?1' FROM jc WHERE t = 2
  UNION ALL SELECT unnest(['SELECT * FROM item_' || CAST(k - 2 AS VARCHAR) || ' WHERE id = 1',
                           'DELETE FROM audit_' || ks || ' WHERE id = 2',
                           'UPDATE item_' || CAST(k - 2 AS VARCHAR) || ' SET name = ''x'' WHERE id = 3'])
    FROM jc WHERE t = 5 AND variant = 'util'))"""


def _sql_strings(spark, sf_dir) -> DataFrame:
    fx = facts(spark, sf_dir)
    lits = S.string_literals(fx).select(F.col("literal").alias("sql"))
    q = S.annotated_query_sql(fx).select("sql")
    case = spark.createDataFrame([(x,) for x in CASE_SQL], "sql string")
    return lits.unionByName(q).unionByName(case).distinct()


def _sql_is_sql(c: str) -> str:
    low = f"lower(trim({c}))"
    return "(" + " OR ".join(f"(starts_with({low}, '{a}') AND contains({low}, '{b}'))" for a, b in X.SQL_SHAPES) + ")"


def _sql_op_type(c: str) -> str:
    low = f"lower(trim({c}))"
    return (f"CASE WHEN starts_with({low}, 'select') THEN 'SELECT' WHEN starts_with({low}, 'insert') THEN 'INSERT' "
            f"WHEN starts_with({low}, 'update') THEN 'UPDATE' WHEN starts_with({low}, 'delete') THEN 'DELETE' "
            f"ELSE 'UNKNOWN' END")


def _sql_tables(c: str) -> tuple[str, str]:
    """Words that follow a keyword, without schema and backticks."""
    w = f"regexp_extract_all({c}, '[\\w$.`]+|[^\\s\\w$.`]')"

    def after(words: str) -> str:
        at = f"list_filter(range(1, len({w})), lambda i: lower({w}[i]) in ({words}) and regexp_matches({w}[i + 1], '^[\\w$`]'))"
        name = f"regexp_extract(replace({w}[i + 1], '`', ''), '([^.]*)$', 1)"
        return f"list_sort(list_distinct(list_transform({at}, lambda i: {name})))"
    return after("'from', 'join', 'update', 'into'"), after("'from', 'join', 'update', 'into', 'table'")


_MAIN, _FB = _sql_tables("sql")


@register("is_sql", f"""WITH {JX},
{SQL_STRINGS}
SELECT sql, {_sql_is_sql('sql')} AS is_sql FROM lits""")
def q_is_sql(spark, sf_dir):
    return _sql_strings(spark, sf_dir).select("sql", X.is_sql(F.col("sql")).alias("is_sql"))


@register("sql_op_type", f"""WITH {JX},
{SQL_STRINGS}
SELECT sql, {_sql_op_type('sql')} AS op_type FROM lits""")
def q_sql_op_type(spark, sf_dir):
    return _sql_strings(spark, sf_dir).select("sql", X.sql_op_type(F.col("sql")).alias("op_type"))


@register("sql_tables", f"""WITH {JX},
{SQL_STRINGS}
SELECT sql, array_to_string(CASE WHEN len({_MAIN}) > 0 THEN {_MAIN} ELSE {_FB} END, ',') AS tables FROM lits""")
def q_sql_tables(spark, sf_dir):
    return _sql_strings(spark, sf_dir).select("sql", F.array_join(X.sql_tables(F.col("sql")), ",").alias("tables"))


@register("sql_tables_fallback", f"""WITH {JX},
{SQL_STRINGS}
SELECT sql, array_to_string({_FB}, ',') AS tables FROM lits WHERE len({_MAIN}) = 0""")
def q_sql_tables_fallback(spark, sf_dir):
    d = _sql_strings(spark, sf_dir)
    return d.where(F.size(X.named_after(F.col("sql"), X.TABLE_WORDS)) == 0).select("sql", F.array_join(X.sql_tables(F.col("sql")), ",").alias("tables"))


@register("entity_endpoints", f"""WITH {JX},
ents AS (SELECT repo_id, name AS entity, class_fqn AS entity_fqn FROM jc WHERE t = 3),
ep AS (
  SELECT repo_id, 'GET' AS http_method, '/items/' || ks || '/{{id}}' AS path, class_fqn || '.getItem' AS handler,
         class_fqn, NULL::VARCHAR AS request_body_type, 'String' AS response_body_type FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, 'POST', '/items/' || ks, class_fqn || '.createItem', class_fqn, 'Item' || k3, 'String'
    FROM jc WHERE t = 0
  UNION ALL SELECT repo_id, NULL, NULL, class_fqn || '.getItem', class_fqn, NULL, 'String' FROM jc WHERE t = 4)
SELECT DISTINCT e.repo_id, n.entity, e.http_method, e.path, e.handler
FROM ep e JOIN ents n ON n.repo_id = e.repo_id
WHERE e.request_body_type IN (n.entity, n.entity_fqn) OR e.response_body_type IN (n.entity, n.entity_fqn)
   OR e.class_fqn IN (n.entity, n.entity_fqn) OR contains(e.handler, n.entity) OR contains(e.handler, n.entity_fqn)""")
def q_entity_endpoints(spark, sf_dir):
    from srcframe.operators import endpoints as G
    fx = facts(spark, sf_dir)
    return S.entity_endpoints(fx.classes, G.endpoints(fx))


@register("repo_entity_name", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN NULL ELSE 'Item' || CAST(c_custkey AS VARCHAR) END AS entity
FROM customer""")
def q_repo_entity_name(spark, sf_dir):
    """F22 over one repository class per customer: entity first, id type first,
    or a name that only the class name gives."""
    item = F.concat(F.lit("Item"), F.col("c_custkey").cast("string"))
    kind = F.col("c_custkey") % 5
    bases = F.array(F.lit("java.io.Serializable"), F.when(kind == 0, F.concat(F.lit("JpaRepository<com.acme."), item, F.lit(", Long>")))
                    .when(kind == 1, F.concat(F.lit("CrudRepository<Long, "), item, F.lit(">"))).otherwise(F.lit("Closeable")))
    name = F.when(kind == 2, F.concat(item, F.lit("Repository"))).when(kind == 3, F.concat(item, F.lit("Dao"))) \
        .otherwise(F.lit("Store"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", X.repo_entity_name(bases, name).alias("entity"))
