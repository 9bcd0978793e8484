"""Queries for section E (log insights) and A9, hosts C and V."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.operators import logs as L
from srcframe.operators.sensitive import log_catalog
from srcframe.plans.registry import register
from srcframe.plans.sqlsnip import s
from srcframe.sources.adapters import conversations_logs, part_identifiers

_PII, _PCI, _GEN = (s(p.re2) for p in log_catalog())


def _any_contains_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {s(w)})" for w in words) + ")"


def _type_flags_sql(t: str) -> tuple[str, str]:
    lt = f"lower(coalesce({t}, ''))"
    pii = f"({_any_contains_sql(lt, L.PII_TYPE_WORDS)} AND NOT {_any_contains_sql(lt, L.PII_TYPE_EXCEPT)})"
    pci = f"({_any_contains_sql(lt, L.PCI_TYPE_WORDS)} AND NOT {_any_contains_sql(lt, L.PCI_TYPE_EXCEPT)})"
    return pii, pci


_TP, _TC = _type_flags_sql("var_type")

CONV_SQL = f"""conv0 AS (
  SELECT 'chat' || CAST(conv_id % 4 AS VARCHAR) AS repo_id, 'conv.' || CAST(conv_id AS VARCHAR) AS class_fqn,
         CAST(turn AS INTEGER) AS line,
         CASE role WHEN 'system' THEN 'debug' WHEN 'user' THEN 'info' WHEN 'assistant' THEN 'warn' END AS level,
         text AS message, role AS var_name, upper(substr(role, 1, 1)) || lower(substr(role, 2)) AS var_type
  FROM conversations),
conv1 AS (
  SELECT *, regexp_matches(message, {_PII}) AS m_pii, regexp_matches(message, {_PCI}) AS m_pci,
         regexp_matches(message, {_GEN}) AS m_gen,
         regexp_matches(var_name, {_PII}) OR {_TP} OR regexp_matches(var_name, {_GEN}) AS v_pii,
         regexp_matches(var_name, {_PCI}) OR {_TC} OR regexp_matches(var_name, {_GEN}) AS v_pci
  FROM conv0),
logs AS (
  SELECT *, (m_pii OR v_pii OR m_gen) AS is_pii_risk, (m_pci OR v_pci OR m_gen) AS is_pci_risk,
         var_name || ' (' || var_type || ')' || CASE WHEN v_pii THEN ' [PII]' ELSE '' END
           || CASE WHEN v_pci THEN ' [PCI]' ELSE '' END AS variables_text
  FROM conv1)"""


def conv_logs(spark, sf_dir) -> DataFrame:
    c = conversations_logs(spark, sf_dir)
    c = c.withColumn("variables", F.array(L.log_variable(F.col("var_name"), F.col("var_type"))))
    return L.statement_risk(c)


@register("message_risk", f"""WITH {CONV_SQL}
SELECT repo_id, class_fqn, line, m_pii AS pii, m_pci AS pci, m_gen AS general FROM logs""")
def q_message_risk(spark, sf_dir):
    c = conversations_logs(spark, sf_dir)
    r = L.message_risk(F.col("message"))
    return c.select("repo_id", "class_fqn", "line", r["pii"].alias("pii"), r["pci"].alias("pci"),
                    r["general"].alias("general"))


@register("general_propagation", f"""WITH {CONV_SQL}
SELECT repo_id, class_fqn, line, m_gen AS general, is_pii_risk, is_pci_risk FROM logs""")
def q_general_propagation(spark, sf_dir):
    lg = conv_logs(spark, sf_dir)
    g = L.message_risk(F.col("message"))["general"]
    return lg.select("repo_id", "class_fqn", "line", g.alias("general"), "is_pii_risk", "is_pci_risk")


@register("statement_risk", f"""WITH {CONV_SQL}
SELECT repo_id, class_fqn, line, level, is_pii_risk, is_pci_risk, variables_text FROM logs""")
def q_statement_risk(spark, sf_dir):
    lg = conv_logs(spark, sf_dir)
    return lg.select("repo_id", "class_fqn", "line", "level", "is_pii_risk", "is_pci_risk",
                     L.variables_text(F.col("variables")).alias("variables_text"))


@register("available_levels", f"""WITH {CONV_SQL}
SELECT DISTINCT upper(level) AS level FROM logs WHERE level IS NOT NULL""")
def q_available_levels(spark, sf_dir):
    return L.available_levels(conv_logs(spark, sf_dir))


@register("filter_logs", f"""WITH {CONV_SQL}
SELECT repo_id, class_fqn, line, level, is_pii_risk, is_pci_risk FROM logs
WHERE (contains(lower(class_fqn), 'conv.1') OR contains(lower(message), 'conv.1'))
  AND lower(level) = 'info' AND is_pii_risk""")
def q_filter_logs(spark, sf_dir):
    f = L.filter_logs(conv_logs(spark, sf_dir), term="CONV.1", level="INFO", pii=True)
    return f.select("repo_id", "class_fqn", "line", "level", "is_pii_risk", "is_pci_risk")


@register("export_log_report", f"""WITH {CONV_SQL}
SELECT repo_id, class_fqn AS class_name, line, upper(level) AS level, message,
       CASE WHEN is_pii_risk THEN 'Yes' ELSE 'No' END AS pii_risk,
       CASE WHEN is_pci_risk THEN 'Yes' ELSE 'No' END AS pci_risk,
       variables_text AS variables FROM logs""")
def q_export_log_report(spark, sf_dir):
    return L.export_log_report(conv_logs(spark, sf_dir))


# Literal corner cases (FIXTURES §4 case_types / names) unioned with the
# identifier column derived from part.
CASE_NAMES = ["userEmail", "cardNumber", "password", "customer_id", "ssn", "e-mail", "myToken",
              "apiKey", "apikey", "firstName", "first_name", "pan", "panel", "name", "getName()"]
CASE_TYPES = ["List<User>", "Map<String,Customer>", "Account[]", "com.acme.Person", "user", "userId",
              "PaymentCard", "cardType", "CardStatus", "TransactionDetail", "AccountCount", "String"]


def _vals(xs):
    return ", ".join(f"({s(x)})" for x in xs)


PART_IDENT_SQL = """part_ident AS (
  SELECT p_partkey,
         split_part(p_name, ' ', 1) || list_aggr(list_transform(string_split(p_name, ' ')[2:],
            lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', '') AS ident,
         upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))
           || upper(substr(string_split(p_name, ' ')[-1], 1, 1)) || lower(substr(string_split(p_name, ' ')[-1], 2))
           AS type_name
  FROM part)"""

_NP, _NC, _NG = (f"regexp_matches(name, {x})" for x in (_PII, _PCI, _GEN))


@register("variable_name_risk", f"""WITH {PART_IDENT_SQL},
names AS (SELECT ident AS name FROM part_ident UNION ALL SELECT * FROM (VALUES {_vals(CASE_NAMES)}) v(name))
SELECT name, {_NP} AS pii, {_NC} AS pci, {_NG} AS general FROM names""")
def q_variable_name_risk(spark, sf_dir):
    names = part_identifiers(spark, sf_dir).select(F.col("ident").alias("name")) \
        .unionByName(spark.createDataFrame([(x,) for x in CASE_NAMES], "name string"))
    r = L.variable_name_risk(F.col("name"))
    return names.select("name", r["pii"].alias("pii"), r["pci"].alias("pci"), r["general"].alias("general"))


_TP2, _TC2 = _type_flags_sql("type")


@register("variable_type_risk", f"""WITH {PART_IDENT_SQL},
types AS (SELECT type_name AS type FROM part_ident UNION ALL SELECT * FROM (VALUES {_vals(CASE_TYPES)}) v(type))
SELECT type, {_TP2} AS pii, {_TC2} AS pci FROM types""")
def q_variable_type_risk(spark, sf_dir):
    types = part_identifiers(spark, sf_dir).select(F.col("type_name").alias("type")) \
        .unionByName(spark.createDataFrame([(x,) for x in CASE_TYPES], "type string"))
    r = L.variable_type_risk(F.col("type"))
    return types.select("type", r["pii"].alias("pii"), r["pci"].alias("pci"))
