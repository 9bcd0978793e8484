"""Queries for section E over Java sources (host R): log and stdout calls,
messages, variables and the enclosing class."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcframe.operators import logs as L
from srcframe.plans.facts_q import JX, facts
from srcframe.plans.registry import register

LOGX = """lg AS (
  SELECT repo_id, path, class_fqn, 17 AS line, 'log' AS source, 'info' AS level, 'Processing item {} for {}' AS message,
         'id (java.lang.Long), ' || CASE s % 3 WHEN 0 THEN 'email (java.lang.String) [PII]'
           WHEN 1 THEN 'cardNumber (java.lang.String) [PCI]' ELSE 'count (java.lang.String)' END AS variables,
         s % 3 = 0 AS is_pii_risk, s % 3 = 1 AS is_pci_risk, 2 AS n_vars
  FROM jc WHERE t = 1
  UNION ALL
  SELECT repo_id, path, class_fqn, 23, 'stdout', 'debug', 'saving item', 'N/A', false, false, 0
  FROM jc WHERE t = 1 AND s % 7 = 0)"""


def java_logs(spark, sf_dir):
    return L.java_log_statements(facts(spark, sf_dir))


@register("log_calls", f"""WITH {JX},
{LOGX}
SELECT repo_id, class_fqn, line, level FROM lg WHERE source = 'log'""")
def q_log_calls(spark, sf_dir):
    lg = java_logs(spark, sf_dir)
    return lg.where("source = 'log'").select("repo_id", "class_fqn", "line", "level")


@register("stdout_calls", f"""WITH {JX},
{LOGX}
SELECT repo_id, class_fqn, line, level, message FROM lg WHERE source = 'stdout'""")
def q_stdout_calls(spark, sf_dir):
    lg = java_logs(spark, sf_dir)
    return lg.where("source = 'stdout'").select("repo_id", "class_fqn", "line", "level", "message")


@register("log_message", f"""WITH {JX},
{LOGX}
SELECT repo_id, class_fqn, line, message FROM lg""")
def q_log_message(spark, sf_dir):
    return java_logs(spark, sf_dir).select("repo_id", "class_fqn", "line", "message")


@register("log_variables", f"""WITH {JX},
{LOGX}
SELECT repo_id, class_fqn, line, variables, n_vars, is_pii_risk, is_pci_risk FROM lg""")
def q_log_variables(spark, sf_dir):
    lg = java_logs(spark, sf_dir)
    return lg.select("repo_id", "class_fqn", "line", L.variables_text(F.col("variables")).alias("variables"),
                     F.size("variables").alias("n_vars"), "is_pii_risk", "is_pci_risk")


@register("enclosing_class", f"""WITH {JX},
{LOGX}
SELECT repo_id, path, line, class_fqn FROM lg""")
def q_enclosing_class(spark, sf_dir):
    return java_logs(spark, sf_dir).select("repo_id", "path", "line", "class_fqn")
