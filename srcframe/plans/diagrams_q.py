"""Queries for diagram texts (I16) and variable types (H10), host R."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcframe.operators import diagrams as D
from srcframe.operators import facts as B
from srcframe.plans import callgraph_q, structure_q  # noqa: F401  (their twins are parts of the one below)
from srcframe.plans.facts_q import CLASSES_SQL, JX, facts
from srcframe.plans.registry import ORACLE, register
from srcframe.plans.sqlsnip import s
from srcframe.plans.structure_q import COMP_SQL


def _fixed(diagram: str, lines: list[str], repos: str) -> str:
    values = ", ".join(f"({i}, {s(x)})" for i, x in enumerate(lines))
    return f"SELECT repo_id, '{diagram}', 0, '', 0, n, line FROM {repos}, (VALUES {values}) v(n, line)"


def _edges(diagram: str, section: int, query: str) -> str:
    return (f"SELECT repo_id, '{diagram}', {section}, '', 0, 0, src || ' ' || arrow || ' ' || dst || ' : ' || label "
            f"FROM ({ORACLE[query]}) e")


def _no_label(diagram: str, section: int, query: str) -> str:
    return (f"SELECT repo_id, '{diagram}', {section}, '', 0, 0, src || ' ' || arrow || ' ' || dst || "
            f"coalesce(' : ' || label, '') FROM ({ORACLE[query]}) e")


TEXT_SQL = f"""WITH {JX}, {CLASSES_SQL}, {COMP_SQL},
rp AS (SELECT DISTINCT repo_id FROM cls),
ent AS (SELECT *, class_fqn || ' ' || path AS o FROM cls WHERE kind = 'entity'),
re AS (SELECT DISTINCT repo_id FROM ent), rc AS (SELECT DISTINCT repo_id FROM comp),
mem AS (SELECT m.*, c.class_fqn || ' ' || c.path AS o, c.kind FROM ({ORACLE["class_member_lines"]}) m
        JOIN cls c ON c.repo_id = m.repo_id AND c.class_fqn = m.class_fqn),
ln(repo_id, diagram, section, owner, part, place, text) AS (
  {_fixed("class", D.HEADERS["class"], "rp")}
  UNION ALL SELECT repo_id, 'class', 1, class_fqn || ' ' || path, 0, 0, 'class "' || name || '" as ' || name
    || CASE WHEN kind != 'class' THEN ' <<' || kind || '>> ' ELSE '' END || ' {{' FROM cls
  UNION ALL SELECT repo_id, 'class', 1, class_fqn || ' ' || path, 9, 0, '}}' FROM cls
  UNION ALL SELECT repo_id, 'class', 1, o, section + 1, ordinal, '  ' || line FROM mem
  UNION ALL {_edges("class", 2, "inheritance_edges")}
  UNION ALL {_edges("class", 3, "association_edges")}
  UNION ALL {_fixed("er", D.HEADERS["er"], "re")}
  UNION ALL {_fixed("er", D.EMPTY["er"], "(SELECT * FROM rp WHERE repo_id NOT IN (SELECT repo_id FROM re)) q")}
  UNION ALL SELECT repo_id, 'er', 1, o, 0, 0, 'table(' || name || ') {{' FROM ent
  UNION ALL SELECT repo_id, 'er', 1, o, 9, 0, '}}' FROM ent
  UNION ALL SELECT repo_id, 'er', 1, o, 1, ordinal, '  ' || regexp_replace(regexp_extract(line, '^.field. (.static. )?[-+#~](.*)$', 2), ': ', ' : ')
    FROM mem WHERE kind = 'entity' AND section = 0
  UNION ALL {_edges("er", 2, "er_edges")}
  UNION ALL {_fixed("component", D.HEADERS["component"], "rc")}
  UNION ALL {_fixed("component", D.EMPTY["component"], "(SELECT * FROM rp WHERE repo_id NOT IN (SELECT repo_id FROM rc)) q")}
  UNION ALL SELECT DISTINCT repo_id, 'component', 1, '', 0, 0, 'interface "WSDL" as WSDL0' FROM comp WHERE role = 'endpoint'
  UNION ALL SELECT DISTINCT repo_id, 'component', 2, package, 0, 0, 'package "' || package || '" {{' FROM comp
  UNION ALL SELECT repo_id, 'component', 2, package, 1, 0, '  component [' || name || '] as ' || name || ' <<' || role || '>>' FROM comp
  UNION ALL SELECT DISTINCT repo_id, 'component', 2, package, 9, 0, '}}' FROM comp
  UNION ALL {_no_label("component", 3, "component_field_edges")}
  UNION ALL {_edges("component", 4, "component_call_edges")}
  UNION ALL {_edges("component", 5, "wsdl_edges")}
  UNION ALL SELECT repo_id, d, 99, '', 0, 0, '@enduml' FROM rp, (VALUES ('class'), ('er'), ('component')) v(d))
SELECT repo_id, diagram, row_number() OVER (PARTITION BY repo_id, diagram ORDER BY section, owner, part, place, text) AS line_no, text
FROM ln"""


@register("diagram_text", TEXT_SQL)
def q_diagram_text(spark, sf_dir):
    return D.diagram_text(facts(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


@register("variable_types", f"""WITH {JX}
SELECT repo_id, class_fqn, m AS method_name, v AS var, replace(replace(replace(ty, '#1', k1), '#2', k2), '#3', k3) AS vtype
FROM jc, (VALUES (0, 'getItem', 'id', 'Long'), (0, 'getItem', 'note', 'String'), (0, 'createItem', 'body', 'Item#3'),
                 (1, 'process', 'id', 'Long'), (1, 'save', 'body', 'Item#2'),
                 (2, 'findByNameAndStatus', 'name', 'String'), (2, 'findByNameAndStatus', 'status', 'String'),
                 (2, 'saveItem', 'item', 'Item#1'), (2, 'loadById', 'id', 'Long'), (4, 'getItem', 'id', 'String'),
                 (5, 'executeAudit', 'conn', 'Connection'), (5, 'executeAudit', 'sql', 'String'),
                 (5, 'executeAudit', 'copy', 'String')) x(tt, m, v, ty)
WHERE t = tt AND (t != 5 OR variant = 'util')
UNION ALL
SELECT repo_id, class_fqn, 'process', CASE s % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'cardNumber' ELSE 'count' END, 'String'
FROM jc WHERE t = 1""")
def q_variable_types(spark, sf_dir):
    fx = facts(spark, sf_dir)
    return B.variable_types(fx.methods, fx["locals"]).select("repo_id", "class_fqn", "method_name", "var", "vtype")
