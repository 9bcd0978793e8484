"""Diagram texts (I16) as numbered lines.

A diagram of a huge repository is many rows, never one value: lines carry a
sort key (section, class, part, place) and get their numbers by range
partitions (``number_within``); a writer puts them out in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.operators.facts import JavaFacts
from srcframe.operators.numbering import number_within
from srcframe.operators.structure import (association_edges, class_member_lines, component_call_edges,
                                          component_field_edges, components, er_edges, inheritance_edges, puml_id,
                                          puml_label, wsdl_edges)

# First lines of the diagrams, lines that stand for an empty one, and the last line.
HEADERS = {
    "class": ["@startuml", "skinparam classAttributeIconSize 0", "skinparam stereotypeCBackgroundColor transparent",
              "hide empty members"],
    "er": ["@startuml", "!define table(x) class x << (T,#FFAAAA) >>", "hide empty members"],
    "component": ["@startuml", "skinparam componentStyle uml2", "skinparam packageStyle rect", "left to right direction"],
}
EMPTY = {
    "er": ["@startuml", "!define table(x) class x << (T,#FFAAAA) >>", "hide empty members",
           'class "No Entities Found" as NoEntities << (T,#FFAAAA) >> {', "  This project has no JPA entities", "}"],
    "component": ["@startuml", "skinparam componentStyle uml2", "component [No Components Found] as NoComponents",
                  "note right of NoComponents", "  This project has no Spring components",
                  "  or SOAP services/endpoints identified.", "end note"],
}
LAST = "@enduml"

KEY = ["section", "owner", "part", "place"]


def _lines(df: DataFrame, text, section: int, owner="", part=0, place=0) -> DataFrame:
    col = lambda x, t: (F.lit(x) if isinstance(x, (int, str)) else x).cast(t)
    return df.select("repo_id", col(section, "int").alias("section"), col(owner, "string").alias("owner"),
                     col(part, "int").alias("part"), col(place, "int").alias("place"), text.alias("text"))


def _fixed(repos: DataFrame, lines: list[str]) -> DataFrame:
    x = repos.select("repo_id", F.posexplode(F.array(*map(F.lit, lines))).alias("n", "line"))
    return _lines(x, F.col("line"), 0, place=F.col("n"))


def _edges(edges: DataFrame, section: int) -> DataFrame:
    text = F.concat(F.concat_ws(" ", "src", "arrow", "dst"),
                    F.when(F.col("label") != "", F.concat(F.lit(" : "), F.col("label"))).otherwise(""))
    return _lines(edges, text, section)


def _owner(df: DataFrame) -> DataFrame:
    """Class name and file as one key: two modules may hold one class name."""
    return df.withColumn("class_fqn", F.concat_ws(" ", "class_fqn", "path"))


def _blocks(classes: DataFrame, head, section: int) -> DataFrame:
    c = _owner(classes)
    return _lines(c, head, section, F.col("class_fqn")).unionByName(
        _lines(c, F.lit("}"), section, F.col("class_fqn"), part=9))


def class_diagram(fx: JavaFacts) -> DataFrame:
    """Every type with its members, then inheritance, then associations."""
    c = fx.classes
    kind = F.when(F.col("kind") != "class", F.concat(F.lit(" <<"), F.col("kind"), F.lit(">> "))).otherwise("")
    head = F.concat(F.lit('class "'), F.col("name"), F.lit('" as '), puml_id(F.col("name")), kind, F.lit(" {"))
    members = class_member_lines(c, _owner(fx.fields), _owner(fx.methods))
    return (_fixed(c.select("repo_id").distinct(), HEADERS["class"]).unionByName(_blocks(c, head, 1))
            .unionByName(_lines(members, F.concat(F.lit("  "), F.col("line")), 1, F.col("class_fqn"),
                                F.col("section") + 1, F.col("ordinal")))
            .unionByName(_edges(inheritance_edges(c), 2)).unionByName(_edges(association_edges(c, fx.fields), 3)))


def er_diagram(fx: JavaFacts) -> DataFrame:
    """Entities with their fields, then their relations; fixed lines without any entity."""
    ents = fx.classes.where(F.lower("kind") == "entity")
    repos, some = fx.classes.select("repo_id").distinct(), ents.select("repo_id").distinct()
    fields = _owner(fx.fields.join(ents.select("repo_id", "path", "class_fqn"), ["repo_id", "path", "class_fqn"], "left_semi"))
    line = F.concat(F.lit("  "), puml_label(F.col("name")), F.lit(" : "), puml_label(F.coalesce("declared_type", F.lit("Object"))))
    return (_fixed(repos.join(some, "repo_id", "left_anti"), EMPTY["er"]).unionByName(_fixed(some, HEADERS["er"]))
            .unionByName(_blocks(ents, F.concat(F.lit("table("), F.col("name"), F.lit(") {")), 1))
            .unionByName(_lines(fields, line, 1, F.col("class_fqn"), 1, F.col("ordinal")))
            .unionByName(_edges(er_edges(fx.classes, fx.fields), 2)))


def component_diagram(fx: JavaFacts) -> DataFrame:
    """Components by package, then edges by field, by call and to the WSDL; fixed lines without any component."""
    comp = components(fx.classes)
    repos, some = fx.classes.select("repo_id").distinct(), comp.select("repo_id").distinct()
    to_wsdl = wsdl_edges(fx.classes)
    soap = to_wsdl.select("repo_id").distinct()
    packs = comp.where("package != 'default_package'").select("repo_id", "package").distinct()
    box = F.concat(F.lit("  component ["), puml_label(F.col("name")), F.lit("] as "), puml_id(F.col("name")),
                   F.lit(" <<"), F.col("role"), F.lit(">>"))
    return (_fixed(repos.join(some, "repo_id", "left_anti"), EMPTY["component"])
            .unionByName(_fixed(some, HEADERS["component"]))
            .unionByName(_lines(soap, F.lit('interface "WSDL" as WSDL0'), 1))
            .unionByName(_lines(packs, F.concat(F.lit('package "'), F.col("package"), F.lit('" {')), 2, F.col("package")))
            .unionByName(_lines(comp, box, 2, F.col("package"), 1))
            .unionByName(_lines(packs, F.lit("}"), 2, F.col("package"), 9))
            .unionByName(_edges(component_field_edges(fx.classes, fx.fields), 3))
            .unionByName(_edges(component_call_edges(fx.classes, fx.calls), 4)).unionByName(_edges(to_wsdl, 5)))


def diagram_text(fx: JavaFacts) -> DataFrame:
    """I16 ``diagram_text``: ``(repo_id, diagram, line_no, text)`` of the
    class, entity-relationship and component diagram of every repository that
    has a type: header, nodes by class name (or package), edges by text, last
    line; numbers run from 1."""
    out = None
    for name, make in (("class", class_diagram), ("er", er_diagram), ("component", component_diagram)):
        lines = make(fx).unionByName(_lines(fx.classes.select("repo_id").distinct(), F.lit(LAST), 99))
        lines = lines.withColumn("diagram", F.lit(name))
        out = lines if out is None else out.unionByName(lines)
    return number_within(out, ["repo_id", "diagram"], [*KEY, "text"], "line_no").select("repo_id", "diagram", "line_no", "text")
