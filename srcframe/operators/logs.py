"""Log insights (section E): log and stdout statements with risk flags.

``log_statements(repo_id, log_id, class_fqn, line, level, message,
variables array<struct<name,type,is_pii,is_pci>>, is_pii_risk, is_pci_risk)``.
All risk logic is column expressions (``rlike`` over the keyword families,
``exists`` over the variable array): map-only, codegen'd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcframe.operators.sensitive import log_catalog

_PII, _PCI, _GEN = log_catalog()
PII_RX, PCI_RX, GENERAL_RX = _PII.java, _PCI.java, _GEN.java

# The call names that are log calls (case-insensitive).
LOG_LEVELS = ["trace", "debug", "info", "warn", "error"]
# Type-name words for the type-based rules (lower case).
PII_TYPE_WORDS = ["user", "customer", "account", "person"]
PII_TYPE_EXCEPT = ["id", "count", "type"]
PCI_TYPE_WORDS = ["card", "payment", "transactiondetail"]
PCI_TYPE_EXCEPT = ["id", "status", "type"]


def _any_contains(s: Column, words: list[str]) -> Column:
    c = None
    for w in words:
        x = s.contains(w)
        c = x if c is None else (c | x)
    return c


def message_risk(msg: Column) -> Column:
    """E5 ``message_risk``: struct of PII / PCI / general keyword hits,
    case-insensitive ``find``."""
    return F.struct(F.coalesce(msg.rlike(PII_RX), F.lit(False)).alias("pii"),
                    F.coalesce(msg.rlike(PCI_RX), F.lit(False)).alias("pci"),
                    F.coalesce(msg.rlike(GENERAL_RX), F.lit(False)).alias("general"))


def variable_name_risk(name: Column) -> Column:
    """E6 ``variable_name_risk``: the same regexes on the variable name."""
    return message_risk(name)


def variable_type_risk(vtype: Column) -> Column:
    """E7 ``variable_type_risk``: (pii, pci) from the type's name."""
    t = F.lower(F.coalesce(vtype, F.lit("")))
    pii = _any_contains(t, PII_TYPE_WORDS) & ~_any_contains(t, PII_TYPE_EXCEPT)
    pci = _any_contains(t, PCI_TYPE_WORDS) & ~_any_contains(t, PCI_TYPE_EXCEPT)
    return F.struct(pii.alias("pii"), pci.alias("pci"))


def log_variable(name: Column, vtype: Column) -> Column:
    """E4 + E6 + E7 + E8: one variable struct with its flags; a general
    keyword in the name sets both flags."""
    nr = variable_name_risk(name)
    tr = variable_type_risk(vtype)
    return F.struct(name.alias("name"), vtype.alias("type"),
                    (nr["pii"] | tr["pii"] | nr["general"]).alias("is_pii"),
                    (nr["pci"] | tr["pci"] | nr["general"]).alias("is_pci"))


def statement_risk(df: DataFrame, message_is_literal: Column | None = None) -> DataFrame:
    """E8 + E9: statement flags = message risk (literal messages only) OR
    any variable flagged; a general keyword in the message sets both."""
    lit_msg = message_is_literal if message_is_literal is not None else F.lit(True)
    mr = message_risk(F.col("message"))
    pii_m = lit_msg & mr["pii"]
    pci_m = lit_msg & mr["pci"]
    gen_m = lit_msg & mr["general"]
    vp = F.coalesce(F.exists("variables", lambda v: v["is_pii"]), F.lit(False))
    vc = F.coalesce(F.exists("variables", lambda v: v["is_pci"]), F.lit(False))
    return df.withColumn("is_pii_risk", pii_m | vp | gen_m).withColumn("is_pci_risk", pci_m | vc | gen_m)


def log_id(*cols: str) -> Column:
    """Deterministic statement id (the reference draws a random UUID)."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)


def available_levels(logs: DataFrame) -> DataFrame:
    """E11 ``available_levels``: distinct upper-case levels, nulls dropped,
    sorted.  Partial aggregation → tiny shuffle."""
    return (logs.select(F.upper("level").alias("level")).where(F.col("level").isNotNull())
            .distinct().orderBy("level"))


def filter_logs(logs: DataFrame, term: str | None = None, level: str | None = None,
                pii: bool = False, pci: bool = False) -> DataFrame:
    """E12 ``filter_logs``: conjunctive optional filters; the term is a
    case-insensitive substring of class or message."""
    out = logs
    if term:
        t = F.lower(F.lit(term))
        out = out.where(F.lower("class_fqn").contains(t) | F.lower("message").contains(t))
    if level:
        out = out.where(F.lower("level") == F.lower(F.lit(level)))
    if pii:
        out = out.where("is_pii_risk")
    if pci:
        out = out.where("is_pci_risk")
    return out


def variables_text(variables: Column) -> Column:
    """``name (type) [PII] [PCI]`` joined by ``, ``; ``N/A`` if none."""
    parts = F.transform(variables, lambda v: F.concat(
        v["name"], F.lit(" ("), v["type"], F.lit(")"),
        F.when(v["is_pii"], F.lit(" [PII]")).otherwise(F.lit("")),
        F.when(v["is_pci"], F.lit(" [PCI]")).otherwise(F.lit(""))))
    return F.when(F.coalesce(F.size(variables), F.lit(0)) > 0, F.array_join(parts, ", ")) \
        .otherwise(F.lit("N/A"))


def export_log_report(logs: DataFrame) -> DataFrame:
    """A9 ``export_log_report``: the seven report columns (the PDF export
    re-aimed as a table to be written with ``.write.csv(header=True)``)."""
    return logs.select(
        "repo_id",
        F.col("class_fqn").alias("class_name"),
        F.col("line"),
        F.upper("level").alias("level"),
        F.col("message"),
        F.when(F.col("is_pii_risk"), "Yes").otherwise("No").alias("pii_risk"),
        F.when(F.col("is_pci_risk"), "Yes").otherwise("No").alias("pci_risk"),
        variables_text(F.col("variables")).alias("variables"),
    )


# ------------------------------------------------------- Java log statements

def _unquote(lit: Column) -> Column:
    """Content of a string literal as written (escapes kept)."""
    return F.regexp_extract(lit, r'^"(.*)"$', 1)


def log_variable_of(arg: Column) -> Column:
    """E4 ``log_variables``: one argument → (name, type) before flags:
    a variable → its name and resolvable type (``complex_object`` when not
    resolvable), ``this.f`` → ``f``, a literal → its text and type, anything
    else (calls, expressions) → its text and ``complex_object``."""
    from srcframe.operators.facts import is_declared, literal_type, var_type
    ident = arg.rlike(r"^[\w$]+$")
    this_f = F.regexp_extract(arg, r"^this\.([\w$]+)$", 1)
    lt = literal_type(arg)
    name = (F.when(ident, arg).when(this_f != "", this_f).otherwise(arg))
    vtype = (F.when(lt.isNotNull(), lt)
             .when(ident & is_declared(arg), F.coalesce(var_type(arg), F.lit("complex_object")))
             .when(this_f != "", F.coalesce(F.col("_fvars")[this_f], F.lit("complex_object")))
             .otherwise(F.lit("complex_object")))
    return F.struct(name.alias("name"), vtype.alias("type"))


def java_log_statements(fx) -> DataFrame:
    """E1 + E2 + E3 + E4 + E9 + E10 over the fact tables of a Java corpus:
    ``log_statements(repo_id, log_id, path, class_fqn, line, source, level,
    message, variables, is_pii_risk, is_pci_risk)``; ``source`` tells logger
    calls from standard output.

    E1: calls named trace/debug/info/warn/error with a scope (its type is
    not checked).  E2: ``System.out/err.print(ln)`` at level debug.  E3: a
    literal first argument is the message, else ``{DYNAMIC_MESSAGE}`` /
    ``{DYNAMIC_CONTENT}`` and the argument becomes a variable.  E10: the
    class is the innermost type around the call (``enclosing_class``)."""
    calls = fx.calls
    is_log = F.lower("name").isin(*LOG_LEVELS) & F.col("scope").isNotNull()
    is_out = F.col("name").isin("println", "print") & F.col("scope").isin("System.out", "System.err")
    c = calls.where(is_log | is_out).withColumn("_stdout", is_out & ~is_log)
    c = enclosing_class(c, fx.types)
    mmap, fmap = fx.var_maps
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    c = c.join(mmap, key, "left").join(fmap, ["repo_id", "path", "class_fqn"], "left")
    args = F.coalesce(F.col("arg_texts"), F.array().cast("array<string>"))
    first = F.try_element_at(args, F.lit(1))
    first_lit = F.coalesce(F.startswith(first, F.lit('"')), F.lit(False))
    # stdout statements look only at their first argument
    var_args = (F.when(F.col("_stdout"), F.when(first_lit | first.isNull(), F.array().cast("array<string>"))
                       .otherwise(F.array(first)))
                .when(first_lit, F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0))))
                .otherwise(args))
    message = (F.when(first.isNull(), F.lit(""))
               .when(first_lit, _unquote(first))
               .when(F.col("_stdout"), F.lit("{DYNAMIC_CONTENT}"))
               .otherwise(F.lit("{DYNAMIC_MESSAGE}")))
    level = F.when(F.col("_stdout"), F.lit("debug")).otherwise(F.lower("name"))
    variables = F.transform(var_args, lambda a: log_variable_of(a))
    variables = F.transform(variables, lambda v: log_variable(v["name"], v["type"]))
    out = c.select("repo_id", "path", F.col("enclosing_fqn").alias("class_fqn"), "line",
                   F.when(F.col("_stdout"), F.lit("stdout")).otherwise(F.lit("log")).alias("source"), level.alias("level"), message.alias("message"), variables.alias("variables"),
                   first_lit.alias("_lit"), "file_pos")
    out = statement_risk(out, F.col("_lit")).drop("_lit")
    return out.withColumn("log_id", log_id("repo_id", "path", "file_pos", "message")).drop("file_pos")


def enclosing_class(calls: DataFrame, types: DataFrame) -> DataFrame:
    """E10 ``enclosing_class``: the innermost type whose body contains the
    call.  A range join on (repo_id, path) with the position between the
    body's braces, then the type with the greatest start; calls outside any
    type are dropped (the reference skips them)."""
    t = types.select("repo_id", "path", F.col("class_fqn").alias("enclosing_fqn"), F.col("body_open").alias("_b0"),
                     F.col("body_close").alias("_b1"))
    j = calls.join(t, ["repo_id", "path"]).where((F.col("file_pos") > F.col("_b0")) & (F.col("file_pos") < F.col("_b1")))
    w = Window.partitionBy("repo_id", "path", "file_pos").orderBy(F.col("_b0").desc())
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_b0", "_b1")
