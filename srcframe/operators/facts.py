"""Lexical fact extraction from Java-like source (section B).

The reference walks a Java syntax tree per file.  Here the same facts come
from one table of tokens, a row each, grouped and ordered by file:

1. *Tokens*: one pattern cuts comments, literals, words and signs; positions
   and lines are running sums.
2. *Depths*: running sums give the depth in braces and parentheses.  Angle
   brackets count where an opener meets its closer with nothing but type
   tokens between; at every level openers and closers alternate, so the next
   one pairs them, and braces and parentheses likewise (``tokens.py``, over
   runs of whole files).
3. *Members*: in a body, a member ends at a semicolon or at the brace that
   closes its block (behind an ``=``, at the semicolon only).  The tokens of a
   member that stand outside of its own brackets form a text without nesting,
   on which plain patterns tell types, fields, methods and constants apart.
   Members, and the calls of method bodies, lie within a file: they are put
   together where the file's tokens are (``tokens.grouped``) and written once as
   Parquet; no table of tokens is sent or written.

No nesting depth is limited; the work is linear in the tokens of a file (and
in the text of the arguments that are returned).

Known losses (documented): no overload resolution by argument types; records
are no types and their members are left out (a nested one is no method); calls
inside a method of a local class belong to that method only; in an expression
``a < b, c > d`` the signs are taken for brackets, as Java itself does in a
declaration.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from srcframe.functions.text import WB_L, WB_R
from srcframe.operators import tokens as token_runs
from srcframe.session import Scratch

cloudpickle.register_pickle_by_value(token_runs)  # travels with the task: executors need no path to this package

# --------------------------------------------------------------- patterns

MASK_RX = ('"""(?s:.*?)"""'
           r'|//[^\n]*+'
           r'|/\*(?s:.*?)\*/'
           r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
           r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'")

ARGS = r'\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)'
ANN = r'@[\w.$]+(?:[ \t]*' + ARGS + r')?'
TYPE = r'[\w.$]+(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?(?:\[\])*'
LOCAL_RX = r'(?<![\w$.])(' + TYPE + r')\s+([\w$]+)\s*(?:=|;|:(?!:))'

TOKEN_RX = MASK_RX + r"|[\w$]+|::|->|[<>=!]=|&&|\|\||[^\s\w$]"
# patterns over the outer tokens of a member, one space between tokens, brackets empty
NAME_S = r'[\w$]+(?: \. [\w$]+)*'
ANN_S = r'@ (?!interface )' + NAME_S + r'(?: \( \))? '
MODS_S = (r'((?:' + ANN_S + r'|(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp'
          r'|transient|volatile|sealed|non - sealed) )*+)')
TYPE_S = r'[\w$]+(?: < >)?(?: \. [\w$]+(?: < >)?)*(?: \[ \])*'
DECL_S = MODS_S + r'(@ interface|class|interface|enum) ([\w$]+)(?= )'
METHOD_S = MODS_S + r'(< > )?(' + TYPE_S + r') ([\w$]+) \( \)(?: \[ \])*(?: throws ([\w$., ]+?))?(?: default .*)? [{;]'
FIELD_S = MODS_S + r'(' + TYPE_S + r') ([\w$]+)(?: \[ \])*(?: [=,].*)? ;$'

# Java keywords that look like types or call names.
NOT_TYPES = ["return", "throw", "new", "else", "case", "yield", "assert", "package", "import",
             "break", "continue", "goto", "instanceof", "public", "protected", "private", "static",
             "final", "abstract", "synchronized", "native", "default", "strictfp", "transient",
             "volatile", "class", "interface", "enum", "extends", "implements", "throws", "do",
             "if", "for", "while", "switch", "try", "catch", "finally", "this", "super"]
# java.lang types used without import
JAVA_LANG = ["String", "Object", "Integer", "Long", "Short", "Byte", "Double", "Float", "Boolean",
             "Character", "Number", "Math", "System", "StringBuilder", "Exception",
             "RuntimeException", "Thread", "Class", "Void", "Iterable", "Enum", "Record"]


# ---------------------------------------------------------------- helpers

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType()),
                     T.StructField("text", T.StringType())])


def _sum_len(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda acc, s: acc + F.length(s))


def spans(text: Column, rx: str) -> Column:
    """Every non-overlapping match of ``rx`` (which must not match the
    empty string) as ``array<struct<start, len, text>>``; start is 1-based.

    ``split`` and ``regexp_extract_all`` see the same matches, so the text
    between matches and the matches alternate; one ``aggregate`` pass keeps
    the running position.  Both regex passes run once per row (they are
    arguments, not referenced inside the lambda)."""
    m = F.regexp_extract_all(text, F.lit(rx), 0)
    g = F.split(text, rx, -1)
    z = F.zip_with(g, m, lambda a, b: F.struct(a.alias("g"), b.alias("m")))
    init = F.struct(F.lit(1).alias("pos"), F.array().cast(T.ArrayType(SPAN)).alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["g"])
        out = F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(
            start.cast("int").alias("start"), F.length(x["m"]).cast("int").alias("len"), x["m"].alias("text"))))
        return F.struct((start + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"), out.alias("out"))
    return F.aggregate(z, init, step, lambda acc: acc["out"])


def mask(content: Column) -> Column:
    """Comments → spaces, literal insides → spaces; newlines and lengths kept."""
    gaps = F.split(content, MASK_RX, -1)
    lits = F.regexp_extract_all(content, F.lit(MASK_RX), 0)

    def blank(x):
        inner = lambda a, b: F.regexp_replace(F.substr(x, F.lit(a + 1), F.length(x) - a - b), r"[^\n]", " ")
        return (F.when(F.startswith(x, F.lit('"""')), F.concat(F.lit('"""'), inner(3, 3), F.lit('"""')))
                .when(F.startswith(x, F.lit('"')), F.concat(F.lit('"'), inner(1, 1), F.lit('"')))
                .when(F.startswith(x, F.lit("'")), F.concat(F.lit("'"), inner(1, 1), F.lit("'")))
                .otherwise(F.regexp_replace(x, r"[^\n]", " ")))
    blanked = F.concat(F.transform(lits, blank), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, blanked, lambda g, b: F.concat(g, b)), "")


def materialize(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The columns come out of a generator (``inline`` of a one-element
    array), so the optimizer neither copies their (large) expressions into
    pushed-down filters nor into later projections.  Nothing is written."""
    s = F.struct(*[e.alias(k) for k, e in exprs.items()])
    return df.select("*", F.inline(F.array(s)))


def bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once: an expression in a lambda is
    computed anew for every element, a lambda's variable is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x: Column) -> Column:
    """Trim all whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


# ----------------------------------------------------------------- files

def masked_files(files: DataFrame) -> DataFrame:
    """``.java`` files with ``masked`` text, package and imports."""
    return packaged(files.where(F.col("path").endswith(".java")).select("repo_id", "path", "content"))


def packaged(files: DataFrame) -> DataFrame:
    """Adds ``masked`` text, package and imports."""
    m = materialize(files, masked=mask(F.col("content")))
    imports = F.regexp_extract_all(F.col("masked"), F.lit(r"(?m)^\s*import\s+(?!static\s)([\w.]+)\s*;"), 1)
    return materialize(m, package=F.regexp_extract("masked", r"(?m)^\s*package\s+([\w.]+)\s*;", 1),
                       imports=imports)


# ---------------------------------------------------------------- tokens

FILE = ["fa", "fb"]  # 128 bits for (repo_id, path): windows sort numbers, not paths


def _file_key() -> list[Column]:
    return [F.xxhash64("repo_id", "path").alias("fa"), F.xxhash64("path", F.lit("/"), "repo_id").alias("fb")]


PART_CHARS = 1 << 20  # text of the files that one partition holds, some 120,000 tokens
SHUFFLE = 4  # such partitions whose facts are one partition of the shuffles behind the tokens


def parts_of(files: DataFrame) -> int:
    """Partitions for the tokens of ``files``: a task's share does not grow with the corpus."""
    chars = files.where(F.col("path").endswith(".java")).agg(F.sum(F.length("content"))).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))


def size_shuffles(spark: SparkSession, parts: int) -> None:
    """Shuffles of the session get at least a partition for ``SHUFFLE`` partitions of
    tokens, so that what a task of a later join or window holds does not grow with the
    corpus either.  Never lowered; adaptive execution joins partitions that are small."""
    key = "spark.sql.shuffle.partitions"
    if int(spark.conf.get(key)) * SHUFFLE < parts:
        spark.conf.set(key, str(-(-parts // SHUFFLE)))


def java_tokens(files: DataFrame, parts: int) -> DataFrame:
    """Tokens of the ``.java`` files, comments left out: ``tokens(fa, fb, i, pos,
    len, line, t, gap, prev, next, bd, p, g, mate, own, inner_p, s1, after_eq, m,
    typed, in_type, block)``.  ``bd``, ``p``: depth in braces and parentheses, of a
    bracket itself the outer one; ``g``: in angle brackets; ``mate``: position of
    the brace's or parenthesis' partner; ``own``: position of the brace that
    opens the body around (0: the file); ``inner_p``: parentheses open since
    then; ``m``: number of the member in that body, ``s1`` the semicolons before;
    ``typed``: the member declares a type; ``in_type``: the body is a type's;
    ``block``: position of the innermost brace around that opens a member's block
    (a method body)."""
    # a file's rows stand together; they are sorted before they are cut
    x = files.where(F.col("path").endswith(".java")).select(*_file_key(), "content").repartition(parts, *FILE)
    x = x.sortWithinPartitions(*FILE).select(*FILE, F.posexplode(_cut_tokens()).alias("i", "z")) \
        .select(*FILE, "i", "z.n", "z.nl", "z.t").where(F.col("t").isNotNull())
    return x.mapInArrow(token_runs.structured, token_runs.SCHEMA)


def _cut_tokens() -> Column:
    content = F.col("content")
    return F.zip_with(F.split(content, TOKEN_RX, -1), F.regexp_extract_all(content, F.lit(TOKEN_RX), 0),
                      lambda g, t: F.struct(F.length(g).alias("n"), count_char(g, "\n").alias("nl"), t.alias("t")))


def java_groups(files: DataFrame, parts: int) -> DataFrame:
    """Members and method bodies with calls of the ``.java`` files, each with its
    tokens: rows of ``tokens.GROUPS``.  Only the files' text is shuffled."""
    x = files.where(F.col("path").endswith(".java")).select(*_file_key(), "repo_id", "path", "content").repartition(parts, *FILE)
    x = packaged(x.sortWithinPartitions(*FILE)).select(*FILE, "repo_id", "path", "package", "imports", _cut_tokens().alias("z"))
    return x.mapInArrow(token_runs.grouped(to_arrow_schema(T._parse_datatype_string(token_runs.GROUPS))), token_runs.GROUPS)


def java_members(groups: DataFrame) -> DataFrame:
    """Members of type bodies and declarations of types, with their tokens:
    ``members(repo_id, path, package, imports, own, m, s1, typed, in_type, toks,
    outer, flat)``; ``outer`` are the tokens outside of the member's brackets
    and ``flat`` their text."""
    x = groups.where(F.col("own").isNotNull()).select("repo_id", "path", "package", "imports", "own", "m", "s1", "typed", "in_type", "toks")
    x = materialize(x, outer=F.filter("toks", lambda k: (k["inner_p"] == 0) & (k["g"] == 0)))
    flat = F.array_join(F.transform("outer", lambda k: F.when(k["t"].rlike("^[\"']"), '""').otherwise(k["t"])), " ")
    return materialize(x, flat=flat)


def token_text(toks: Column) -> Column:
    """Tokens as written, with one space for white space and comments between."""
    return F.array_join(F.transform(toks, lambda x, k: F.when(x["gap"] & (k > 0), F.concat(F.lit(" "), x["t"]))
                                    .otherwise(x["t"])), "")


def _end(x: Column) -> Column:
    return x["pos"] + x["len"]


def outer_text(part: Column, toks: Column = None) -> Column:
    """Text of consecutive outer tokens with all that stands in their brackets."""
    toks = F.col("toks") if toks is None else toks
    ends = bound(part, lambda x: F.struct(F.try_element_at(x, F.lit(1))["pos"].alias("low"),
                                          F.try_element_at(x, F.lit(-1))["pos"].alias("high")))
    return bound(ends, lambda e: token_text(F.filter(toks, lambda x: (x["pos"] >= e["low"]) & (x["pos"] <= e["high"]))))


def _words(flat: Column) -> Column:
    """Tokens of a flat text that ends with a space (or is empty)."""
    return count_char(flat, " ")


def parts_at_commas(toks: Column, comma) -> Column:
    """Tokens cut at those for which ``comma`` holds; empty parts left out."""
    def cut(toks):
        at = F.filter(F.sequence(F.lit(1), F.size(toks)), lambda k: comma(F.element_at(toks, k)))
        at = F.when(F.size(toks) > 0, at).otherwise(F.array().cast("array<int>"))
        return bound(at, lambda at: F.zip_with(F.concat(F.array(F.lit(0)), at), F.concat(at, F.array(F.size(toks) + 1)),
                                               lambda a, z: F.slice(toks, a + 1, z - a - 1)))
    return F.filter(bound(toks, cut), lambda x: F.size(x) > 0)


def annotations_of(outer: Column, count: Column, toks: Column = None) -> Column:
    """Annotations (as written) among the first ``count`` outer tokens."""
    def found(count):
        at = F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                      lambda k: (k <= count) & (F.element_at(outer, k)["t"] == "@"))

        def one(k):
            rest = F.slice(outer, k, count - k + 1)
            flat = F.concat(F.array_join(F.transform(rest, lambda x: x["t"]), " "), F.lit(" "))
            words = bound(F.regexp_extract(flat, "^" + ANN_S, 0), _words)
            return F.regexp_replace(outer_text(F.slice(outer, k, words), toks), r"\s+", " ")
        return F.when(count > 0, F.transform(at, one)).otherwise(F.array().cast("array<string>"))
    return bound(count, found)


def extract_types(members: DataFrame) -> DataFrame:
    """B1 + B4 + B12: one row per type, top-level, nested or local, for every
    file: ``classes(repo_id, path, package, imports, name, class_fqn, decl_kind,
    kind, annotations, parent, interfaces, is_interface, is_abstract, body_open,
    body_close)``.  A nested type's name follows its outer types' in
    ``class_fqn``.  Two local classes of one name differ in ``body_open``."""
    rx = "^" + DECL_S
    t = members.where(F.col("typed") & F.col("flat").rlike(rx + r"[^{;]*\{"))
    head = F.regexp_extract("flat", rx, 0)
    mods, word, name = (F.regexp_extract("flat", rx, k) for k in (1, 2, 3))
    count = _words(head) + 1
    rest = F.slice("outer", count + 1, F.size("outer"))
    upto = F.array_position(F.transform(rest, lambda x: x["t"]), "{").cast("int")
    t = materialize(t, decl_kind=F.replace(word, F.lit(" "), F.lit("")), name=name, mods=mods,
                    tail=F.slice(rest, 1, F.greatest(upto - 1, F.lit(0))), brace=F.element_at(rest, upto))

    def listed(key):
        none = F.array().cast("array<string>")

        def named(after):
            stop = F.filter(F.sequence(F.lit(1), F.size(after) + 1), lambda k: (k > F.size(after)) | F.element_at(
                after, F.least(k, F.greatest(F.size(after), F.lit(1))))["t"].isin("extends", "implements", "permits"))
            names = parts_at_commas(F.slice(after, 1, F.element_at(stop, 1) - 1), lambda x: x["t"] == ",")
            return F.when(F.size(after) > 0, F.transform(names, lambda n: outer_text(n))).otherwise(none)
        at = F.array_position(F.transform("tail", lambda x: x["t"]), key).cast("int")
        return bound(at, lambda at: F.when(at > 0, bound(F.slice("tail", at + 1, F.size("tail")), named)).otherwise(none))
    t = materialize(t, extended=listed("extends"), implemented=listed("implements"),
                    annotations=annotations_of(F.col("outer"), _words(F.col("mods"))))
    t = t.select("repo_id", "path", "package", "imports", "decl_kind", "name", "annotations",
                 F.col("mods").rlike(WB_L + "abstract" + WB_R).alias("is_abstract"),
                 (F.col("decl_kind") == "interface").alias("is_interface"),
                 F.try_element_at("extended", F.lit(1)).alias("parent"),
                 F.when(F.col("decl_kind") == "interface", F.col("extended")).otherwise(F.col("implemented")).alias("interfaces"),
                 F.col("brace.pos").cast("int").alias("body_open"), F.col("brace.mate").cast("int").alias("body_close"))
    # names of the types around, outermost first
    spans_ = t.groupBy("repo_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("body_open", "body_close", "name"))).alias("all"))
    t = t.join(spans_, ["repo_id", "path"])
    around = F.transform(F.filter("all", lambda o: (o["body_open"] < F.col("body_open")) & (F.coalesce(
        o["body_close"], F.lit(1 << 30)) > F.col("body_open"))), lambda o: o["name"])
    t = materialize(t, class_fqn=F.array_join(F.concat(F.array(F.nullif("package", F.lit(""))), around, F.array("name")), "."))
    return materialize(t.drop("all"), kind=classify_kind(F.col("decl_kind"), F.col("name"), F.col("annotations"),
                                                         F.col("parent"), F.col("interfaces"), F.col("package")))


def _ann_core_names(anns: Column) -> Column:
    return F.transform(anns, lambda a: F.regexp_extract(a, r"^@([\w.$]+)", 1))


def classify_kind(decl_kind: Column, name: Column, annotations: Column, parent: Column,
                  interfaces: Column, package: Column) -> Column:
    """B4 ``classify_kind``: ordered rules, first match wins."""
    names = _ann_core_names(annotations)
    simple = F.transform(names, lambda n: F.substring_index(n, ".", -1))

    def any_ends(suf):
        return F.exists(names, lambda n: n.endswith(suf))

    def any_eq(*vals):
        return F.exists(names, lambda n: n.isin(*vals))
    repo_base = "^(JpaRepository|CrudRepository|PagingAndSortingRepository)$"
    ext_simple = F.regexp_replace(F.coalesce(parent, F.lit("")), r"<.*$", "")
    impl_repo = F.exists(F.coalesce(interfaces, F.array().cast("array<string>")),
                         lambda i: F.regexp_replace(i, r"<.*$", "").rlike(repo_base))
    return (F.when(decl_kind == "enum", "enum")
            .when(decl_kind == "@interface", "annotation")
            .when(any_ends("Controller") | any_ends("RestController"), "controller")
            .when(any_ends("Service"), "service")
            .when(any_ends("Repository"), "repository")
            .when(any_eq("WebService", "Endpoint"), "soap")
            .when(name.endswith("Repository"), "repository")
            .when(ext_simple.rlike(repo_base) | impl_repo, "repository")
            .when(any_ends("Component") & any_ends("Configuration"), "config")
            .when(any_ends("Component"), "component")
            .when(any_eq("Entity", "jakarta.persistence.Entity", "javax.persistence.Entity", "Table",
                         "jakarta.persistence.Table", "javax.persistence.Table"), "entity")
            .when(name.endswith("Dao") | name.endswith("DAO"), "repository")
            .when(package.contains(".model") | package.contains(".domain") | package.contains(".dto"), "model")
            .when(decl_kind == "interface", "interface")
            .when(name.endswith("Test") | F.startswith(name, F.lit("Test")), "test")
            .otherwise("class"))


def visibility(mods: Column) -> Column:
    """B6 ``visibility`` from modifier text."""
    return (F.when(mods.rlike(WB_L + "public" + WB_R), "public")
            .when(mods.rlike(WB_L + "protected" + WB_R), "protected")
            .when(mods.rlike(WB_L + "private" + WB_R), "private")
            .otherwise("default"))


def _with_types(members: DataFrame, types: DataFrame) -> DataFrame:
    """Members (no types) with the type that they belong to."""
    own = types.select("repo_id", "path", "class_fqn", F.col("name").alias("class_name"), "decl_kind",
                       F.col("body_open").alias("own"))
    return members.join(own, ["repo_id", "path", "own"])


def extract_fields(members: DataFrame, types: DataFrame, mf: DataFrame) -> DataFrame:
    """B5 + B6 (+ B2 enum constants, B3 annotation members): fields of every
    type, in declaration order.  ``fields(repo_id, path, class_fqn, ordinal,
    name, declared_type, annotations, visibility, is_static, is_final,
    initializer)``; an initializer is the default of an annotation member."""
    rx = "^" + FIELD_S
    f = members.where("in_type and not typed").where(F.col("flat").rlike(rx))
    mods, typ = F.regexp_extract("flat", rx, 1), F.regexp_extract("flat", rx, 2)
    f = materialize(f, mods=mods, n=_words(mods), k=_words(F.concat(typ, F.lit(" "))))
    declarators = parts_at_commas(F.slice("outer", F.col("n") + F.col("k") + 1, F.size("outer")), lambda x: x["t"] == ",")
    f = materialize(f, declared_type=outer_text(F.slice("outer", F.col("n") + 1, F.col("k"))),
                    annotations=annotations_of(F.col("outer"), F.col("n")),
                    names=F.transform(declarators, lambda d: F.element_at(d, 1)["t"]))
    # texts are cut before the members meet their types, so that tokens stay where they are
    f = _with_types(f.select("repo_id", "path", "own", "m", "mods", "declared_type", "annotations", "names"), types) \
        .where(F.col("decl_kind") != "enum")
    order = Window.partitionBy("repo_id", "path", "class_fqn").orderBy("own", "m", "o")
    numbered = (F.row_number().over(order) - 1).cast("int")
    fields = f.where(~F.col("declared_type").isin(*NOT_TYPES)).select("*", F.posexplode("names").alias("o", "field")).select(
        "repo_id", "path", "class_fqn", numbered.alias("ordinal"), F.col("field").alias("name"), "declared_type",
        "annotations", visibility(F.col("mods")).alias("visibility"),
        F.col("mods").rlike(WB_L + "static" + WB_R).alias("is_static"),
        F.col("mods").rlike(WB_L + "final" + WB_R).alias("is_final"), F.lit(None).cast("string").alias("initializer"))
    # enum constants: public static final fields typed by the enum; a constant's
    # body ends a member, so the members before the first semicolon are one list
    none = F.array().cast("array<string>")
    listed = members.where("in_type and not typed and s1 = 0").select(
        "repo_id", "path", "own", "m", F.transform("outer", lambda x: x["t"]).alias("outer"))
    listed = _with_types(listed, types.where(F.col("decl_kind") == "enum")).groupBy("repo_id", "path", "class_fqn", "class_name", "own").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("m", "outer"))), lambda x: x["outer"])).alias("outer"))
    each = parts_at_commas(F.col("outer"), lambda x: x == ",")
    flat = F.transform(each, lambda p: F.concat(F.array_join(p, " "), F.lit(" ")))
    names = F.filter(F.transform(flat, lambda x: F.regexp_extract(x, "^(?:" + ANN_S + r")*+([\w$]+) ", 1)), lambda x: x != "")
    enums = listed.select("*", F.posexplode(names).alias("o", "constant")).select(
        "repo_id", "path", "class_fqn", F.col("o").cast("int").alias("ordinal"), F.col("constant").alias("name"),
        F.col("class_name").alias("declared_type"), none.alias("annotations"), F.lit("public").alias("visibility"),
        F.lit(True).alias("is_static"), F.lit(True).alias("is_final"), F.lit(None).cast("string").alias("initializer"))
    # annotation members: ``Type name() default value;``
    rx = "^" + METHOD_S
    a = members.where("in_type and not typed").where(F.col("flat").rlike(rx))
    mods, typ = F.regexp_extract("flat", rx, 1), F.regexp_extract("flat", rx, 3)
    at = F.array_position(F.transform("outer", lambda x: x["t"]), "default").cast("int")
    low, high = _end(F.element_at("outer", F.greatest(at, F.lit(1)))), F.element_at("outer", -1)["pos"]
    a = materialize(a, n=_words(mods), k=_words(F.concat(typ, F.lit(" "))), member=F.regexp_extract("flat", rx, 4))
    a = materialize(a, declared_type=outer_text(F.slice("outer", F.col("n") + 1, F.col("k"))), low=F.when(at > 0, low),
                    high=F.when(at > 0, high))
    a = _with_types(a.select("repo_id", "path", "own", "m", "member", "declared_type", "low", "high"),
                    types.where(F.col("decl_kind") == "@interface"))
    # a file that declares an annotation type has this word
    texts = mf.where(F.col("content").contains("interface")).select("repo_id", "path", "content")
    a = a.join(texts, ["repo_id", "path"]).withColumn("initializer", strip(F.substr("content", F.col("low"), F.col("high") - F.col("low"))))
    order = Window.partitionBy("repo_id", "path", "class_fqn").orderBy("own", "m")
    a = a.select("repo_id", "path", "class_fqn", (F.row_number().over(order) - 1).cast("int").alias("ordinal"),
                 F.col("member").alias("name"), "declared_type",
                 none.alias("annotations"), F.lit("public").alias("visibility"), F.lit(False).alias("is_static"),
                 F.lit(False).alias("is_final"), "initializer")
    return fields.unionByName(enums).unionByName(a)


PARAM_S = r"^((?:" + ANN_S + r"|final )*+)(" + TYPE_S + r"(?: \. \. \.)?) ([\w$]+)((?: \[ \])*) $"


def parameters(toks: Column) -> Column:
    """Tokens between a method's parentheses → array of ``struct<type, name,
    annotations>``."""
    parts = parts_at_commas(toks, lambda x: (x["t"] == ",") & (x["inner_p"] == 1) & (x["g"] == 0))

    # step by step: what a step yields is a variable of the next, computed once
    x = F.transform(parts, lambda p: F.struct(
        p.alias("part"), F.filter(p, lambda x: (x["inner_p"] == 1) & (x["g"] == 0)).alias("outer")))
    x = F.transform(x, lambda p: F.struct(p["part"].alias("part"), p["outer"].alias("outer"), F.concat(F.array_join(
        F.transform(p["outer"], lambda x: F.when(x["t"].rlike("^[\"']"), '""').otherwise(x["t"])), " "), F.lit(" ")).alias("flat")))
    x = F.transform(F.filter(x, lambda p: p["flat"].rlike(PARAM_S)), lambda p: F.struct(
        p["part"].alias("part"), p["outer"].alias("outer"), p["flat"].alias("flat"),
        bound(F.regexp_extract(p["flat"], PARAM_S, 1), _words).alias("n"),
        bound(F.concat(F.regexp_extract(p["flat"], PARAM_S, 2), F.lit(" ")), _words).alias("k")))
    return F.transform(x, lambda p: F.struct(
        F.concat(outer_text(F.slice(p["outer"], p["n"] + 1, p["k"]), p["part"]),
                 F.replace(F.regexp_extract(p["flat"], PARAM_S, 4), F.lit(" "), F.lit(""))).alias("type"),
        F.regexp_extract(p["flat"], PARAM_S, 3).alias("name"),
        annotations_of(p["outer"], p["n"], p["part"]).alias("annotations")))


def extract_methods(members: DataFrame, types: DataFrame) -> DataFrame:
    """B6 + B7 + B8: the methods of every type with their bodies.
    ``methods(repo_id, path, class_fqn, ordinal, name, return_type, params
    (type, name, annotations), param_texts, annotations, throws, visibility,
    is_static, is_abstract, body_start, body_end)``.  Constructors are not
    methods (as in the reference)."""
    rx = "^" + METHOD_S
    m = members.where("in_type and not typed").where(F.col("flat").rlike(rx))
    g = lambda k: F.regexp_extract("flat", rx, k)
    m = materialize(m, mods=g(1), n=_words(F.concat(g(1), g(2))), k=_words(F.concat(g(3), F.lit(" "))), method=g(4), thrown=g(5))
    at = F.col("n") + F.col("k") + 2
    m = materialize(m, opened=F.element_at("outer", at), closed=F.element_at("outer", at + 1),
                    brace=F.try_element_at(F.filter("outer", lambda x: x["t"] == "{"), F.lit(1)),
                    return_type=outer_text(F.slice("outer", F.col("n") + 1, F.col("k"))))
    inside = F.filter("toks", lambda x: (x["pos"] > F.col("opened.pos")) & (x["pos"] < F.col("closed.pos")))
    m = m.where(~F.col("return_type").isin("record", *NOT_TYPES) & ~F.col("method").isin(*NOT_TYPES))
    m = materialize(m, inside=inside)
    m = materialize(m, params=parameters(F.col("inside")), annotations=annotations_of(F.col("outer"), _words(F.col("mods"))))
    # texts are cut before the members meet their types, so that tokens stay where they are
    m = m.select("repo_id", "path", "package", "imports", "own", "m", "s1", "mods", "method", "thrown", "brace", "return_type",
                 "params", "annotations")
    m = _with_types(m, types).where((F.col("decl_kind") != "@interface") & ~((F.col("decl_kind") == "enum") & (F.col("s1") == 0)))
    order = Window.partitionBy("repo_id", "path", "class_fqn").orderBy("own", "m")
    return m.select(
        "repo_id", "path", "class_fqn", "class_name", "package", "imports",
        (F.row_number().over(order) - 1).cast("int").alias("ordinal"), F.col("method").alias("name"), "return_type", "params",
        F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])).alias("param_texts"), "annotations",
        F.filter(F.transform(F.split("thrown", ","), lambda x: F.replace(x, F.lit(" "), F.lit(""))),
                 lambda x: x != "").alias("throws"),
        visibility(F.col("mods")).alias("visibility"),
        F.col("mods").rlike(WB_L + "static" + WB_R).alias("is_static"),
        F.col("mods").rlike(WB_L + "abstract" + WB_R).alias("is_abstract"),
        (F.col("brace.pos") + 1).cast("int").alias("body_start"), (F.col("brace.mate") - 1).cast("int").alias("body_end"))


def method_bodies(methods: DataFrame, mf: DataFrame) -> DataFrame:
    """Methods joined back to their file text; ``body`` is the text between
    the braces, ``body_offset`` its file position."""
    files = mf.select("repo_id", "path", "content")
    b = methods.where(F.col("body_start").isNotNull()).join(files, ["repo_id", "path"])
    ln = F.col("body_end") - F.col("body_start") + 1
    return b.withColumn("body", F.substr("content", F.col("body_start"), ln)) \
        .withColumn("body_offset", F.col("body_start")) \
        .withColumn("body_line", F.lit(1) + count_char(F.substr("content", F.lit(1), F.col("body_start") - 1), "\n")) \
        .drop("content")


def masked_bodies(bodies: DataFrame) -> DataFrame:
    """Adds ``body_masked``.  No literal or comment reaches over a body's braces,
    which are tokens, so a body is masked as it is in its file."""
    return materialize(bodies, body_masked=mask(F.col("body")))


def extract_locals(bodies: DataFrame) -> DataFrame:
    """B9 ``extract_locals``: "Type name" for every declared local
    (including for-each and catch variables), in order."""
    l = bodies.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                      F.col("ordinal").alias("method_ordinal"),
                      F.posexplode(spans(F.col("body_masked"), LOCAL_RX)).alias("ord", "s"))
    typ = F.regexp_replace(F.regexp_extract(F.col("s.text"), LOCAL_RX, 1), r"\s+", " ")
    nm = F.regexp_extract(F.col("s.text"), LOCAL_RX, 2)
    return l.select("repo_id", "path", "class_fqn", "method_name", "method_ordinal",
                    F.col("ord").cast("int").alias("ordinal"), typ.alias("type"), nm.alias("name")) \
        .where(~F.col("type").isin(*NOT_TYPES) & ~F.col("name").isin(*NOT_TYPES))


def extract_calls(groups: DataFrame, methods: DataFrame) -> DataFrame:
    """B10 ``extract_calls``: method-call expressions of each body in
    post-order (arguments and scope before the call): ordinal = rank of the
    closing parenthesis.  ``calls_raw(repo_id, path, class_fqn,
    method_name, method_ordinal, ordinal, name, scope, args, arg_texts,
    call_pos)``; ``args`` is the argument text, one space for white space.

    A scope is the chain of names, calls and indexes that ends at the dot: at
    one level of parentheses, all tokens since the last that can't go on a
    chain (``tokens.calls``).  Declarations inside a body (methods and
    constructors of local and anonymous classes) and annotations are not calls."""
    # a body's tokens and its calls side by side; slices of the tokens are the texts
    b = groups.where(F.col("block").isNotNull()).select(*FILE, "block", F.col("words").alias("toks"), "calls")

    def text_before(before):
        return F.array_join(F.transform(before, lambda a, k: F.when(
            a["gap"] & (k > 0) & (a["t"] != ".") & (F.element_at(before, F.greatest(k, F.lit(1)))["t"] != "."),
            F.concat(F.lit(" "), a["t"])).otherwise(a["t"])), "")

    def one(c):
        inside = F.slice("toks", c["k"] + 2, c["args_closed"]["k"] - c["k"] - 2)
        before = F.slice("toks", c["start"]["k"], F.greatest(c["k"] - c["start"]["k"] - 1, F.lit(0)))
        expr = F.when(c["scoped"], c["start"]).otherwise(F.struct(c["k"].alias("k"), c["pos"].alias("pos"), c["line"].alias("line")))
        return bound(F.struct(inside.alias("inside"), bound(before, text_before).alias("scope"), expr.alias("expr")),
                     lambda x: made(c, x["inside"], x["scope"], x["expr"]))

    def made(c, inside, scope, expr):
        parts = parts_at_commas(inside, lambda a: (a["t"] == ",") & (a["p"] == c["p"] + 1) & (a["bd"] == c["bd"])
                                & (a["g"] == c["g"]))
        return F.struct(
            c["name"].alias("name"), F.when(c["scoped"], F.nullif(scope, F.lit(""))).alias("scope"), token_text(inside).alias("args"),
            F.transform(parts, token_text).alias("arg_texts"), c["pos"].alias("call_pos"),
            c["args_closed"]["pos"].alias("close_pos"), expr["pos"].alias("file_pos"), expr["line"].alias("line"),
            F.coalesce(F.startswith(scope, F.lit("new ")) & ~scope.rlike(r"[()\[\]{}]") & c["scoped"], F.lit(False)).alias("made"))
    c = b.select(*FILE, "block", F.explode(F.transform("calls", one)).alias("c")).select(*FILE, "block", "c.*") \
        .where(~F.col("made")).drop("made")
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    own = methods.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"), F.col("ordinal").alias("method_ordinal"),
                         (F.col("body_start") - 1).alias("block")).select(*_file_key(), "*")
    c = c.join(own, [*FILE, "block"]).drop(*FILE, "block")
    w = Window.partitionBy(*key).orderBy("close_pos", "call_pos")
    return c.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int"))


# --------------------------------------------------------- name resolution

PRIMITIVES = ["int", "long", "double", "float", "boolean", "char", "byte", "short", "void"]


def qualify(t: Column, imports: Column, package: Column) -> Column:
    """Fully qualified type name by Java's rules for a simple name: a
    single-type import, else ``java.lang``, else the file's own package.
    Primitives and already-dotted names stay; generic and array suffixes
    are kept on the qualified base."""
    base = F.regexp_extract(t, r"^([\w$.]+)", 1)
    rest = F.substr(t, F.length(base) + 1, F.lit(1 << 30))
    imp = F.try_element_at(F.filter(imports, lambda i: i.endswith(F.concat(F.lit("."), base))), F.lit(1))
    q = (F.when(t.isNull() | (base == ""), t)
         .when(base.contains(".") | base.isin(*PRIMITIVES), t)
         .when(imp.isNotNull(), F.concat(imp, rest))
         .when(base.isin(*JAVA_LANG), F.concat(F.lit("java.lang."), t))
         .when(package != "", F.concat(package, F.lit("."), t))
         .otherwise(t))
    return q


def literal_type(a: Column) -> Column:
    """Type of a literal argument, else null."""
    return (F.when(F.startswith(a, F.lit('"')), F.lit("java.lang.String"))
            .when(F.startswith(a, F.lit("'")), F.lit("char"))
            .when(a.rlike(r"^-?[0-9]+[lL]$"), F.lit("long"))
            .when(a.rlike(r"^-?[0-9]+$"), F.lit("int"))
            .when(a.rlike(r"^-?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?[dD]?$"), F.lit("double"))
            .when(a.isin("true", "false"), F.lit("boolean"))
            .when(a == "null", F.lit("null")))


def variable_types(methods: DataFrame, locals_: DataFrame) -> DataFrame:
    """H10 ``variable_types``: per method, variable name → declared type
    from parameters and locals; a local wins over a parameter of the same
    name.  One row per (method, name)."""
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    p = methods.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                       F.col("ordinal").alias("method_ordinal"), F.posexplode("params").alias("o", "p")) \
        .select(*key, F.col("p.name").alias("var"), F.col("p.type").alias("vtype"), F.lit(2).alias("prio"),
                F.col("o").alias("o"))
    l = locals_.select(*key, F.col("name").alias("var"), F.col("type").alias("vtype"), F.lit(1).alias("prio"),
                       F.col("ordinal").alias("o"))
    u = p.unionByName(l)
    w = Window.partitionBy(*key, "var").orderBy("prio", "o")
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "o")


def qualify_calls(calls: DataFrame, methods: DataFrame, fields: DataFrame, locals_: DataFrame,
                  classes: DataFrame) -> DataFrame:
    """B11 ``qualify_calls``: each raw call → ``callee_sig``.

    The scope's type comes from locals, then parameters, then fields (or the
    scope is itself a type name, or absent = the current class); the type is
    qualified by imports / java.lang / package.  A call resolves when that
    class is in the same repository and declares the method (the overload
    with the call's arity first): ``pkg.Class.method(qualified param
    types)``.  Otherwise ``UNRESOLVED_CALL: scope.method(arg types)`` with
    ``UNKNOWN_PARAM_TYPE`` for arguments whose type is not known."""
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    mctx = methods.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                          F.col("ordinal").alias("method_ordinal"), "package", "imports",
                          F.col("class_name").alias("cur_class"))
    vt = variable_types(methods, locals_).hint("merge")
    ft = fields.select("repo_id", "path", "class_fqn", F.col("name").alias("var"), F.col("declared_type").alias("ftype"))
    ft = ft.dropDuplicates(["repo_id", "path", "class_fqn", "var"])
    known = classes.select("repo_id", F.col("class_fqn").alias("kq")).distinct().withColumn("known", F.lit(True))
    c = calls.join(mctx, key, "left")
    # scope → variable
    sv = F.when(F.col("scope").rlike(r"^[\w$]+$"), F.col("scope")) \
        .when(F.col("scope").rlike(r"^this\.[\w$]+$"), F.regexp_extract("scope", r"^this\.([\w$]+)$", 1))
    c = c.withColumn("_sv", sv).withColumn("_this", F.col("scope").rlike(r"^this\."))
    c = c.join(vt.select(*key, F.col("var").alias("_sv"), F.col("vtype").alias("_mv")), key + ["_sv"], "left")
    c = c.join(ft.select("repo_id", "path", "class_fqn", F.col("var").alias("_sv"), "ftype"),
               ["repo_id", "path", "class_fqn", "_sv"], "left")
    vtype = F.when(F.col("_this"), F.col("ftype")).otherwise(F.coalesce(F.col("_mv"), F.col("ftype")))
    as_type = F.when(F.col("_sv").isNotNull() & F.col("_sv").rlike(r"^[A-Z]") & ~F.col("_this"), F.col("_sv"))
    stype = F.when(F.col("scope").isNull() | (F.col("scope") == "this"), F.col("class_fqn")) \
        .otherwise(F.coalesce(vtype, as_type))
    qual = F.when(F.col("scope").isNull() | (F.col("scope") == "this"), F.col("class_fqn")) \
        .otherwise(F.regexp_replace(qualify(stype, F.col("imports"), F.col("package")), r"<.*$", ""))
    c = c.withColumn("_qual", qual)
    c = c.join(known.withColumnRenamed("kq", "_qual"), ["repo_id", "_qual"], "left")
    # candidate declarations in the scope class; of classes that share a name, the
    # caller's own file first, then the first path
    decl = methods.select("repo_id", F.col("path").alias("_dpath"), F.col("class_fqn").alias("_qual"),
                          F.col("name").alias("name"),
                          F.col("ordinal").alias("_dord"), F.col("params").alias("_dparams"),
                          F.col("package").alias("_dpkg"), F.col("imports").alias("_dimp"))
    ck = key + ["ordinal"]
    j = c.join(decl, ["repo_id", "_qual", "name"], "left")
    arity_ok = F.size(F.col("_dparams")) == F.size(F.col("arg_texts"))
    w = Window.partitionBy(*ck).orderBy(F.when(arity_ok, 0).otherwise(1),
                                        F.when(F.col("_dpath") == F.col("path"), 0).otherwise(1), "_dpath",
                                        F.col("_dord").asc_nulls_last())
    j = j.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    ptypes = F.transform(F.col("_dparams"), lambda p: qualify(p["type"], F.col("_dimp"), F.col("_dpkg")))
    resolved_sig = F.concat(F.col("_qual"), F.lit("."), F.col("name"), F.lit("("),
                            F.array_join(ptypes, ", "), F.lit(")"))
    # unresolved: scope shown as its type when that type is resolvable
    resolvable = F.coalesce(F.col("known"), F.lit(False)) | F.startswith(F.col("_qual"), F.lit("java.lang."))
    scope_txt = (F.when(F.col("scope").isNull(), F.col("cur_class"))
                 .when(stype.isNotNull() & resolvable, F.col("_qual"))
                 .otherwise(F.col("scope")))
    j = j.withColumn("_scope_txt", scope_txt)
    return j.select(*ck, "name", "scope", "args", "arg_texts", "call_pos", "close_pos", "file_pos", "line", "_qual", "_scope_txt",
                    F.col("_dparams").isNotNull().alias("resolved"),
                    F.when(F.col("_dparams").isNotNull(), resolved_sig).alias("_rsig"))


def var_maps(methods: DataFrame, locals_: DataFrame, fields: DataFrame, classes: DataFrame):
    """Per method a map variable → qualified type (null when the type is
    not resolvable: not java.lang, primitive or a class of the repository),
    and per class the same for fields.  Each map is built from one method's
    or one class's own declarations: small, bounded groups."""
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    vt = variable_types(methods, locals_)
    mctx = methods.select("repo_id", "path", "class_fqn", F.col("name").alias("method_name"),
                          F.col("ordinal").alias("method_ordinal"), "package", "imports")
    vq = vt.join(mctx, key).withColumn("q", qualify(F.col("vtype"), F.col("imports"), F.col("package")))
    fq = fields.join(classes.select("repo_id", "path", "class_fqn", "package", "imports"),
                     ["repo_id", "path", "class_fqn"]) \
        .select("repo_id", "path", "class_fqn", F.col("name").alias("var"),
                qualify(F.col("declared_type"), F.col("imports"), F.col("package")).alias("q"))
    fq = fq.dropDuplicates(["repo_id", "path", "class_fqn", "var"])
    kc = classes.select("repo_id", F.col("class_fqn").alias("_qb")).distinct().withColumn("_in_repo", F.lit(True))

    def mark(df):
        d = df.withColumn("_qb", F.regexp_replace("q", r"<.*$", "")).join(kc, ["repo_id", "_qb"], "left")
        ok = F.coalesce(F.col("_in_repo"), F.lit(False)) | F.startswith(F.col("q"), F.lit("java.lang.")) \
            | F.col("q").isin(*PRIMITIVES)
        return d.withColumn("q", F.when(ok, F.col("q")))
    vq, fq = mark(vq), mark(fq)
    mmap = vq.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("var", "q"))).alias("_mvars"))
    fmap = fq.groupBy("repo_id", "path", "class_fqn").agg(
        F.map_from_entries(F.collect_list(F.struct("var", "q"))).alias("_fvars"))
    return mmap, fmap


def var_type(a: Column) -> Column:
    """Qualified type of variable ``a`` from ``_mvars`` / ``_fvars`` (null
    if unknown or unresolvable), locals and parameters first."""
    in_method = F.coalesce(F.map_contains_key(F.col("_mvars"), a), F.lit(False))
    return F.when(in_method, F.col("_mvars")[a]).otherwise(F.col("_fvars")[a])


def is_declared(a: Column) -> Column:
    return F.coalesce(F.map_contains_key(F.col("_mvars"), a), F.lit(False)) | \
        F.coalesce(F.map_contains_key(F.col("_fvars"), a), F.lit(False))


def with_arg_types(q: DataFrame, mmap: DataFrame, fmap: DataFrame) -> DataFrame:
    """Argument types for unresolved signatures: literal types, else the
    declared type of a named variable when resolvable (by the maps of
    ``var_maps``), else ``UNKNOWN_PARAM_TYPE``."""
    key = ["repo_id", "path", "class_fqn", "method_name", "method_ordinal"]
    j = q.join(mmap, key, "left").join(fmap, ["repo_id", "path", "class_fqn"], "left")

    def arg_type(a):
        return F.coalesce(literal_type(a), var_type(a), F.lit("UNKNOWN_PARAM_TYPE"))
    types = F.transform(F.coalesce(F.col("arg_texts"), F.array().cast("array<string>")), arg_type)
    unres = F.concat(F.lit("UNRESOLVED_CALL: "), F.col("_scope_txt"), F.lit("."), F.col("name"), F.lit("("),
                     F.array_join(types, ", "), F.lit(")"))
    return j.withColumn("callee_sig", F.when(F.col("resolved"), F.col("_rsig")).otherwise(unres)) \
        .drop("_mvars", "_fvars")


class JavaFacts:
    """Fact tables of a file table, built on first use and sharing one
    masked scan (``facts.classes``, ``facts.fields``, ``facts.methods``,
    ``facts.bodies``, ``facts.locals``, ``facts.calls``).

    Every operator downstream reads several of these tables, so each is
    written the first time it is built, as Parquet below ``spark.checkpoint.dir``:
    plans stay short, a reader takes the columns it needs, and nothing is held by
    executors.  Spark's estimates of such tables say little about their size in
    memory (texts and arrays grow from narrow, well compressed columns), so joins of
    them are merge joins, never broadcasts.  ``save`` writes them as
    parquet tables partitioned by ``repo_id`` for reuse across jobs."""

    WRITTEN = {"groups", "types", "fields", "methods", "bodies", "locals", "raw_calls", "calls"}

    def __init__(self, files: DataFrame, persist: bool = True):
        self._files = files
        self._persist = persist
        self._t: dict[str, DataFrame] = {}
        self._parts: int | None = None
        self._scratch: Scratch | None = None

    def _get(self, name, build):
        if name not in self._t:
            df = build()
            self._t[name] = self._written(df, name) if self._persist and name in self.WRITTEN else df
        return self._t[name]

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        if self._scratch is None:
            self._scratch = Scratch(df.sparkSession, "javafacts")
        return self._scratch.save(df, name).hint("merge")

    def memo(self, name: str, build) -> DataFrame:
        """A derived table, built once per fact set and written as Parquet
        below ``spark.checkpoint.dir``: consumers read the written rows (a short
        plan, no recomputation of the joins and windows behind it) and a lost
        executor cannot lose them."""
        if name not in self._t:
            df = build()
            self._t[name] = self._written(df, name) if self._persist else df
        return self._t[name]

    def unpersist(self) -> None:
        for df in self._t.values():
            df.unpersist()

    def save(self, out: str, names=("classes", "fields", "methods", "locals", "calls")) -> None:
        for n in names:
            df = self[n]
            df = df.drop(*[c for c in ("content", "masked", "body", "body_masked") if c in df.columns])
            df.write.mode("overwrite").partitionBy("repo_id").parquet(f"{out.rstrip('/')}/{n}")

    @property
    def files(self) -> DataFrame:
        return self._get("files", lambda: masked_files(self._files))

    @property
    def texts(self) -> DataFrame:
        return self._files.where(F.col("path").endswith(".java")).select("repo_id", "path", "content").hint("merge")

    @property
    def parts(self) -> int:
        if self._parts is None:
            self._parts = parts_of(self._files)
            size_shuffles(self._files.sparkSession, self._parts)
        return self._parts

    @property
    def tokens(self) -> DataFrame:
        return self._get("tokens", lambda: java_tokens(self._files, self.parts))

    @property
    def members(self) -> DataFrame:
        """The members, dealt by body for those who join them; the facts read
        them as they were written."""
        return self._get("members", lambda: java_members(self.groups).repartition(self.parts, "repo_id", "path", "own"))

    @property
    def groups(self) -> DataFrame:
        return self._get("groups", lambda: java_groups(self._files, self.parts))

    @property
    def types(self) -> DataFrame:
        return self._get("types", lambda: extract_types(java_members(self.groups)))

    @property
    def classes(self) -> DataFrame:
        return self.types

    @property
    def fields(self) -> DataFrame:
        return self._get("fields", lambda: extract_fields(java_members(self.groups), self.types, self.texts))

    @property
    def methods(self) -> DataFrame:
        return self._get("methods", lambda: extract_methods(java_members(self.groups), self.types))

    @property
    def bodies(self) -> DataFrame:
        return masked_bodies(self._get("bodies", lambda: method_bodies(self.methods, self.texts)))

    @property
    def locals(self) -> DataFrame:
        return self._get("locals", lambda: extract_locals(self.bodies))

    @property
    def var_maps(self) -> tuple[DataFrame, DataFrame]:
        """``var_maps`` of the methods and of the classes, written once."""
        if "method_vars" not in self._t:
            of_methods, of_classes = var_maps(self.methods, self.locals, self.fields, self.types)
            self.memo("method_vars", lambda: of_methods)
            self.memo("class_vars", lambda: of_classes)
        return self._t["method_vars"], self._t["class_vars"]

    @property
    def raw_calls(self) -> DataFrame:
        return self._get("raw_calls", lambda: extract_calls(self.groups, self.methods))

    @property
    def calls(self) -> DataFrame:
        def build():
            q = qualify_calls(self.raw_calls, self.methods, self.fields, self.locals, self.types)
            return with_arg_types(q, *self.var_maps)
        return self._get("calls", build)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)


def java_facts(files: DataFrame) -> JavaFacts:
    """All fact tables of a file table (lazily built)."""
    return JavaFacts(files)
