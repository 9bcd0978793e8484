"""Call graph and flows (section H).

Inputs are the fact tables ``methods(repo_id, class_fqn, name, params,
ordinal)``, ``calls(repo_id, caller_fqn, ordinal, callee_sig)`` and
``classes(repo_id, class_fqn, kind)``; ``caller_fqn`` is
``class_fqn.method``.  Every join key starts with ``repo_id``.

The ordered depth-first flow (H5) is computed without leaving Spark: the
step at which a depth-first walk with a visited set first reaches a node is
the node's lexicographically smallest simple call path (sequence of call
ordinals) from the entry, and the prefix of such a path is the smallest
path of its own end node.  So the flow is a label-correcting fixpoint — a
frontier join per round, ``min`` per (entry, node) — followed by one sort on
the path array.  Rounds = depth of the depth-first tree.  Lineage is cut
with reliable ``checkpoint()`` into ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from srcframe.operators import walks
from srcframe.operators.numbering import number_within
from srcframe.session import Scratch, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(walks)  # travels with the task: executors need no path to this package

# Prefixes a step can carry, and library packages whose
# unresolved calls count as framework calls.
STEP_PREFIXES = ["UNRESOLVED_CALL: ", "UNRESOLVED_OR_EXTERNAL: ", "FRAMEWORK_CALL (Spring Data): ",
                 "FRAMEWORK_CALL (JDK/Lib): ", "ERROR: "]
PRECLASSIFIED = ["UNRESOLVED_CALL:", "FRAMEWORK_CALL:", "EXTERNAL_LIB:", "ERROR:"]
LIB_PREFIXES = ["java.util.Optional", "java.util.regex", "java.lang.String", "org.slf4j.Logger",
                "java.time.LocalDateTime", "java.util.Objects", "org.springframework.validation",
                "org.springframework.context.support"]
REPO_CALL_PREFIXES = ["save", "find", "delete", "exists", "count"]
ENTRY_KINDS = ["controller", "soap"]


# ----------------------------------------------------------------- scalars

def base_fqn(sig: Column) -> Column:
    """H3 ``base_fqn``: text before the first ``(``."""
    return F.substring_index(sig, "(", 1)


def strip_step_prefix(step: Column) -> Column:
    """Remove the first matching step prefix (an else-if chain)."""
    expr = step
    for p in reversed(STEP_PREFIXES):
        expr = F.when(F.startswith(step, F.lit(p)), F.substr(step, F.lit(len(p) + 1))).otherwise(expr)
    return expr


def is_preclassified(step: Column) -> Column:
    """H7 ``preclassified_leaf``: the step already carries a prefix."""
    c = None
    for p in PRECLASSIFIED:
        x = F.startswith(step, F.lit(p))
        c = x if c is None else (c | x)
    return c


def participant(step: Column) -> Column:
    """H11 ``participant``: prefix and parameters stripped, the part
    before the last dot (the class)."""
    n = F.substring_index(strip_step_prefix(step), "(", 1)
    return F.when(n.contains("."), F.regexp_extract(n, r"^(.*)\.", 1)).otherwise(n)


def call_label(step: Column) -> Column:
    """H12 ``call_label``: method with parameters after the last dot that
    precedes ``(``; the whole text when there is no such dot."""
    lab = strip_step_prefix(step)
    has_parens = lab.contains("(") & lab.contains(")")
    last_dot = F.length(lab) - F.locate(".", F.reverse(lab)) + 1  # 1-based; > len if none
    has_dot = F.locate(".", F.reverse(lab)) > 0
    paren = F.locate("(", lab)
    return (F.when(has_parens & has_dot & (last_dot < paren), F.substr(lab, last_dot + 1))
            .when(has_parens, lab)
            .otherwise(F.substring_index(lab, ".", -1)))


def display_name(class_fqn: Column, name: Column, params: Column) -> Column:
    """``pkg.Class.method(T a, U b)``."""
    return F.concat(class_fqn, F.lit("."), name, F.lit("("),
                    F.array_join(F.coalesce(params, F.array().cast("array<string>")), ", "), F.lit(")"))


# -------------------------------------------------------------- relations

def method_index(methods: DataFrame) -> DataFrame:
    """H1 ``method_index``: base FQN → method; overloads collapse and the
    last declared one wins.  Partial aggregation keeps the shuffle small."""
    m = methods.withColumn("fqn", F.concat_ws(".", "class_fqn", "name"))
    return (m.groupBy("repo_id", "fqn")
            .agg(F.max_by(F.struct("class_fqn", "name", "params", "ordinal"), F.col("ordinal")).alias("m"))
            .select("repo_id", "fqn", "m.class_fqn", "m.name", "m.params",
                    display_name(F.col("m.class_fqn"), F.col("m.name"), F.col("m.params")).alias("display")))


def entry_points(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """H2 ``entry_points``: every method of controller / SOAP classes; the
    walk starts from the method's base FQN, the flow is keyed by display."""
    ent = classes.where(F.lower("kind").isin(*ENTRY_KINDS)).select("repo_id", "class_fqn")
    return (methods.join(ent, ["repo_id", "class_fqn"], "left_semi")
            .select("repo_id", F.concat_ws(".", "class_fqn", "name").alias("entry_fqn"),
                    display_name(F.col("class_fqn"), F.col("name"), F.col("params")).alias("entry")))


def classify_external(unresolved: DataFrame, classes: DataFrame, sig_col: str = "callee_sig") -> DataFrame:
    """H6 ``classify_external``: a repository CRUD call is a Spring Data
    framework call, a call into 8 library packages a JDK/Lib call, else
    unresolved/external.  Adds ``step_class``."""
    b = base_fqn(unprefixed(F.col(sig_col)))
    u = unresolved.withColumn("_cls", F.regexp_extract(b, r"^(.*)\.", 1)) \
        .withColumn("_mth", F.substring_index(b, ".", -1))
    repos = classes.where(F.lower("kind") == "repository").select(
        "repo_id", F.col("class_fqn").alias("_cls"), F.lit(True).alias("_is_repo"))
    j = u.join(repos, ["repo_id", "_cls"], "left")
    crud = None
    for p in REPO_CALL_PREFIXES:
        x = F.startswith(F.col("_mth"), F.lit(p))
        crud = x if crud is None else (crud | x)
    lib = None
    for p in LIB_PREFIXES:
        x = F.startswith(b, F.lit(p))
        lib = x if lib is None else (lib | x)
    cls = (F.when(F.coalesce(F.col("_is_repo"), F.lit(False)) & crud, F.lit("FRAMEWORK_CALL (Spring Data)"))
           .when(lib, F.lit("FRAMEWORK_CALL (JDK/Lib)"))
           .otherwise(F.lit("UNRESOLVED_OR_EXTERNAL")))
    return j.withColumn("step_class", cls).drop("_cls", "_mth", "_is_repo")


def unprefixed(sig: Column) -> Column:
    """K13: a callee already carrying ``UNRESOLVED_CALL: `` keeps one prefix."""
    return F.when(F.startswith(sig, F.lit("UNRESOLVED_CALL: ")), F.substr(sig, F.lit(18))).otherwise(sig)


def resolve_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """H4 ``resolve_calls``: each call → resolved callee FQN, or the step
    ``UNRESOLVED_CALL: <sig>``.  The index is one row per method, so the
    join is many-to-one; Catalyst/AQE broadcast it when small."""
    idx = index.select("repo_id", F.col("fqn").alias("callee_fqn"), F.lit(True).alias("resolved"))
    c = calls.withColumn("callee_fqn", base_fqn(F.col("callee_sig")))
    j = c.join(idx, ["repo_id", "callee_fqn"], "left")
    return j.select(
        "repo_id", "caller_fqn", "ordinal", "callee_sig",
        F.when(F.col("resolved"), F.col("callee_fqn")).alias("callee_fqn"),
        F.when(F.col("resolved").isNull(),
               F.concat(F.lit("UNRESOLVED_CALL: "), unprefixed(F.col("callee_sig")))).alias("step"))


def _cut(df: DataFrame, i: int, every: int) -> DataFrame:
    """Materialise one round.  Every ``every`` rounds the result is written
    with a reliable ``checkpoint()`` (survives executor loss, cuts lineage);
    in between it is persisted, and a lost block is recomputed from the
    short lineage since the last checkpoint."""
    if every and i % every == 0:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist()


def reachable(edges: DataFrame, entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """H9 ``reachable``: (repo_id, entry_fqn, node, depth) — every node
    reached from an entry with its BFS depth, up to ``max_depth`` levels.
    ``edges(repo_id, src, dst)`` must be resolved calls.

    Nodes are numbered; the graph goes, as blocks of numbers, to as many tasks
    as the session runs at once, and each task walks from its share of the
    entries, 64 at a time (``walks.py``).  What is shuffled and written is the
    graph, whatever the number of rows that are reached."""
    scratch, spark = Scratch(edges.sparkSession, "reachable"), edges.sparkSession
    # an edge without repository or source leads nowhere
    e = edges.where(F.col("repo_id").isNotNull() & F.col("src").isNotNull()).select("repo_id", "src", "dst").distinct()
    e = scratch.save(e, "edges")
    start = scratch.save(entries.select("repo_id", F.col("entry_fqn").alias("node")).distinct(), "start")
    named = [start, e.select("repo_id", F.col("src").alias("node")), e.select("repo_id", F.col("dst").alias("node"))]
    nodes = number_within(named[0].unionByName(named[1]).unionByName(named[2]).distinct(), [], ["repo_id", "node"], "_n")
    nodes = scratch.save(nodes.select("repo_id", "node", (F.col("_n") - 1).alias("id")), "nodes")

    number = walks.number_type(nodes.count())

    def numbered(df, name, column):
        n = nodes.select(F.col("repo_id").alias("_repo"), F.col("node").alias("_node"), F.col("id").alias(column)).hint("merge")
        return df.join(n, F.col("repo_id").eqNullSafe(F.col("_repo")) & F.col(name).eqNullSafe(F.col("_node"))).drop(name, "_repo", "_node")
    e = numbered(numbered(e, "src", "a"), "dst", "b").select("a", "b")
    start = numbered(start, "node", "id").select("id")

    def blocks(df, kind, *columns):
        placed = df.select(*columns).repartitionByRange(*columns[:1]).sortWithinPartitions(*columns)
        return placed.mapInArrow(walks.packed(kind, number, *columns), walks.PACKED)
    packed = scratch.save(blocks(e, walks.EDGES, "a", "b").unionByName(blocks(start, walks.ENTRIES, "id"))
                          .unionByName(blocks(nodes, walks.NAMES, "id", "repo_id", "node")), "blocks")
    n = packed.where(F.col("kind") == walks.ENTRIES).agg(F.sum("n")).first()[0] or 0
    groups = max(1, min(spark.sparkContext.defaultParallelism, -(-n // walks.WIDTH)))
    each = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "*")
    return each.repartitionByRange(groups, "g").sortWithinPartitions("g", "kind", "first", "last").mapInArrow(
        walks.walks(groups, number, max_depth), walks.FOUND)


def call_flow(methods: DataFrame, calls: DataFrame, classes: DataFrame,
              entries: DataFrame | None = None, checkpoint_every: int = 4) -> DataFrame:
    """H5 ``call_flow``: per entry point, the depth-first pre-order of
    methods reached through resolved calls (each method once, a visited
    set per entry), with unresolved calls as leaves each time they occur.

    Output: ``call_flows(repo_id, entry, step_no, step, step_key,
    step_class)``; ``step_key`` is the ordinal path that orders the flow.
    """
    idx = method_index(methods).persist()
    res = resolve_calls(calls, idx).persist()
    if entries is None:
        entries = entry_points(methods, classes)
    edges = (res.where(F.col("callee_fqn").isNotNull())
             .groupBy("repo_id", F.col("caller_fqn").alias("src"), F.col("callee_fqn").alias("dst"))
             .agg(F.min("ordinal").cast("int").alias("ord"))).persist()
    # labels: (repo_id, entry, entry_fqn, node, path array<int>, nodes array<string>)
    lab = entries.select("repo_id", "entry", "entry_fqn", F.col("entry_fqn").alias("node"),
                         F.array().cast("array<int>").alias("path"),
                         F.array("entry_fqn").alias("nodes"))
    frontier = lab
    i = 0
    while True:
        i += 1
        cand = (frontier.alias("f").join(edges.alias("e"),
                                         (F.col("f.repo_id") == F.col("e.repo_id")) & (F.col("f.node") == F.col("e.src")))
                .where(~F.array_contains(F.col("f.nodes"), F.col("e.dst")))
                .select(F.col("f.repo_id").alias("repo_id"), "f.entry", "f.entry_fqn",
                        F.col("e.dst").alias("node"),
                        F.concat(F.col("f.path"), F.array(F.col("e.ord"))).alias("path"),
                        F.concat(F.col("f.nodes"), F.array(F.col("e.dst"))).alias("nodes")))
        best = cand.groupBy("repo_id", "entry", "entry_fqn", "node") \
            .agg(F.min(F.struct("path", "nodes")).alias("b")) \
            .select("repo_id", "entry", "entry_fqn", "node", "b.path", "b.nodes")
        # keep only candidates that beat the current label
        cur = lab.select("repo_id", "entry", "entry_fqn", "node", F.col("path").alias("cur_path"))
        improved = best.join(cur, ["repo_id", "entry", "entry_fqn", "node"], "left") \
            .where(F.col("cur_path").isNull() | (F.col("path") < F.col("cur_path"))).drop("cur_path")
        improved = _cut(improved, i, checkpoint_every)
        if improved.isEmpty():
            break
        lab = (lab.join(improved.select("repo_id", "entry", "entry_fqn", "node"),
                        ["repo_id", "entry", "entry_fqn", "node"], "left_anti")
               .unionByName(improved))
        lab = _cut(lab, i, checkpoint_every)
        frontier = improved
    # steps: visited methods, and unresolved calls of visited methods
    disp = idx.select("repo_id", F.col("fqn").alias("node"), "display")
    node_steps = lab.join(disp, ["repo_id", "node"]).select(
        "repo_id", "entry", F.col("path").alias("step_key"), F.col("display").alias("step"),
        F.lit(None).cast("string").alias("callee_sig"))
    leaves = (lab.alias("l").join(res.where(F.col("step").isNotNull()).alias("r"),
                                  (F.col("l.repo_id") == F.col("r.repo_id")) & (F.col("l.node") == F.col("r.caller_fqn")))
              .select(F.col("l.repo_id").alias("repo_id"), "l.entry",
                      F.concat(F.col("l.path"), F.array(F.col("r.ordinal").cast("int"))).alias("step_key"),
                      F.col("r.step").alias("step"), F.col("r.callee_sig").alias("callee_sig")))
    leaves = classify_external(leaves, classes)
    steps = node_steps.withColumn("step_class", F.lit(None).cast("string")).unionByName(leaves).drop("callee_sig")
    w = Window.partitionBy("repo_id", "entry").orderBy("step_key")
    return steps.withColumn("step_no", F.row_number().over(w)).select(
        "repo_id", "entry", "step_no", "step", "step_key", "step_class")


def diagram_title(diagram_type: Column) -> Column:
    """H17 ``diagram_title`` for a diagram type: ``_`` → space, words
    capitalised (``CLASS_DIAGRAM`` → ``Class Diagram``)."""
    return F.initcap(F.lower(F.replace(diagram_type, F.lit("_"), F.lit(" "))))


def sequence_title(entry: Column) -> Column:
    """H17 short title of a sequence diagram: ``SimpleClass.method`` of the
    entry signature, else the method, else the whole text."""
    cm = F.regexp_extract(entry, r"([\w$.]+)\.([^.(]+)\(", 0)
    cls = F.regexp_extract(entry, r"([\w$.]+)\.([^.(]+)\(", 1)
    meth = F.regexp_extract(entry, r"([\w$.]+)\.([^.(]+)\(", 2)
    simple_m = F.regexp_extract(entry, r"\.([^.(]+)\(", 1)
    t = (F.when(cm != "", F.concat(F.substring_index(cls, ".", -1), F.lit("."), meth))
         .when(simple_m != "", simple_m).otherwise(entry))
    return F.concat(F.lit("Sequence: "), t)


def drop_consecutive_duplicates(flows: DataFrame, key: tuple[str, ...] = ("repo_id", "entry")) -> DataFrame:
    """H8: drop a step equal to the step before it, then renumber."""
    w = Window.partitionBy(*key).orderBy("step_no")
    return (flows.withColumn("_prev", F.lag("step").over(w))
            .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("step")))
            .drop("_prev")
            .withColumn("step_no", F.row_number().over(w)))


def lifelines(flows: DataFrame, key: tuple[str, ...] = ("repo_id", "entry")) -> DataFrame:
    """H13 ``lifelines``: distinct participants in order of first
    appearance.  Grouping is per (entry, participant): partial aggregation,
    no per-entry collection."""
    p = flows.withColumn("participant", participant(F.col("step")))
    first = p.groupBy(*key, "participant").agg(F.min("step_no").alias("first_step"))
    w = Window.partitionBy(*key).orderBy("first_step")
    return first.withColumn("lifeline_no", F.row_number().over(w))


def sequence_edges(flows: DataFrame, key: tuple[str, ...] = ("repo_id", "entry")) -> DataFrame:
    """H14 ``sequence_edges``: consecutive step pairs as arrows
    ``from → to : label``, numbered like ``autonumber``."""
    w = Window.partitionBy(*key).orderBy("step_no")
    nxt = flows.withColumn("_next", F.lead("step").over(w))
    return nxt.where(F.col("_next").isNotNull()).select(
        *key, F.col("step_no").alias("arrow_no"),
        participant(F.col("step")).alias("src"), participant(F.col("_next")).alias("dst"),
        call_label(F.col("_next")).alias("label"))


def trace_lines(flows: DataFrame, key: tuple[str, ...] = ("repo_id", "entry")) -> DataFrame:
    """H16 ``trace_text``: one numbered line per step, parameters replaced
    by ``()`` and the unresolved prefix removed.  Lines stay rows (ordered
    by ``step_no``); a writer concatenates them per entry."""
    t = F.regexp_replace(F.col("step"), r"\([^)]*\)", "()")
    t = F.when(F.startswith(t, F.lit("UNRESOLVED_CALL: UNRESOLVED_CALL: ")), F.substr(t, F.lit(35))) \
        .when(F.startswith(t, F.lit("UNRESOLVED_CALL:")), F.regexp_replace(t, "^UNRESOLVED_CALL: ", "")) \
        .otherwise(t)
    t = F.regexp_replace(t, r"\([^)]*\)", "()")
    t = F.regexp_replace(t, r"\.([a-zA-Z0-9_]+)\([^)]*\)", ".$1()")
    return flows.select(*key, "step_no",
                        F.concat(F.col("step_no").cast("string"), F.lit(". "), t).alias("trace_line"))


GENERAL_DIAGRAMS = ["CLASS_DIAGRAM", "ENTITY_RELATIONSHIP_DIAGRAM", "COMPONENT_DIAGRAM", "USECASE_DIAGRAM",
                    "DATABASE_DIAGRAM"]


def flows_with_steps(flows: DataFrame, diagram_types: list[str] | None = None) -> DataFrame:
    """H19 ``flows_with_steps``: one row per call flow (a sequence diagram)
    with its title and step count, plus one row per general diagram type
    not already present.  Step counts are a per-entry aggregate (partial
    aggregation, no collection)."""
    seq = flows.groupBy("repo_id", "entry").agg(F.count(F.lit(1)).alias("n_steps")).select(
        "repo_id", F.col("entry").alias("key"), sequence_title(F.col("entry")).alias("title"), "n_steps",
        F.lit("SEQUENCE").alias("kind"))
    repos = flows.select("repo_id").distinct()
    gen = repos.select("repo_id", F.explode(F.array(*[F.lit(t) for t in (diagram_types or GENERAL_DIAGRAMS)])).alias("key")) \
        .select("repo_id", "key", diagram_title(F.col("key")).alias("title"), F.lit(None).cast("long").alias("n_steps"),
                F.lit("GENERAL").alias("kind"))
    gen = gen.join(seq.select("repo_id", "key"), ["repo_id", "key"], "left_anti")
    return seq.unionByName(gen)


def simplify_type(t: Column) -> Column:
    """Generic arguments ``<a,b>`` → ``<a, b>`` (commas of each first-level
    ``<…>`` span re-joined with ``, ``)."""
    gaps = F.split(t, "<[^>]+>", -1)
    ms = F.transform(F.regexp_extract_all(t, F.lit("<[^>]+>"), 0), lambda m: F.concat(
        F.lit("<"), F.array_join(F.transform(F.split(F.substr(m, F.lit(2), F.length(m) - 2), ",", -1),
                                             lambda p: F.trim(p)), ", "), F.lit(">")))
    return F.array_join(F.zip_with(gaps, F.concat(ms, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")


def parameter_text(p: Column) -> Column:
    """One parameter: type in its simple form, then the name and its array
    marks if it has one."""
    bare = F.regexp_replace(p, r"(\[\])+$", "")
    marks = F.when(F.length(bare) < F.length(p), F.lit("[]")).otherwise(F.lit(""))
    name = F.substring_index(F.regexp_replace(bare, r"\s", " "), " ", -1)
    typ = F.trim(F.left(bare, F.length(bare) - F.length(name)))
    plain = name.rlike(r"^[\w$]+$")
    return (F.when(plain & (typ != ""), F.concat(simplify_type(typ), F.lit(" "), name, marks))
            .when(plain, F.concat(simplify_type(name), marks))
            .otherwise(simplify_type(p)))


def flow_display_name(sig: Column) -> Column:
    """H15 ``flow_display_name``: ``method(simplified params)``;
    ``<init>`` → ``new Class(params)``, ``<clinit>`` → ``Class static
    initializer``; a text that is no signature keeps parentheses as is or
    becomes spaced words (``getUserName`` → ``Get User Name``).

    A signature ends in ``)``; its qualified name is what stands before the
    first ``(``: the method behind the last dot, the class before it."""
    head = F.substring_index(sig, "(", 1)
    method = F.substring_index(head, ".", -1)
    cls = F.left(head, F.greatest(F.length(head) - F.length(method) - 1, F.lit(0)))
    simple_cls = F.substring_index(cls, ".", -1)
    is_sig = sig.contains("(") & sig.endswith(")") & head.rlike(r"^[\w$.<>]+$") & (method != "") & \
        ~F.startswith(head, F.lit("."))
    listed = F.substr(sig, F.length(head) + 2, F.length(sig) - F.length(head) - 2)
    each = F.filter(F.transform(F.split(listed, ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    params = F.concat(F.lit("("), F.array_join(F.transform(each, parameter_text), ", "), F.lit(")"))
    spaced = F.trim(F.regexp_replace(sig, "([A-Z])", " $1"))
    spaced = F.replace(F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2))), F.lit("_"), F.lit(" "))
    named = (F.when(method == "<clinit>", F.trim(F.concat(simple_cls, F.lit(" static initializer"))))
             .when(method == "<init>", F.concat(F.lit("new "), F.coalesce(F.nullif(simple_cls, F.lit("")), F.lit("Object")),
                                                params))
             .otherwise(F.concat(method, params)))
    return F.when(is_sig, named).when(sig.contains("(") & sig.contains(")"), sig) \
        .otherwise(F.coalesce(spaced, F.lit("Unknown Flow")))
