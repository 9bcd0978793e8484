"""Merkle manifest of a table: one leaf a row, a tree a source, a tree of the sources.

A leaf is the hash of the row's columns, each as its length in bytes, ``:`` and its
value.  Within a source leaves ascend by ``doc_id``; every ``FAN`` consecutive nodes
have their hash as parent until one node remains, the source's subroot; subroots in
the order of their sources make the tree above in the same way.

The tree is climbed by windows.  All leaves stay as rows; a node lives on the row of
its first leaf.  At level j lag and lead columns at the fixed offsets FAN^j and
2 FAN^j read the neighbours, masked by the node's slot in its run and by the length
of the run; they are the siblings in every proof of the rows below, and on the row
of the run's first child they are hashed with its own node to the parent.  A window
holds ``FAN ** LEVELS`` leaves of one source at most, whose tops are the rows of the
next, smaller table; its paths are joined back by window.  So no task holds a whole
source, and no row travels but by its hash.

Positions come from a range placement: rows are numbered in their partition, and a
table of (source, partition) counts supplies the offset.

Rules: a null column is ``-`` in a leaf.  Null doc_ids come first, rows with equal
ids in the order of their leaf hashes; repeated rows are leaves each.  The null
source is a source, before all others.  Extra columns are not read.  Tampering of a
row without doc_id does nothing.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcframe.session import Scratch

FAN = 3
LEVELS = 6
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

Base = Callable[[DataFrame], DataFrame]


def digest(x: Column) -> Column:
    """Bare lower-case hex SHA-256 of text."""
    return F.sha2(x.cast("binary"), 256)


def field(x: Column) -> Column:
    """A column's share of a leaf: byte count, ``:``, value; ``-`` if null."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(columns[c]) for c in COLUMNS]))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, start): ``key`` orders the sources, null first; ``start``
    is the leaf of the row as it is found, text without line feeds where two divides
    the checksum of the id."""
    own = {c: docs[c] for c in COLUMNS}
    tampered = F.coalesce(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    found = F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    changed = tampered & F.contains(docs["text"], F.lit("\n"))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("key"),
        docs["doc_id"].cast("long").alias("doc_id"), leaf(own).alias("leaf"),
        F.when(changed, leaf({**own, "text": found})).alias("start"))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``pos``, their number within ``key`` in the given order (from 0),
    and ``n``, the rows of the key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.save(
        rows.repartitionByRange(parts, "key", *order).sortWithinPartitions("key", *order)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
            .select("key", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                    F.sum("rows").over(whole).alias("n")))
    return placed.join(runs, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes(key, pos, n, node)`` with ``block`` (their window), ``steps`` (siblings
    to the left and right, level by level, as far as the window reaches) and, on the
    first row of a window, ``top`` (its node after all levels)."""
    rows = nodes.withColumn("block", F.expr(f"pos div {FAN ** levels}")).withColumn("top", F.col("node")) \
        .withColumn("steps", F.array().cast("array<struct<l:string,r:string>>"))
    order = Window.partitionBy("key", "block").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for j in range(levels):
        width = FAN ** j
        index = F.expr(f"pos div {width}")
        count = F.expr(f"(n + {width - 1}) div {width}")  # nodes of the source at this level
        slot = index % FAN
        length = F.least(F.lit(FAN), count - (index - slot))
        mine = (F.col("pos") % width == 0) & (count > 1)
        near = {o: (F.lag("top", -o * width) if o < 0 else F.lead("top", o * width)).over(order)
                for o in range(1 - FAN, FAN) if o}
        rows = rows.select("*", *[v.alias(f"near{o}") for o, v in near.items()])
        left = F.concat(*[F.when(slot + o >= 0, F.col(f"near{o}")).otherwise("") for o in near if o < 0])
        right = F.concat(*[F.when(slot + o < length, F.col(f"near{o}")).otherwise("") for o in near if o > 0])
        rows = rows.withColumn("step", F.when(mine, F.struct(left.alias("l"), right.alias("r")))) \
            .drop(*[f"near{o}" for o in near])
        rows = rows.withColumn("step", F.last("step", ignorenulls=True).over(so_far))
        first = mine & (slot == 0)
        rows = rows.withColumn("top", F.when(first, digest(F.concat("top", "step.r"))).when(count <= 1, F.col("top"))) \
            .withColumn("steps", F.when(count > 1, F.array_append("steps", F.col("step"))).otherwise(F.col("steps"))) \
            .drop("step")
    return rows


def paths(nodes: DataFrame, base: Base, scratch: Scratch, name: str, levels: int = LEVELS) -> DataFrame:
    """``nodes(key, pos, n, node, ...)`` with the steps of each from itself to the top
    and what ``base`` adds to the tops of the keys (steps, subroot, root)."""
    size = FAN ** levels
    rows = scratch.save(climb(nodes, levels), name)
    tops = rows.filter(F.col("pos") % size == 0).select(
        "key", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("node"))
    most = tops.agg(F.max("n")).first()[0] or 0
    above = base(tops) if most <= 1 else paths(tops, base, scratch, f"{name}_", levels)
    above = above.select("key", F.col("pos").alias("block"), F.col("steps").alias("more"), "subroot", "root")
    return rows.drop("top").join(above, ["key", "block"]) \
        .withColumn("steps", F.concat("steps", "more")).drop("more", "block")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per
    row of ``docs(doc_id, source, lang, n_chars, text)``."""
    scratch = Scratch(docs.sparkSession, "merkle")

    def root_only(tops: DataFrame) -> DataFrame:
        none = F.array().cast("array<struct<l:string,r:string>>")
        return tops.select("key", "pos", none.alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root"))

    def of_sources(tops: DataFrame) -> DataFrame:
        names = tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "node")
        found = paths(numbered(names, ["name"], scratch, "names"), root_only, scratch, "sources", levels)
        return tops.select("key", "pos", F.col("node").alias("subroot")).join(
            found.select(F.col("name").alias("key"), "steps", "root"), "key")

    hashed = scratch.save(leaves(docs), "hashed")  # the placement reads it twice
    rows = numbered(hashed, ["doc_id", "leaf"], scratch, "leaves").withColumnRenamed("leaf", "node")
    rows = paths(rows, of_sources, scratch, "rows", levels)
    folded = F.aggregate("steps", F.coalesce("start", "node"),
                         lambda h, s: digest(F.concat(s["l"], h, s["r"])))
    proof = digest(F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), ""))
    return rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
with recursive bytes as (
  select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
marked as (
  select d.*, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''),
      lambda c: cast(ascii(c) as bigint))), lambda a, c: xor(a // 256, t[xor(a, c) % 256 + 1])), 4294967295) % 2 = 0,
      false) as cut
  from documents d, bytes),
coded as (
  select doc_id, source, cut, text,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as body,
    case when cut then coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')
      else coalesce(strlen(text) || ':' || text, '-') end as found
  from marked),
leaves as (
  select row_number() over () as k, doc_id, coalesce('=' || source, '') as s, sha256(head || body) as leaf,
    sha256(head || found) as start
  from coded),
placed as (
  select *, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as i,
    count(*) over (partition by s) as n from leaves),
tree as (
  select 0 as level, s, i, n, leaf as h from placed
  union all
  select level + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from tree where n > 1
  group by level, s, i // 3, n),
subroots as (
  select s, h, row_number() over (order by s) - 1 as i, count(*) over () as n from tree where n = 1),
upper as (
  select 0 as level, i, n, h from subroots
  union all
  select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from upper where n > 1
  group by level, i // 3, n),
climb as (
  select 0 as stage, 0 as level, k, s, i, n, '' as proof, start as f from placed
  union all
  (with now as (select * from climb),
  near as (
    select c.k, coalesce(string_agg(t.h, '' order by t.i) filter (where t.i < c.i), '') as l,
      coalesce(string_agg(t.h, '' order by t.i) filter (where t.i > c.i), '') as r
    from now c join (select 0 as stage, level, s, i, h from tree union all select 1, level, '', i, h from upper) t
      on t.stage = c.stage and t.level = c.level and t.s = c.s and t.i // 3 = c.i // 3
    where c.n > 1 group by c.k)
  select c.stage, c.level + 1, c.k, c.s, c.i // 3, (c.n + 2) // 3, proof || l || r, sha256(l || f || r)
  from now c join near on near.k = c.k where c.n > 1
  union all
  select 1, 0, c.k, '', u.i, u.n, proof, f from now c join subroots u on u.s = c.s where c.n = 1 and c.stage = 0))
select p.doc_id, p.leaf, b.h as subroot, r.h as root, sha256(c.proof) as proof_sha256, c.f as folded_root,
  c.f = r.h as verified
from placed p join subroots b on b.s = p.s join climb c on c.k = p.k and c.stage = 1 and c.n = 1
join upper r on r.n = 1
"""
