"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents, in a fixed pseudorandom order, are one stream of words,
cut into blocks of ``BLOCK`` words.  A source's target is its weighted share of
``FACTOR`` times all words, at most ``CAP`` times its own words; what is above is
shared out again by weight (water-filling: sources sorted by cap over weight, one
row per source).  The target gives the source's number of slots; every slot falls
to an output shard by a hash, so the source counts of a shard are a multinomial
draw given the totals, which stay exact.  Slot j of a source maps through a
pseudorandom permutation of its block numbers (swap-or-not rounds, another one for
every pass), and blocks are joined by number.  A block is thus taken once more or
less often than any other of its source, and never above ``CAP`` times.

A source with a third of all rows is numbered in ``PARTS`` parts: running sums
inside (source, part), then offsets of the parts.  Texts are only counted; no
join moves them, except in ``mixed_documents``, which returns them.

Rules: null or empty text has size 0 and nothing is taken.  The null source is a
source, last in order.  Rows without id count like others; repeated rows are
separate rows.  All sizes 0: targets 0.  Empty table: empty result.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
WEIGHTS = (3, 1, 2)
FACTOR = 1.5
CAP = 2
PARTS = 4096
SHARD_BLOCKS = 4096
CHUNK = 4096
ROUNDS = 10
WORD = r"[^\x20\x09-\x0D]+"
_P = 2147483647  # prime modulus of the small generators


def sizes(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size and ``more`` of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def targets(rows: DataFrame) -> DataFrame:
    """source, number (by code point, null last), source_size, target, blocks,
    slots of every source: a row each."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    one = by_source.select("source", "source_size",
                           F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("number"))
    one = one.withColumn("weight", F.get(weights, (F.col("number") - 1) % len(WEIGHTS)))
    level = F.col("source_size") * float(CAP) / F.col("weight")
    order = Window.orderBy("level", "number")
    one = one.withColumn("level", level)
    one = one.withColumn("all_words", F.sum("source_size").over(Window.partitionBy())) \
        .withColumn("before", F.coalesce(F.sum(F.col("source_size") * CAP).over(order.rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("after", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("share", (F.col("all_words") * FACTOR - F.col("before")) / F.col("after"))
    one = one.withColumn("free", F.max(F.when(F.col("level") > F.col("share"), F.col("share")))
                         .over(Window.partitionBy()))
    target = F.when(F.col("level") <= F.col("share"), F.col("source_size") * float(CAP)) \
        .otherwise(F.col("weight") * F.col("free"))
    one = one.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    slots = F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"),
                    F.col("blocks") * CAP)
    return one.select("source", "number", "source_size", "target", "blocks",
                      F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0)).cast("long").alias("slots"))


def permuted(x, n, number, turn):
    """Pseudorandom permutation of 0..n-1, another for every source and turn."""
    def step(x, r):
        key = ((number * 1000003 + turn * 7919 + r * 104729 + 12345) % _P * 48271) % _P
        other = (key % n - x + n) % n
        top = F.greatest(x, other)
        bit = ((top % _P) * 69621 + key * 16807 % _P) % _P % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)]), x.cast("long"), step)


def slots(sources: DataFrame) -> DataFrame:
    """The mix: number (source), slot, shard, block of every slot."""
    spread = (sources.filter("slots > 0")
              .withColumn("shards", F.ceil(F.sum("slots").over(Window.partitionBy()) / SHARD_BLOCKS))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)
                                                        .cast("long"))))
              .select("number", "blocks", "slots", "shards", "chunk"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = spread.repartition(parts, "number", "chunk").select(
        "number", "blocks", "shards", F.explode(F.sequence(
            F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    return each.select(
        "number", "slot", F.pmod(F.xxhash64(F.lit(11), "number", "slot"), F.col("shards")).alias("shard"),
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("number").cast("long"), turn).alias("block"))


def draws(mix: DataFrame) -> DataFrame:
    """Source counts of every output shard."""
    return mix.groupBy("shard", "number").agg(F.count("*").alias("n"))


def placed(rows: DataFrame, sources: DataFrame, tie: list[str]) -> DataFrame:
    """Rows with their source's columns and ``start``, the words before them in
    their source."""
    part = F.abs(F.coalesce("doc_id", F.lit(-1))) % 1048573 * 7919 % PARTS
    key = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    named = sources.select(key[0].alias("s0"), key[1].alias("s1"), "number", "source_size", "target")
    known = rows.withColumns({"s0": key[0], "s1": key[1], "part": part}).join(named, ["s0", "s1"]).drop("s0", "s1")
    w = Window.partitionBy("number", "part").orderBy("doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy("number", "part").agg(F.sum("size").alias("words"))
    ahead = sums.select("number", "part", F.coalesce(F.sum("words").over(
        Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return (known.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0))).join(ahead, ["number", "part"])
            .withColumn("start", F.col("ahead") + F.col("inside")).drop("inside", "ahead", "part"))


def pieces(located: DataFrame, mix: DataFrame) -> DataFrame:
    """Every row's parts by block: first word, words and how often the mix takes
    them (rows of size 0 keep one empty part)."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), last))
    cut = located.withColumn("block", F.explode_outer(spans))
    lo = F.greatest("start", F.col("block") * BLOCK)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    takes = mix.groupBy("number", "block").agg(F.count("*").alias("takes"))
    takes = takes.hint("merge")  # a row per block taken: its estimate, made before the explode, is far too small
    return cut.withColumn("word", lo - F.col("start")).withColumn("words", F.coalesce(hi - lo, F.lit(0))) \
        .join(takes, ["number", "block"], "left").withColumn("takes", F.coalesce("takes", F.lit(0)))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = sizes(docs)
    sources = targets(rows)
    return (pieces(placed(rows, sources, []), slots(sources))
            .groupBy("number", "start", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.col("words") * F.col("takes")).alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, in all their columns: a row for
    every pass in which it is taken, its text cut to the words taken then (whole
    texts stay as they are; n_chars follows)."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = sizes(docs, key.alias("key"))
    sources = targets(rows)
    parts = pieces(placed(rows, sources, ["key"]), slots(sources)).filter("takes > 0")
    each = parts.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("takes").cast("int"))))
    taken = (each.groupBy("key", "doc_id", "number", "start", "size", "turn")
             .agg(F.array_sort(F.collect_list(F.struct("word", "words"))).alias("cuts"),
                  F.sum("words").alias("total")))
    taken = taken.select(F.col("key").alias("_mix_key"), F.col("doc_id").alias("_mix_id"),
                         F.struct("size", "cuts", "total").alias("_mix"))
    texts = docs.withColumn("_mix_own", key).dropDuplicates(["_mix_own", "doc_id"])
    both = texts.join(taken, (F.col("_mix_own") == F.col("_mix_key")) &
                      F.col("doc_id").cast("long").eqNullSafe(F.col("_mix_id")))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    text = F.when(F.col("_mix.total") == F.col("_mix.size"), F.col("text")).otherwise(F.array_join(F.flatten(F.transform(
        "_mix.cuts", lambda c: F.slice(words, (c["word"] + 1).cast("int"), c["words"].cast("int")))), ""))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle(table: str = "documents") -> str:
    """The same mix as DuckDB SQL."""
    step = (f"case when ((greatest(x, (K % blocks - x + blocks) % blocks) % {_P}) * 69621 + K * 16807 % {_P}) % {_P} % 2 "
            "= 1 then (K % blocks - x + blocks) % blocks else x end").replace(
                "K", f"(((number * 1000003 + turn * 7919 + r * 104729 + 12345) % {_P} * 48271) % {_P})")
    rounds = ", ".join(f"{r}::bigint" for r in range(ROUNDS))
    return f"""
with rows as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
    abs(coalesce(doc_id, -1)) % 1048573 * 7919 % {PARTS} part from {table}),
one as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) number
  from rows group by source),
lev as (select *, [{', '.join(map(str, WEIGHTS))}][(number - 1) % {len(WEIGHTS)} + 1] weight,
  source_size * {float(CAP)}::double / [{', '.join(map(str, WEIGHTS))}][(number - 1) % {len(WEIGHTS)} + 1] level from one),
fil as (select *, (sum(source_size) over () * {FACTOR}::double - coalesce(sum(source_size * {CAP}) over (order by level,
  number rows between unbounded preceding and 1 preceding), 0)::double) / (sum(weight) over (order by level, number
  rows between current row and unbounded following))::double as share from lev),
tar as (select *, case when level <= share then source_size * {float(CAP)}::double else weight * (max(case when
  level > share then share end) over ()) end target, ceil(source_size / {BLOCK}::double)::bigint blocks from fil),
src as (select *, case when source_size > 0 then least(floor(target * blocks / source_size + 0.5)::bigint,
  blocks * {CAP}) else 0 end slots from tar),
slot as (select number, blocks, unnest(range(0, slots)) j from src),
turned as (select number, blocks, j % blocks as j, j // blocks as turn from slot),
mix as (select number, list_reduce([{rounds}], lambda x, r: {step}, j) as block from turned),
takes as (select number, block, count(*) takes from mix group by all),
place as (select r.doc_id, r.size, s.number, s.source_size, s.target, coalesce(sum(r.size) over (partition by s.number
  order by r.part, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from rows r join src s on r.source is not distinct from s.source),
cut as (select *, unnest(case when size > 0 then range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)
  else [-1] end) block from place),
got as (select number, start, doc_id, size, source_size, target, sum(greatest(0, least(start + size, (block + 1) * {BLOCK})
  - greatest(start, block * {BLOCK})) * coalesce(takes, 0))::bigint taken from cut left join takes using (number, block)
  group by all)
select doc_id, size, source_size, target, taken from got
"""
