"""The ``opN_`` queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcframe.llm import (alignment, ann, fingerprint, langid, merkle, mixing, neardup, ngramjoin, packing, quality,
                          suffixtree, toxicity, warc)
from srcframe.session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEARDUP_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end s from words),
sizes as (select doc_id, len(s) n from sets),
posts as (select doc_id, unnest(s) g from sets),
meet as (select a.doc_id x, b.doc_id y, count(*) c from posts a join posts b on a.g = b.g and a.doc_id < b.doc_id
  group by all),
links as (select x, y from meet join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= 80 * (p.n + q.n - c)),
sym as (select x, y from links union all select y, x from links),
reach as (select doc_id a, doc_id b from documents union select r.a, s.y from reach r join sym s on r.b = s.x)
select z.doc_id, z.n as n_shingles, m.c as component_id, z.doc_id = m.c as kept
from sizes z join (select a, min(b) c from reach group by a) m on m.a = z.doc_id
"""


@query("op6_neardup", NEARDUP_SQL)
def op6(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return suffixtree.language_model_scores(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


@query("op7_quality")
def op7(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_packing")
def op9(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d, octet_length(encode(coalesce(html, ''))) n
  from pages),
k as (select d, max(page_id) m from p where n >= 1000 group by d having count(*) > 1)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when m is null or m = page_id then 'response' else 'revisit' end as record_type,
  case when m <> page_id then m end as refers_to
from p left join k on k.d = p.d
"""


@query("op5_warc", WARC_SQL)
def op5(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("bundles")
    scratch.save(warc.write_bundles(warc.decide(table(spark, sf_dir, "pages")), folder), "index")
    return warc.read_bundles(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                   "refers_to")


@query("op4_fingerprint")
def op4(spark, sf_dir):
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op10_langid")
def op10(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op8_mixing", mixing.oracle())
def op8(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op2_ann")
def op2(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op11_merkle", merkle.SQL)
def op11(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


NGRAM_SQL = (NEARDUP_SQL.replace("len(w) < 4", "len(w) < 5").replace("len(w) - 2", "len(w) - 3")
             .replace("w[i:i + 3]", "w[i:i + 4]").replace(", z.doc_id = m.c as kept", ""))


@query("op12_ngram_join", NGRAM_SQL)
def op12(spark, sf_dir):
    return ngramjoin.linked_documents(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13(spark, sf_dir):
    import public_tokenizers
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
