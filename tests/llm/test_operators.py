"""Search, scoring, fingerprints, archives, mixing, packing and the pipeline."""

import hashlib
import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers_llm import words
from srcframe.llm import ann, fingerprint, mixing, packing, queries, suffixtree, warc
from srcframe.session import Scratch

SF = "/root/testdata/sf0.001"


# nearest neighbours

def exact(rows, asked, k):
    vec = {i: np.array(v) for i, v in rows}
    out = {}
    for q in asked:
        s = sorted(((-float(vec[q] @ v), i) for i, v in vec.items() if i != q))[:k]
        out[q] = [i for _, i in s]
    return out


def test_ann_recall_and_scores(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    got = queries.QUERIES["op2_ann"](spark, SF).collect()
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 20)
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    vec = dict(rows)
    assert all(abs(r.score - np.dot(np.array(vec[r.query_id]), np.array(vec[r.vec_id]))) < 1e-12 for r in got)


def test_ann_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 8)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=5).tolist(), "x", 1) for i in range(30)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 50.0], "x", 1) for i in range(40)]       # copies, and another norm
    rows += [(200, None, "x", 1), (220, [0.0] * 5, "x", 1), (240, [1.0, None, 0.0, 0.0, 0.0], "x", 1),
             (260, [float("nan")] * 5, "x", 1), (280, [float("inf"), 0.0, 0.0, 0.0, 0.0], "x", 1), (300, [1.0, 2.0], "x", 1),
             (320, [], "x", 1), (None, [1.0] * 5, "x", 1), (0, rows[0][1], "x", 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid string, axis int")
    got = ann.nearest(t, F.col("vec_id") % 20 == 0, k=7).collect()
    good = [(i, v) for i, v, _, _ in rows if i is not None and i < 200]
    want = exact(dict(good).items(), [0, 20, 100, 120], 7)
    assert {r.query_id for r in got} == set(want)
    for q in want:
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == 7 and len(set(mine) & set(want[q])) >= 5
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 120), key=lambda r: r["rank"])] == want[120]
    assert ann.nearest(t.filter("vec_id = -1"), F.lit(True)).count() == 0
    assert ann.nearest(t.filter("vec_id = 0"), F.lit(True)).count() == 0


# language model

def test_lm_base_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op3_lm_scoring"](spark, SF).collect()}
    import re
    toks = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if c.isascii() else c for c in r.text or "")) + ["\n"] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    count: dict = {}
    for i, t in toks.items():
        if not held[i]:
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    assert len(got) == len(docs)
    for i, t in toks.items():
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (
            held[i], len(t), sum(w in count for w in t), n)
        assert abs(g.base_score - base) < 1e-6 * max(1, abs(base)) and g.score < 0


def test_tree_distributions_sum_to_one_and_use_the_longest_state(spark):
    rows = [(i, "abab abab cd " * 20) for i in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tree = suffixtree.fit(suffixtree.counts(docs).cache(), cutoff=1.0)
    r = np.random.default_rng(1)
    for _ in range(30):
        ctx = np.uint64(int.from_bytes(bytes(r.choice(list(b"abcd \n"), suffixtree.DEPTH).astype(np.uint8).tolist()), "big") << 8)
        p = np.exp(tree.log_probabilities(ctx | np.arange(256, dtype=np.uint64)))
        assert abs(p.sum() - 1) < 1e-5
    a = np.uint64(int.from_bytes(b" baba"[::-1][:5], "big") << 8)
    assert len(tree.contexts) and tree.log_probabilities(np.array([a | np.uint64(ord(" "))]))[0] < 0


def test_lm_odd_rows(odd, none):
    got = suffixtree.language_model_scores(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].n_tokens == by[5].n_tokens == by[6].n_tokens == 1 and by[4].score == by[5].score
    assert all(r.held_out for r in got if r.doc_id is None) and by[7].n_tokens == 40_001
    assert suffixtree.language_model_scores(none).count() == 0
    alone = suffixtree.language_model_scores(odd.filter("doc_id is null")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in alone)


# fingerprints

def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_fingerprints_equal_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op4_fingerprint"](spark, SF).collect()}
    assert len(got) == len(docs)
    off = []
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        for other, near in ((e, got[i].near_edited), (n, got[i].near_next)):
            a, b = shingles(t), shingles(other)
            off.append(abs(near - len(a & b) / max(1, len(a | b))))
    assert np.mean(off) < 0.03 and max(off) < 0.25
    by_text: dict = {}
    for i, t in docs:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_fingerprint_estimates_and_merging(spark):
    import pyarrow as pa
    a, b = words(3000, 1, 10**6), words(1000, 2, 10**6)
    both, sa, sb = fingerprint.sketches(pa.array([a + " " + b, a, b]))
    assert abs(fingerprint.size(sa) / 2996 - 1) < 0.3 and fingerprint.containment(sb, both) > 0.8
    assert abs(fingerprint.resemblance(both, sa) - 0.75) < 0.15
    assert (fingerprint.from_text(fingerprint.to_text(sa)) == sa).all()
    parts = spark.createDataFrame([("g", sa.astype(np.int64).tolist()), ("g", sb.astype(np.int64).tolist()), ("h", [])],
                                  "doc_id string, sketch array<long>")
    got = {r.doc_id: r.sketch for r in fingerprint.merged(parts, "doc_id").collect()}
    assert got["g"] == fingerprint.merge(sa, sb).tolist()


def test_fingerprint_odd_rows(odd, none, spark):
    got = fingerprint.compare_with_edits(odd)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].fingerprint == by[5].fingerprint == "" and by[4].near_next == 1.0 and by[7].near_next > 0.9
    assert fingerprint.compare_with_edits(none).count() == 0
    one = fingerprint.compare_with_edits(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


# archives

def test_warc_round_trip_and_random_access(spark):
    same = "x" * 1500
    rows = [(1, "http://a", same, "p"), (2, None, same, "p"), (3, "u\r\nv", "short é", "p"), (4, "u", "short é", "p"),
            (5, "u", None, "p"), (6, "u", "", "p"), (7, "u", same + "é", "p"), (None, "u", same, "p"),
            (8, "u", "y" * 700_000, "p"), (9, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = Scratch(spark, "t").folder("bundles")
    index = warc.write_bundles(warc.decide(pages), folder).collect()
    assert len(index) == len(rows)
    got = {r.page_id: r for r in warc.read_bundles(spark, folder).collect()}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest()
        want = ("revisit", 2) if html == same and i != 2 else ("response", None)
        assert (got[i].record_type, got[i].refers_to) == want
        assert got[i].payload == (data if want[0] == "response" else None)
    files = {r.path.rsplit("/", 1)[1]: bytes(r.content)
             for r in spark.read.format("binaryFile").load(folder).collect()}
    for r in index:  # by record id: only one frame is read
        data = files[r.bundle]
        if r.page_id is not None:
            head, block = warc.parse(warc.read_record(data, r.page_id))
            assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and len(block) == int(head["Content-Length"])
        frame = warc.read_frame(data, warc.seek_table(data), r.frame)
        assert frame[r.offset:r.offset + r.length].startswith(b"WARC/1.1\r\n")
    import zstandard
    for data in files.values():  # a plain reader sees all frames as one stream
        n = sum(p for _, _, p in warc.seek_table(data))
        assert len(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)) == n
    nothing = Scratch(spark, "t").folder("bundles")
    assert warc.write_bundles(warc.decide(pages.filter("page_id = -1")), nothing).count() == 0
    assert warc.read_bundles(spark, nothing).count() == 0


# mixing

def test_mix_meets_targets(spark):
    got = queries.QUERIES["op8_mixing"](spark, SF).collect()
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.target, r.source_size] = by.get((r.target, r.source_size), 0) + r.taken
    for (target, size), taken in by.items():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 2 * mixing.BLOCK
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = queries.QUERIES["op8_mixing"](spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    mix = mixing.slots(mixing.targets(mixing.sizes(docs)))
    assert mixing.draws(mix).agg(F.sum("n")).first()[0] == mix.count()
    assert mix.groupBy("number", "block").count().agg(F.max("count")).first()[0] <= 2


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1001):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"),
                                                  F.lit(1).cast("long")).alias("y"))
        assert sorted(r.y for r in x.collect()) == list(range(n))


def test_mix_odd_rows(odd, none):
    got = mixing.mix_documents(odd)
    assert got.count() == odd.count()
    assert sum(r.size for r in got.collect() if r.doc_id == 7) == 40_000
    assert mixing.mix_documents(none).count() == 0
    texts = mixing.mixed_documents(odd)
    assert texts.columns == odd.columns and texts.filter("n_chars <> length(text)").count() == 0
    count = F.sum(F.regexp_count("text", F.lit(mixing.WORD)))
    assert texts.agg(count).first()[0] == got.agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(none).count() == 0
    empty = odd.filter("doc_id in (4, 5)")
    assert [r.taken for r in mixing.mix_documents(empty).collect()] == [0, 0]


# packing

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, want, size):
    """rows: pieces; want: multiset of (doc_id, ids)."""
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    spans: dict = {}
    for r in rows:
        spans.setdefault((r.doc_id is None, r.doc_id or 0, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    expect: dict = {}
    for i, ids in want:
        expect.setdefault((i is None, i or 0, len(ids)), []).append(ids)
    assert set(spans) == set(expect)
    for key, pieces in spans.items():
        assert sum(n for _, n, _ in pieces) == key[2] * len(expect[key])
        for a, n, crc in pieces:
            assert crc in {zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) for ids in expect[key]}


def encode(tokenizer, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_covers_every_id_with_little_padding(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = queries.QUERIES["op9_packing"](spark, SF).collect()
    more = packing.pack(docs, tokenizer, open_windows=4).collect()
    all_docs = docs.collect()
    want = list(zip([r.doc_id for r in all_docs], encode(tokenizer, [r.text for r in all_docs]), strict=True))
    for got in (rows, more):
        check_pieces(got, want, 4096)
        full = sum(r.length for r in got)
        assert len({r.sequence_id for r in got}) <= full / 4096 + 6


def test_packing_odd_rows(odd, none, tokenizer):
    extra = odd.unionByName(odd.filter("doc_id = 9").withColumn("text", F.lit("<|endoftext|> don't. x\u0085y 12,5 É!")))
    rows = extra.select("doc_id", "text").collect()
    want = list(zip([r.doc_id for r in rows], encode(tokenizer, [r.text for r in rows]), strict=True))
    for size in (4096, 16):
        check_pieces(packing.pack(extra, tokenizer, size=size).collect(), want, size)
    assert packing.pack(none, tokenizer).count() == 0


def test_word_cache_overflow_changes_nothing(tokenizer):
    texts = [words(50, s).encode() for s in range(20)]
    small, large = packing.WordTokens(tokenizer, limit=30), packing.WordTokens(tokenizer)
    for a in range(0, 20, 4):
        assert small.encode(texts[a:a + 4]) == large.encode(texts[a:a + 4])


# pipeline

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name in ("quality", "toxicity", "near_dedup"):
            assert out.exceptAll(docs).count() == 0 and out.count() < docs.count()
        docs = out
    assert docs.count() > 0


def test_pipeline_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start, at in ((odd, "a"), (none, "b")):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == start.columns
            out.write.parquet(f"{tmp_path}/{at}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{at}{k}")
    assert json.dumps(docs.columns) == json.dumps(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                   "offset"])
