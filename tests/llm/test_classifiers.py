"""Toxicity, quality and language: accuracy on held-out rows, odd rows, and the
chain against plain forward-backward."""

import math
import random

import numpy as np
import pytest

from helpers_llm import words
from srcframe.llm import langid, queries, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    field = toxicity.Field(np.zeros(0, np.uint64))
    field.start, field.move = 0.4, np.array([[0.2, -0.5], [0.3, 0.9]])
    sizes = [1, 5, 3, 7]
    emit = r.normal(0, 2, sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    got = field.marginals(emit, first)
    want = []
    for a, n in zip(first, sizes, strict=True):
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            s = field.start * y[0] + sum(emit[a + k] * y[k] for k in range(n)) + sum(
                field.move[y[k], y[k + 1]] for k in range(n - 1))
            total += math.exp(s)
            on += math.exp(s) * np.array(y)
        want += (on / total).tolist()
    assert np.allclose(got, want, atol=1e-9)


def test_chain_is_exact_over_many_blocks():
    r = np.random.default_rng(4)
    a, b, c, d = (r.uniform(0.1, 2, 1000) for _ in range(4))
    x, want = 1.0, []
    for k in range(1000):
        x = (c[k] + d[k] * x) / (a[k] + b[k] * x)
        want.append(x)
    assert np.allclose(toxicity.chain(a, b, c, d, length=16), want)


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()
    rows = got.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op10_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_toxic_spans_are_code_point_offsets(spark):
    r = random.Random(1)
    rows, marks = [], []
    for i in range(200):
        w = ["é" + x for x in words(40, i).split()]
        if i % 2:
            w[r.randrange(40)] = "Nasty!"
        rows.append((i, " ".join(w)))
        marks.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    text = dict(rows)
    for x in toxicity.toxicity(docs, labels).collect():
        assert x.predicted == x.doc_id % 2
        assert [text[x.doc_id][s.begin:s.end] for s in x.spans] == ["Nasty"] * (x.doc_id % 2)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_odd_rows(odd, none, labels, run):
    got = run(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if r.doc_id in (4, 5, 6)]
    assert len(set(empty)) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert run(none, labels).count() == 0
    assert {r.score for r in run(odd, labels.filter("doc_id = -1")).collect()} == {0.0}


@pytest.mark.parametrize("run", [toxicity.accepted, quality.accepted])
def test_filters_keep_columns_and_without_labels_all_rows(odd, none, labels, run):
    kept = run(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert run(odd, labels.filter("doc_id = -1")).count() == odd.count()
    assert run(none, labels).count() == 0


def test_language_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (4, 5, 6, 12)] == ["und"] * 4 and by[4].score == 0
    assert by[1].lang_pred in {"en", "fr", "de"} and 0 < by[1].score <= 1
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).filter(
        "lang is null")).collect()} == {"und"}
