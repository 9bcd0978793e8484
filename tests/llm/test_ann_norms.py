"""Nearest neighbours of vectors with very different norms."""

import numpy as np
from pyspark.sql import functions as F

from srcframe.llm import ann


def test_recall_with_heavy_tailed_norms(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(1200, 64))
    v *= (np.exp(r.normal(0, 0.5, 1200)) / np.linalg.norm(v, axis=1))[:, None]
    v[7] *= 100 / np.linalg.norm(v[7])
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(t, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = []
    for q in range(0, 1200, 20):
        score = v @ v[q]
        score[q] = -np.inf
        assert len(got[q]) == 20
        hits.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_ties_and_few_candidates(spark):
    rows = [(i, [1.0, float(i), -1.0]) for i in range(100, 0, -1)] + [(0, [1.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(t, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [1, 2, 3, 4, 5] and all(x.score == 1.0 for x in got)
    opposite = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [-2.0, 0.1])], t.schema)
    assert [x.vec_id for x in ann.nearest(opposite, F.col("vec_id") == 0, k=5).orderBy("rank").collect()] == [1, 2]
