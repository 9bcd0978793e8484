"""The suffix tree rests on all counts, at any size, and may come in parts."""

import numpy as np

from srcframe.llm import suffixtree


def counted(spark, extra):
    """A passage seen 40 times, beside ``extra`` other symbols."""
    spell = lambda t: [(1, int.from_bytes(t[i - 5:i][::-1] + t[i:i + 1], "big"), 40) for i in range(5, len(t))]
    rows = spell(b"the quick brown fox jumps") + [(1, int.from_bytes(b"aaaaaa", "big"), extra)]
    return spark.createDataFrame(rows, "kind byte, key long, n long")


def test_passages_are_learnt_at_any_size(spark):
    key = np.array([int.from_bytes(b"kciuq"  b" ", "big")], np.uint64)
    small = suffixtree.fit(counted(spark, 10**3))
    large = suffixtree.fit(counted(spark, 10**10))
    assert small.log_probabilities(key)[0] > np.log(0.5) and large.log_probabilities(key)[0] > np.log(0.5)


def test_parts_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(3)
    some = ["quick brown fox", "lazy dog sleeps", "every jump counts", "green grass grows"]
    rows = [(i, " ".join(some[x] for x in r.integers(0, 4, 100))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def scores():
        return {x.doc_id: (x.score, x.base_score, x.n_known) for x in suffixtree.language_model_scores(docs).collect()}

    whole = scores()
    parts = suffixtree.fit(suffixtree.counts(docs), part=10)
    assert len(parts.borders) > 2
    fit = suffixtree.fit
    monkeypatch.setattr(suffixtree, "fit", lambda c: fit(c, part=10))
    cut = scores()
    assert set(cut) == set(whole) and all(np.allclose(cut[i], whole[i], rtol=1e-9) for i in whole)
