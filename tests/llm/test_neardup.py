import itertools
import random

from helpers_llm import words

from srcframe.llm import neardup


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_equal_brute_force_with_long_lists(spark, monkeypatch):
    """A chain of ever more edited copies, many copies of one text, and a family
    large enough for the block comparison."""
    r = random.Random(7)
    rows, base = [], words(120, 10).split()
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    w = words(80, 11).split()
    for i in range(90, 110):
        w[r.randrange(len(w))] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, "Same   text\nagain and again and once more") for i in range(110, 125)]
    rows += [(i, words(60, i)) for i in range(125, 150)]
    monkeypatch.setattr(neardup, "SHORT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs, words=4).collect()}
    assert got == brute(rows, 4, 80)


def test_odd_rows(odd):
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    component = {i: c for i, _, c, _ in got}
    assert len(got) == 14 and component[2] == component[3] == 1 and component[8] == 7 and component[10] == 9
    assert component[4] == 4 and component[5] == 5 and component[6] == 6 and component[11] == 11
    assert {i: k for i, _, _, k in got}[2] is False


def test_keep_one(odd, none):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 11, 12, 13] and ids.count(None) == 2
    assert neardup.keep_one(none).count() == 0 and neardup.near_duplicates(none).count() == 0


def test_one_id_with_two_texts_loses_neither(spark):
    rows = [(1, words(40, 1)), (1, words(40, 2)), (2, words(40, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in neardup.keep_one(docs).collect()) == sorted({t for _, t in rows})


def test_match_floor():
    assert neardup.match_floor(40, 0.8) == 18 and neardup.match_floor(10, 1.0) == 10
