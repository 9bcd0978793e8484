"""The Merkle manifest against a recursive version."""

import hashlib
import zlib

from helpers_llm import words

from srcframe.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(nodes):
    """(root, siblings of every node to the left and right, level by level)"""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k:k + 3] for k in range(0, len(nodes), 3)]
    root, above = tree([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1:])), *above[n]] for n, r in enumerate(runs) for k in range(len(r))]


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree([leaf_of(r) for r in by[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for r, steps in zip(by[s], trees[s][1]):
            steps = steps + above[n]
            t = r[4]
            if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            h = leaf_of((*r[:4], t))
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[0], leaf_of(r), trees[s][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return out


def check(spark, rows, levels):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = [tuple(r) for r in merkle.manifest(df, levels).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_trees_of_all_sizes(spark):
    """Sources of 1 to 41 rows, some of them with a last run of one; windows of 9
    leaves, so that paths are joined over several tables."""
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 41]
    rows, k = [], 0
    for n, s in enumerate([None, "", "b", "a", "é", "Z", "z", "=", "aa"]):
        for _ in range(sizes[n]):
            text = words(5, k) + ("\nx" if k % 3 else "")
            rows.append((k * 7 % 1000, s, "en", len(text), text))
            k += 1
    check(spark, rows, 2)


def test_one_source_and_one_row(spark):
    check(spark, [(k, "s", None, 3, "a\nb") for k in range(13)], 1)
    check(spark, [(5, None, None, None, None)], 2)


def test_rules(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in merkle.manifest(odd).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert merkle.manifest(none).count() == 0
