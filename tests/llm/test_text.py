import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from srcframe.llm.text import text_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \n\té\x1c€.", max_size=30)), max_size=12)


def split(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_hash_alike_iff_equal_and_keep_their_rows(texts, limit):
    seen, hashes = [], []
    for i, j, w in text_words(pa.array(texts, pa.string()), limit=limit):
        for k in range(j - i):
            own = split(texts[i + k])
            got = w.hash[w.bounds[k]:w.bounds[k + 1]]
            assert len(own) == len(got)
            seen += own
            hashes += got.tolist()
    assert len(set(zip(seen, hashes, strict=True))) == len(set(seen)) == len(set(hashes))


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(2, 4))
def test_shingle_sets_equal_brute_force_sizes(texts, k):
    sizes = [len(s) for _, _, w in text_words(pa.array(texts, pa.string())) for s in w.shingles(k)]
    want = []
    for t in texts:
        w = split(t)
        want.append(len({tuple(w[a:a + k]) for a in range(len(w) - k + 1)}) if len(w) >= k else int(bool(w)))
    assert sizes == want


def test_slices_and_empty_columns():
    a = pa.array(["a b", None, "b"]).slice(1)
    assert [np.diff(w.bounds).tolist() for _, _, w in text_words(a)] == [[0, 1]]
    assert list(text_words(pa.array([], pa.string()))) == []
