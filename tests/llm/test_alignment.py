"""Cross-tokenizer alignment against a brute-force version on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from helpers_llm import words
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from srcframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own}
    byte.update({chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)})
    found = []
    for i, t in rows:
        pairs, groups = Counter(), []
        x = y = []
        if t:
            e = a.encode(" " + t, add_special_tokens=False)
            x, y = list(zip(e.ids, [bytes(byte[c] for c in s) for s in e.tokens])), []
            for p in b.encode(t, out_type=int):
                s = b.id_to_piece(p)
                y.append((p, bytes([int(s[3:5], 16)]) if b.is_byte(p) else s.replace("▁", " ").encode()))
            whole = (" " + t).encode()
            if b"".join(s for _, s in x) != whole or b"".join(s for _, s in y) != whole:
                x = y = []

        def ends(tokens):
            out, n = [], 0
            for _, s in tokens:
                n += len(s)
                out.append(n)
            return out
        ex, ey = ends(x), ends(y)
        m = n = 0
        for cut in sorted(set(ex) & set(ey)):
            left, right = [p for p, _ in x[m:ex.index(cut, m) + 1]], [p for p, _ in y[n:ey.index(cut, n) + 1]]
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            pairs.update((p, q) for p in left for q in right)
            m, n = m + len(left), n + len(right)
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((i, len(x), len(y), len(groups), pairs, text))
    held = Counter(p for f in found for p in f[4])
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    return [(i, x, y, g, sum(pairs.values()), sum(n for p, n in pairs.items() if held[p] == most[p[0]]),
             sum(n * held[p] for p, n in pairs.items()), text) for i, x, y, g, pairs, text in found]


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [tuple(r) for r in alignment.align(df, A, B).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_odd_texts(spark):
    """Runs of white space, line ends, digits, other scripts, special strings, a
    literal U+2581, no-break spaces, contractions, control characters."""
    texts = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\ny\n\n z", "don't we'll  I'M", "12345 67.8%",
             "été üß naïve", "日本語の文 中文", "\U0001f600\U0001f468‍\U0001f469 ok", "<|endoftext|> a<|endoftext|>b", "<s> </s> <unk> <0x41>",
             "a▁b c", "a b   c", "tab\tand\x0bmore \x1c x", "﻿bom", "é combining", "--- ... !!!??",
             "A" * 300, "ab" * 500 + " " + "xyz" * 200, "أهلا بك", "­ soft", "a 　 b", " x  y", "'s 't"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b"), (None, None), (7, "repeat me"), (7, "repeat me")]
    check(spark, rows)


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2000)
    r = random.Random(5)
    alphabet = ["the", "of", "thnter", " ", "  ", "\n", "1", "99", ".", ",", "'s", "é", "中", "un", "ing", "\t", "-", "A", "▁"[:0]]
    rows = [(k, "".join(r.choice(alphabet) for _ in range(r.randrange(60)))) for k in range(80)]
    rows += [(100 + k, words(60, k % 5)) for k in range(25)]
    check(spark, rows)


def test_rules(spark, odd, none):
    got = [tuple(r) for r in alignment.align(odd, A, B).collect()]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert alignment.align(none, A, B).count() == 0


def test_bounded_memory_of_words():
    aligner = alignment.Aligner(A, B)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(alignment, "KEEP_WORDS", 5)
        import numpy as np
        for k in range(4):
            out = aligner.batch([words(30, k)], np.ones(1, np.int64))
            again = alignment.Aligner(A, B).batch([words(30, k)], np.ones(1, np.int64))
            assert out == again


def test_slices_hold_few_words():
    """A batch is the same whether its texts are taken at once or slice by slice, and
    what a task holds besides the words' table is a slice's, not the batch's."""
    import tracemalloc

    import numpy as np
    texts = [" ".join([words(40, k)] * 100) for k in range(40)]
    peak, made = [], []
    for size in (1 << 40, 1 << 14):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(alignment, "SLICE_BYTES", size)
            aligner = alignment.Aligner(A, B)
            aligner.batch(texts, np.ones(len(texts), np.int64))  # the words are known now
            tracemalloc.start()
            made.append(aligner.batch(texts, np.arange(1, len(texts) + 1)))
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert made[0] == made[1]
    assert peak[1] * 2 < peak[0]


class Counting:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, inner, name):
        self.inner, self.name, self.given = inner, name, []

    def __getattr__(self, name):
        def call(texts, **options):
            self.given += texts
            return getattr(self.inner, name)(texts, **options)
        return call if name == self.name else getattr(self.inner, name)


def counted():
    aligner = alignment.Aligner(A, B)
    aligner.a, aligner.b = Counting(aligner.a, "encode_batch_fast"), Counting(aligner.b, "encode")
    return aligner


def test_words_are_encoded_together():
    """Words go to the tokenizers several at a time, and come out as if each went alone."""
    import numpy as np
    text = " ".join(f"{w}{k}" for k in range(50) for w in ("the", "naïve", "(x.y)", "don't", "中文", "​z"))
    made = []
    for together in (1, 16):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(alignment, "TOGETHER", together)
            aligner = counted()
            aligner.batch([text], np.ones(1, np.int64))
            made.append({w: (aligner.measures[i].tolist(), aligner.groups[i]) for w, i in aligner.number.items()})
    assert made[0] == made[1] and len(made[0]) == 300
    plain = " ".join(f"word{k}" for k in range(320))
    aligner = counted()
    aligner.batch([plain], np.ones(1, np.int64))
    assert len(aligner.a.given) <= 20 and len(aligner.b.given) <= 20


def test_recurring_words_are_kept():
    """When the table is full, words that several slices have are not learned anew."""
    import numpy as np
    with pytest.MonkeyPatch.context() as m:
        m.setattr(alignment, "SLICE_BYTES", 1)
        m.setattr(alignment, "KEEP_WORDS", 40)
        aligner = counted()
        texts = [" ".join(["again", "and", "anew"] + [f"w{k}x{j}" for j in range(15)]) for k in range(12)]
        out = aligner.batch(texts, np.ones(len(texts), np.int64))
        assert sum(" again" in t for t in aligner.a.given) == 1
        assert len(aligner.number) <= 40 + 18
    assert out == alignment.Aligner(A, B).batch(texts, np.ones(len(texts), np.int64))
