import random

import numpy as np
import pytest

from ctxrec.llm.words import WordBatch, chunks, shingle_sets

TEXTS = ["", None, "a b c", "A b  C\n\td e f", "é 🎉 x\x0by", " lead and trail ", "x" * 3000, "\x1c one\x85two\xa0three"]


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


@pytest.mark.parametrize("lower", [False, True])
def test_bounds_and_hashes(lower):
    w = WordBatch(TEXTS, lower)
    want = [x for t in TEXTS for x in words(t, lower)]
    got = [bytes(w.bytes[s:e]) for s, e in zip(w.start, w.end)]
    assert got == want
    assert w.count.tolist() == [len(words(t)) for t in TEXTS]
    by_hash = {}
    for x, h in zip(want, w.hash.tolist()):
        assert by_hash.setdefault(x, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_shingle_sets_against_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + TEXTS
    brute = []
    for t in texts:
        w = words(t, True)
        brute.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    got = list(shingle_sets(texts))
    assert [len(g) for g in got] == [len(b) for b in brute]
    for i in range(0, 200, 3):
        for j in range(i, 200, 7):
            assert len(np.intersect1d(got[i], got[j])) == len(brute[i] & brute[j])


def test_chunks_cover_all_rows():
    texts = ["x" * n for n in (10, 5000, 3, 900, 900, 900)] + [None]
    parts = list(chunks(texts, 1000))
    assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(texts)))
