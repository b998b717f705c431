import random

import numpy as np

from ctxrec.llm import linkage as L
from ctxrec.llm import ngram_join as N
from ctxrec.llm.words import shingle_sets


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


def brute(rows):
    """(n, component id) of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def near_copies(rng, n_base=12):
    """Groups of copies with growing edits, chains, a hot passage, tiny texts."""
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 1000
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    for b in range(n_base):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 9, 14, 30, 80, 200]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
            if rng.random() < 0.3:
                base = w  # a chain
    for _ in range(60):
        rows.append((i, passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 60)))))
        i += 1
    for _ in range(40):
        rows.append((i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))))
        i += 1
    return rows


def test_against_all_pairs(make_docs, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None] + near_copies(random.Random(11))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(make_docs(rows)).collect())
    assert got == sorted(brute(rows))


def test_large_groups_take_several_turns(make_docs, monkeypatch):
    """Blocks of 8 nodes and groups that count as large from 3 on."""
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "SMALL", 2)
    rows = near_copies(random.Random(12), 6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(make_docs(rows)).collect())
    assert got == sorted(brute(rows))


def test_linked_sets_share_a_key_and_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.choice([1, 2, 4, 5, 8, 13, 40, 160, 900]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        add = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        apart = len(a) + len(b) - 2 * both
        x = L._fold([L.sketch(a), L.sketch(b)])
        assert int(np.bitwise_count(x[0] ^ x[1]).sum()) <= apart
        if both and 5 * both >= 4 * (both + apart) and not np.array_equal(a, b):
            assert set(N.band_keys(a).tolist()) & set(N.band_keys(b).tolist())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.label for r in L.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[103] == 100


def test_null_ids_repeats_and_empty(make_docs):
    t = "a b c d e f g h i j"
    rows = [(None, t), (7, t), (7, t), (5, t + " k"), (None, None), (8, ""), (8, ""), (None, "lonely words stand here all alone")]
    out = N.jaccard_components(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out) == sorted(
        [("None", 6, 5), ("7", 6, 5), ("7", 6, 5), ("5", 7, 5), ("None", 0, None), ("8", 0, 8), ("8", 0, 8), ("None", 2, None)])
    kept = N.one_of_each(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted(
        [("5", t + " k"), ("None", "None"), ("8", ""), ("8", ""), ("None", "lonely words stand here all alone")])
    assert N.jaccard_components(make_docs(rows).where("false")).count() == 0
    assert len(list(shingle_sets([None, ""]))) == 2


def test_one_of_each_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a", 1, "r"), (2, text, "b", 2, "r"), (2, text, "b", 2, "r"), (3, "other words than these are here", "c", 3, "r"), (3, None, "d", 4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text_hash string, __i int, row string")
    got = N.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
