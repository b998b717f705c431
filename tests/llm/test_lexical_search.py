import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ctxrec.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank, id, score) by the plain formula."""
    held = [(i, split(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                    for t in split(text) if t in df)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, e[3], -e[0]) for r, e in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 120)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)] + [(25, docs[7][1])]
    return docs, items


def test_equals_brute_force(spark, make_docs, corpus):
    docs, items = corpus
    found = L.rank_documents(make_docs(docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(found) == brute(docs, items)


def test_blocks_of_queries_and_small_buckets_change_nothing(spark, make_docs, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(L, "BUCKET", 16)
    found = L.rank_documents(make_docs(docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"),
                             block_chars=700, head_share=0.2)
    assert ranked(found) == brute(docs, items)


def test_edges(spark, make_docs, edge_rows):
    items = [(1, "ONE two two"), (2, None), (3, " \n!"), (4, "alpha1 x ß"), (4, "alpha1 x ß"), (None, "id tail 2485"), (5, "absent")]
    asked = spark.createDataFrame([(i, t, "s", 1) for i, t in items], "item_id long, text string, score string, row int")
    docs = make_docs(edge_rows)
    want = brute(edge_rows, items)
    assert ranked(L.rank_documents(docs, asked)) == want
    assert {r[0] for r in want} == {1, 4, None}
    assert L.rank_documents(docs.where("false"), asked).count() == 0
    assert L.rank_documents(docs, asked.where("false")).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in L.rank_documents(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_terms_of_long_texts(monkeypatch):
    text = "aB9 é_x" * 500 + " end"
    monkeypatch.setattr(L, "STRETCH", 10)
    assert [t.decode() for some in L.terms(text) for t in some] == split(text)


def test_bounds_never_lose_a_row():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 12, 200)
    term = np.concatenate([np.sort(rng.choice(np.arange(1, 40), s, replace=False)) for s in size])
    x = rng.integers(1, 10**6, len(term))
    norm = np.sqrt(np.bincount(np.repeat(np.arange(200), size), weights=x.astype(float) ** 2))
    b = L.Bucket(norm, size, term, x)
    for _ in range(50):
        q = L.Query.of(0, {int(t): int(w) for t, w in zip(rng.choice(np.arange(1, 40), 9, replace=False), rng.integers(0, 9000, 9))})
        weight = np.zeros(41, dtype=np.int64)
        weight[q.term] = q.q
        score = b.scores(np.arange(200), weight)
        assert score.tolist() == [sum(int(weight[t]) * int(v) for t, v in zip(term[b.first[i]:b.first[i + 1]], x[b.first[i]:b.first[i + 1]]))
                                  for i in range(200)]
        for threshold in (0, int(np.median(score)), int(score.max())):
            kept = set(b.survivors(q, threshold).tolist())
            assert set(np.flatnonzero(score >= max(threshold, 1)).tolist()) <= kept
        assert len(b.survivors(q, int(score.max()))) < 200  # something is pruned
