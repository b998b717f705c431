import math
import random

import numpy as np

from ctxrec.llm import lm_score as M
from ctxrec.llm.words import WordBatch
from ctxrec.sources.tables import read_table

from .conftest import SMALL


def test_gradients_against_differences():
    net = M.Network()
    rng = np.random.default_rng(0)
    ids, around = rng.integers(0, M.WORDS, 40), rng.integers(0, M.WORDS + 1, (40, 4))
    before = net.flat.astype(np.float64).copy()
    loss = lambda flat: -M.Network(flat).run(around, ids, learn=False).sum()
    net.run(around, ids, learn=True)
    moved = net.flat - before
    for i in np.flatnonzero(np.abs(moved) > 0.01)[:: max(1, (np.abs(moved) > 0.01).sum() // 12)]:
        step = np.zeros(len(before))
        step[i] = 1e-2
        slope = loss(before + step) - loss(before - step)
        assert slope * moved[i] < 0  # every step goes downhill


def test_probabilities_sum_to_one():
    net = M.Network()
    around = np.array([[1, 2, 3, M.PAD]])
    total = sum(math.exp(net.run(around, np.array([w]), learn=False)[0]) for w in range(M.WORDS))
    assert abs(total - 1) < 1e-4


def test_contexts_stay_in_their_text():
    w = WordBatch(["a b c", None, "d", "e f"])
    got = M.contexts(w, np.arange(6))
    p = M.PAD
    assert got.tolist() == [[p, p, 1, 2], [p, 0, 2, p], [0, 1, p, p], [p] * 4, [p, p, 5, p], [p, 4, p, p]]


def test_order_matters_and_scores_add_up(spark):
    docs = read_table(spark, SMALL, "documents", "doc_id", "text")
    flat, frequent = M.fit(docs)
    texts = [r.text for r in docs.limit(200).collect()]
    rng = random.Random(1)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    net = M.Network(flat)
    n, own = M.score_texts(net, texts, frequent)
    _, other = M.score_texts(net, mixed, frequent)
    long = n > 30
    assert (own[long] > other[long]).mean() > 0.6
    assert own.sum() > M.score_texts(M.Network(), texts, frequent)[1].sum()  # training helped
    one = [M.score_texts(net, [t], frequent)[1][0] for t in texts[:20]]
    assert np.allclose(one, own[:20], rtol=1e-4)


def test_edges(make_docs, edge_rows):
    rows = M.score_documents(make_docs(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    empty = [r for r in rows if r.n_words == 0]
    assert len(empty) == 4 and all(r.pll == 0 and r.pll_per_word is None for r in empty)
    assert all(r.pll < 0 for r in rows if r.n_words)
    assert M.score_documents(make_docs(edge_rows).where("false")).count() == 0
    assert M.score_documents(make_docs([(1, None), (2, "")])).count() == 2
