"""Bounded distances give the nearest points that all distances give."""

import numpy as np
import pytest

from ctxrec.operators import similarity as S


@pytest.mark.parametrize("metric", ["manhattan", "pearson", "euclidean"])
@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_bounded_distances_find_the_nearest(metric, scale):
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(400, 16)), 1) * scale
    X[40:60] = X[7]  # ties
    own = np.arange(0, 400, 7)
    at, to, d = S._excluded_knn(X[own], X, 6, metric, lambda rows: own[rows, None] == np.arange(400)[None, :])
    full = np.round(S._block_dist(X[own], X, metric), 9)
    full[np.arange(len(own)), own] = np.inf
    order = np.argsort(full, axis=1, kind="stable")[:, :6]
    assert (at == np.repeat(np.arange(len(own)), 6)).all()
    assert np.allclose(d, np.take_along_axis(full, order, 1).ravel(), rtol=1e-12, atol=2e-9)
    assert scale > 1 or metric == "pearson" or (to == order.ravel()).all()


def test_few_pairs_are_measured(monkeypatch):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(2000, 32))
    X /= np.linalg.norm(X, axis=1)[:, None]
    for metric in ("manhattan", "pearson"):  # both measured every pair
        seen = []
        pairs = S._pairs
        monkeypatch.setattr(S, "_pairs", lambda l, r, m: seen.append(len(l)) or pairs(l, r, m))
        S._excluded_knn(X[:100], X, 5, metric, lambda rows: np.zeros((len(X[:100][rows]), 2000), bool))
        monkeypatch.undo()
        assert 500 <= sum(seen) < 4000
