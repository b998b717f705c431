"""Affinity propagation on edges against the dense form."""

import numpy as np
import pytest

from ctxrec.operators import affinity as A
from ctxrec.session import ship_package

SCHEMA = "g string, key long, features array<double>"


def dense(s, rounds, damping):
    """r and a of the full matrix by the textbook updates."""
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        new = np.empty((n, n))
        for i in range(n):
            for k in range(n):
                others = [a[i, j] + s[i, j] for j in range(n) if j != k]
                new[i, k] = s[i, k] - max(others) if others else 1.0
        r = damping * r + (1 - damping) * new
        pos = np.maximum(r, 0)
        new = np.empty((n, n))
        for i in range(n):
            for k in range(n):
                t = sum(pos[j, k] for j in range(n) if j not in (i, k))
                new[i, k] = t if i == k else min(0.0, r[k, k] + t)
        a = damping * a + (1 - damping) * new
    return r, a


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    rows, key = [], 0
    for g, centers in (("a", 3), ("b", 2)):
        for c in rng.normal(size=(centers, 2)) * 8:
            for _ in range(6):
                rows.append((g, key, [float(v) for v in c + rng.normal(size=2) * 0.5]))
                key += 1
    return [*rows, ("alone", key, [1.0, 2.0])]


def test_equals_the_dense_form_when_every_point_is_a_neighbour(spark, points):
    ship_package(spark)
    df = spark.createDataFrame(points, SCHEMA)
    edges = A.similarity_edges(df, "g", "key", neighbours=100).collect()
    got = {(r.i, r.k): (r.r, r.a) for r in A.pass_messages(A.similarity_edges(df, "g", "key", neighbours=100), 12).collect()}
    for g in ("a", "b"):
        ids = [str(k) for gg, k, _ in points if gg == g]
        s = np.zeros((len(ids), len(ids)))
        for e in edges:
            if e.g == g:
                s[ids.index(e.i), ids.index(e.k)] = e.s
        x = np.array([f for gg, _, f in points if gg == g])
        off = ~np.eye(len(ids), dtype=bool)
        assert np.allclose(s[off], -((x[:, None] - x[None]) ** 2).sum(-1)[off], atol=1e-6)
        below = np.sort(s[off])
        assert below[(len(below) - 1) // 2 - 1] <= s[0, 0] <= below[len(below) // 2 + 1]  # the median
        r, a = dense(s, 12, A.DAMPING)
        for i, one in enumerate(ids):
            for k, other in enumerate(ids):
                assert np.allclose(got[one, other], (r[i, k], a[i, k]), atol=1e-9)


def test_clusters(spark, points):
    df = spark.createDataFrame(points, SCHEMA)
    for neighbours in (100, 7):  # also with few neighbours
        got = {r.key: r.exemplar for r in A.affinity_propagation(df, "g", "key", neighbours=neighbours, preference=-20.0).collect()}
        assert len(got) == len(points)
        for lo in range(0, 30, 6):  # six points around each center
            assert len({got[k] for k in range(lo, lo + 6)}) == 1
        assert len(set(got.values())) == 6 and got[30] == "30"
        x = {k: np.array(f) for _, k, f in points}
        for g, k, _ in points:
            heads = {int(got[o]) for gg, o, _ in points if gg == g}
            assert int(got[k]) == min(heads, key=lambda h: ((x[k] - x[h]) ** 2).sum())


def test_empty_and_equal_points(spark):
    df = spark.createDataFrame([("a", i, [1.0, 1.0]) for i in range(5)], SCHEMA)
    got = A.affinity_propagation(df, "g", "key", rounds=5).collect()
    assert len(got) == 5 and len({r.exemplar for r in got}) == 1
    assert A.affinity_propagation(df.where("false"), "g", "key", rounds=2).count() == 0


@pytest.mark.parametrize("cells", [50, 1 << 20])
def test_all_points_are_candidates(spark, monkeypatch, cells):
    """A group of more points than any number of neighbours, in one block or many."""
    monkeypatch.setattr(A, "CELLS", cells)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2)) * 3
    df = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("b", 60, [0.0, 0.0])], SCHEMA)
    s = -np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9) ** 2
    off = np.sort(s[~np.eye(60, dtype=bool)])
    np.fill_diagonal(s, off[(len(off) + 1) // 2 - 1])
    r, a = dense(s, 9, A.DAMPING)
    got = {r.id: r.e for r in A.dense_scores(df, "g", "key", rounds=9).collect()}
    assert np.allclose([got[str(i)] for i in range(60)], np.diag(r + a), atol=1e-8)
    heads = np.flatnonzero(np.round(np.diag(r + a), 9) > 0)
    heads = heads if len(heads) else [np.argmax(np.diag(r + a))]
    out = {r.key: r.exemplar for r in A.affinity_propagation(df, "g", "key", rounds=9).collect()}
    assert [out[i] for i in range(60)] == [str(heads[np.argmax(s[i, heads] * (heads != i))]) for i in range(60)] and out[60] == "60"
