"""Nearest neighbours by pruned cells against all pairs."""

import numpy as np
import pandas as pd
import pytest

from ctxrec.operators import similarity as S
from ctxrec.session import checkpoint_dir


def clustered(n, dim=6, clusters=8, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim)) * 10
    x = centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread
    return [(f"p{i}", f"o{i % 7}", [float(v) for v in r]) for i, r in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, owner string, features array<double>")


def brute(rows, k, others=None, exclude_self=True, exclude_same_owner=False, metric="euclidean"):
    others = others or rows
    out = []
    with np.errstate(all="ignore"):
        d = np.round(S._block_dist(np.array([r[2] for r in rows]), np.array([r[2] for r in others]), metric), 9)
    for i, a in enumerate(rows):
        near = sorted((d[i, j], b[0]) for j, b in enumerate(others) if np.isfinite(d[i, j])
                      and not (exclude_self and a[0] == b[0]) and not (exclude_same_owner and a[1] == b[1]))
        out += [(a[0], b, float(x), r + 1) for r, (x, b) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r.id_a, r.id_b, r.distance, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "pearson"])
@pytest.mark.parametrize("excl", [{}, {"exclude_self": False}, {"exclude_same_owner": True}])
def test_equals_all_pairs(spark, metric, excl):
    rows = clustered(500) + [("same1", "o1", [1.0] * 6), ("same2", "o2", [1.0] * 6), ("tie", "o3", [2.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    got = found(S.nearest(frame(spark, rows), 4, metric=metric, block_size=100, **excl))
    want = brute(rows, 4, metric=metric, **excl)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


def test_points_without_structure(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", "o", [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(300, 24)))]
    assert found(S.nearest(frame(spark, rows), 3, block_size=64)) == brute(rows, 3)


def test_other_points_few_and_none(spark):
    rows, others = clustered(200), clustered(90, seed=2)[:3]
    pts, few = frame(spark, rows), frame(spark, others)
    assert found(S.nearest(pts, 5, exclude_self=False, others=few)) == brute(rows, 5, others, exclude_self=False)
    assert S.nearest(pts, 5, others=few.where("false")).count() == 0
    assert S.nearest(pts.where("false"), 5).count() == 0


def test_clustered_points_travel_to_few_cells(spark):
    checkpoint_dir(spark)
    n = 4000
    pts = S._space(frame(spark, clustered(n, clusters=40)), "euclidean").checkpoint()
    cells = S.build_cells(pts, pts, n, 5, 1, "euclidean", 64)
    _, _, copies = S.cell_blocks(pts, pts, cells, 128)
    assert len(cells.pivots) == 63
    assert n <= copies < 8 * n  # a plain block join would make 31 copies of each point


def test_bounds_keep_every_neighbour(spark):
    checkpoint_dir(spark)
    rows = clustered(600, clusters=5, spread=2.0)
    pts = S._space(frame(spark, rows), "manhattan").checkpoint()
    cells = S.build_cells(pts, pts, 600, 3, 1, "manhattan", 32)
    t = cells.distances(pd.DataFrame({"space": [np.array(r[2]) for r in rows]}))
    cell, touched = t.argmin(axis=1), cells.touched(t)
    at = {r[0]: i for i, r in enumerate(rows)}
    for a, b, _, _ in brute(rows, 3, metric="manhattan"):
        assert touched[at[b], cell[at[a]]]


def test_points_without_structure_travel_once_a_block(spark):
    checkpoint_dir(spark)
    rng = np.random.default_rng(6)
    n = 4000
    pts = S._space(frame(spark, [(f"p{i}", "o", [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(n, 24)))]), "euclidean").checkpoint()
    cells = S.build_cells(pts, pts, n, 5, 1, "euclidean", 64)
    _, _, copies = S.cell_blocks(pts, pts, cells, 1000)
    assert len(cells.pivots) == 63 and copies <= 8 * n  # one copy a cell before: up to 63 of each


def test_bounded_pairs_equal_measured_ones():
    """The matrix product only picks pairs: far from the origin, with ties and copies."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 5)), 2) + 1e4
    x[50:90] = x[0]
    out = np.zeros((400, 400), dtype=bool)
    np.fill_diagonal(out, True)
    a, b, d = S._excluded_knn(x, x, 6, "euclidean", lambda rows: out[rows])
    want = np.round(S._block_dist(x, x, "euclidean"), 9)
    want[out] = np.inf
    near = np.argsort(want, axis=1, kind="stable")[:, :6]
    assert (b.reshape(400, 6) == near).all() and (d.reshape(400, 6) == np.take_along_axis(want, near, axis=1)).all()


@pytest.mark.parametrize("within,own", [(True, False), (False, False), (False, True)])
def test_all_pairs_leaves_no_partner_out(spark, within, own):
    """Every partner, beyond any number of nearest ones, in several blocks."""
    rng = np.random.default_rng(8)
    rows = [(f"p{i:02d}", f"o{i % 3}", [float(v) for v in r]) for i, r in enumerate(np.round(rng.normal(size=(50, 3)), 1))]
    got = S.all_pairs(frame(spark, rows), exclude_same_owner=own, within=within, pairs=60).collect()
    want = []
    for a, oa, x in rows:
        near = sorted((float(np.round(np.sqrt(((np.array(x) - y) ** 2).sum()), 9)), b) for b, ob, y in rows
                      if a != b and (ob == oa or not within) and (ob != oa or not own))
        want += [(a, b, d, r) for r, (d, b) in enumerate(near, 1)]
    assert sorted((r.id_a, r.id_b, r.distance, r["rank"]) for r in got) == sorted(want)


def test_all_pairs_of_no_points(spark):
    assert S.all_pairs(frame(spark, [("a", "o", [1.0])]).where("false")).count() == 0
    assert S.all_pairs(frame(spark, [("a", "o", [1.0])])).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "pearson"])
@pytest.mark.parametrize("far", [0.0, 3e3])
def test_single_precision_only_picks_pairs(monkeypatch, metric, far):
    """Several blocks of columns, ties, copies and points that single precision cannot tell apart."""
    monkeypatch.setattr(S, "SINGLE", (16, 64))
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(500, 6)), 2) + far
    x[100:160] = x[3]
    x[200:400] = x[7] + rng.normal(size=(200, 6)) * 1e-6
    out = rng.random((500, 500)) < 0.1
    a, b, d = S._excluded_knn(x, x, 5, metric, lambda rows: out[rows])
    one = S._bounded_knn(x, x, 5, metric, lambda rows: out[rows])
    assert all((p == q).all() for p, q in zip((a, b, d), one))
    picked = [i is not None for *_, i, _ in S._candidates(x, x, 5, metric, lambda rows: np.nonzero(out[rows].T)[::-1])]
    assert any(picked)


def test_bounds_of_pivots_hold():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 5)) + 100
    x[50:60] = x[0]
    cells = S.Cells(np.concatenate((x[:20], x[:1])), "euclidean")
    low, high, own = cells.bounds(pd.DataFrame({"space": list(x)}))
    t = cells.distances(pd.DataFrame({"space": list(x)}))
    assert (low <= t).all() and (t <= high).all() and (own == t.argmin(axis=1)).all()
    assert (high - low).max() < 1e-3


def test_points_of_one_vector_are_searched_for_once(spark, monkeypatch):
    """Many points of few vectors: few pairs meet, and the answers are those of all pairs."""
    rng = np.random.default_rng(11)
    kinds = np.round(rng.normal(size=(12, 4)), 1)
    rows = [(f"p{i:03d}", f"o{i // 4}", [float(v) for v in kinds[rng.integers(12)]]) for i in range(400)]
    seen = []
    searched = S._nearest
    monkeypatch.setattr(S, "_nearest", lambda left, right, *a: seen.append((left.count(), right.count())) or searched(left, right, *a))
    got = S.nearest(frame(spark, rows), 3, exclude_same_owner=True)
    assert seen == [(12, 12 * (3 + 1 + 4))]
    assert sorted((r.id_a, r.id_b, r.distance, r["rank"]) for r in got.collect()) == sorted(brute(rows, 3, exclude_same_owner=True))
