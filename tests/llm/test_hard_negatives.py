import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxrec.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v string"


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    held = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
            if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in held), key=lambda n: (sum(len(v) == n for _, v, _ in held), n), default=0)
    held = [r for r in held if len(r[1]) == dim]
    out = []
    for i, v, c in held:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in held if j != i)
        for s, j, _ in [e for e in scored if e[2] == c][:positives]:
            fit = [(-n, m) for n, m, d in scored if d != c and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, j, r + 1, m, -s, n) for r, (n, m) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, v, c, 0.0, "v") for i, v, c in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, H.mine(df, F.col("id") % every == 0, **kw).collect()))


def clustered(n, dim, seed, classes=6):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((classes, dim)) * 0.15 + rng.standard_normal(dim) * 0.2
    label = rng.integers(0, classes, n)
    return [(i, [float(np.float32(x)) for x in centers[c] + rng.standard_normal(dim) * 0.15], int(c)) for i, c in enumerate(label)]


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_equals_brute_force(spark, dim):
    rows = clustered(400, dim, dim)
    want = brute(rows, 10)
    assert want and found(spark, rows, 10) == want


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    rows = clustered(300, 16, 2)
    monkeypatch.setattr(H, "TILE", 3)
    monkeypatch.setattr(H, "PAIRS", 7)
    assert found(spark, rows, 5, anchor_block=13) == brute(rows, 5)


def test_ties_repeats_and_odd_rows(spark):
    rows = [(i, [1.0, 0.5, -0.25], i % 2) for i in range(40)] + [(100 + i, [0.8, 0.4, 0.0], 1) for i in range(30)]
    rows += [(200, None, 1), (201, [1.0, None, 2.0], 0), (202, [1.0, float("nan"), 0.0], 0), (203, [float("inf"), 0.0, 0.0], 1),
             (204, [1.0, 2.0], 1), (205, [], 1), (206, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (210, [0.0, 0.0, 0.0], 0)]
    assert found(spark, rows, 10) == brute(rows, 10)
    twice = [*rows, (10, [1.0, 0.5, -0.25], 0), (11, [1.0, 0.5, -0.25], 1)]  # an anchor and another row repeated
    assert set(found(spark, twice, 10)) == set(brute(twice, 10))


def test_negative_and_zero_scores(spark):
    rows = [(i, [-1.0 if i % 2 else 1.0, 0.001 * i], i % 2) for i in range(12)] + [(50, [0.0, 0.0], 0), (51, [0.0, 0.0], 1), (60, [0.0, 0.0], 5)]
    assert found(spark, rows, 3) == brute(rows, 3)


def test_empty_and_alone(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [(0, [1.0], 1)], 1) == []
    assert found(spark, [(0, None, 1)], 1) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 1)], 50) == []


def test_components_beyond_the_range_take_no_part(spark):
    rows = clustered(60, 4, 5)
    assert found(spark, [*rows, (1000, [3e38, 0.0, 0.0, 0.0], 1)], 5) == brute(rows, 5)


def test_intervals_hold_and_prune(spark):
    rng = np.random.default_rng(1)
    v = np.rint(rng.standard_normal((500, 96)) * 50).astype(np.int64)
    v[0] = 0
    turn = H.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    code, norm, align = H.encode(v, turn)
    rows = H.Rows(np.arange(500), np.zeros(500, dtype=np.int64), v, code, norm, align)
    q = H.Anchors.of(np.arange(40), np.zeros(40, dtype=np.int64), v[:40], turn)
    low, high = q.interval(np.arange(40), rows)
    exact = v[:40] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert ((high - low) < 1.6 * np.outer(norm[:40], norm) + 1e-6).all()
    assert (high < 0.9 * (norm[:40, None] ** 2)).mean() > 0.8  # near copies are told from the rest by codes alone
