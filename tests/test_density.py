"""Mean shift and bandwidth against brute force on a small fixture, and the
whitening invariant of the text model."""

import numpy as np
from pyspark.sql import functions as F

from ctxrec.operators.density import _BlockCells, estimate_bandwidth, estimate_bandwidths, mean_shift, ranked_distances

SF = "/root/testdata/sf0.001"


def _fixture(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("label") < 3)
    return e.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("features"))


def _brute_bandwidth(X, q):
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    m = max(1, int(np.floor(len(X) * q)))
    return np.sort(d, axis=1)[:, m - 1].mean()


def _brute_meanshift(X, bw, max_iter=50, tol=1e-3):
    centers, counts = [], []
    for x in X:
        c = x.copy()
        for _ in range(max_iter):
            within = np.sqrt(((X - c) ** 2).sum(1)) <= bw
            new = X[within].mean(0) if within.any() else c
            n = int(within.sum())
            moved = np.sqrt(((new - c) ** 2).sum())
            c = new
            if moved < tol * bw:
                break
        centers.append(c)
        counts.append(n)
    order = sorted(range(len(centers)), key=lambda i: (-counts[i], tuple(-v for v in centers[i]), i))
    kept = []
    for i in order:
        if all(np.sqrt(((centers[i] - centers[j]) ** 2).sum()) > bw for j in kept):
            kept.append(i)
    K = np.array([centers[i] for i in kept])
    return np.argmin(((X[:, None, :] - K[None, :, :]) ** 2).sum(-1), axis=1), len(kept)


def test_bandwidth_and_meanshift_brute_force(spark):
    pts = _fixture(spark)
    rows = pts.collect()
    bws = {r.label: r.bandwidth for r in estimate_bandwidth(pts, "label", "vec_id", 0.3, block_size=16).collect()}
    assign, centers = mean_shift(pts, "label", "vec_id",
                                 spark.createDataFrame(list(bws.items()), "label string, bandwidth double"),
                                 block_size=16)
    got = {(r.label, r.vec_id): r.cluster for r in assign.collect()}
    for lab in sorted(bws):
        grp = sorted((r for r in rows if str(r.label) == lab), key=lambda r: r.vec_id)
        X = np.array([r.features for r in grp])
        assert abs(_brute_bandwidth(X, 0.3) - bws[lab]) < 1e-9
        labels, n_kept = _brute_meanshift(X, bws[lab])
        ours = np.array([got[(lab, str(r.vec_id))] for r in grp])
        assert n_kept == centers.where(F.col("label") == lab).count()
        # same partition of the points (cluster ids may be numbered alike or not)
        assert len(set(zip(labels, ours))) == len(set(labels)) == len(set(ours))


def test_every_rank_of_every_point(spark):
    """Ties, equal points and groups of one: each asked rank is found for each point."""
    rng = np.random.default_rng(4)
    groups = {"a": np.repeat(rng.normal(size=(9, 3)), 8, axis=0), "b": rng.normal(size=(1, 3)), "c": np.zeros((30, 3)),
              "d": np.round(rng.normal(size=(150, 3)), 1)}
    rows = [(f"{g}{i}", g, [float(v) for v in x], [1, 1 + len(m) // 3, len(m)]) for g, m in groups.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "id string, owner string, features array<double>, ms array<bigint>")
    got = {(r.id, r.m): r.d for r in ranked_distances(df, block_size=20).collect()}
    want = {}
    for g, m in groups.items():
        d = np.sort(np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1)), axis=1)
        want |= {(f"{g}{i}", k): d[i, k - 1] for i in range(len(m)) for k in (1, 1 + len(m) // 3, len(m))}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)


def test_several_quantiles_at_once(spark):
    pts = _fixture(spark)
    both = {(r.label, r.quantile): r.bandwidth for r in estimate_bandwidths(pts, "label", "vec_id", [0.1, 0.5], block_size=16).collect()}
    for q in (0.1, 0.5):
        for r in estimate_bandwidth(pts, "label", "vec_id", q).collect():
            assert abs(both[r.label, q] - r.bandwidth) < 1e-12
    assert estimate_bandwidths(pts.where("false"), "label", "vec_id", [0.1]).count() == 0


def test_cells_count_and_sum_as_all_points_do():
    rng = np.random.default_rng(6)
    pts = np.concatenate([c + rng.normal(size=(60, 4)) for c in rng.normal(size=(5, 4)) * 6] + [np.zeros((20, 4))])
    seeds, bw = pts[::3], rng.choice([0.5, 2.0, 5.0, 30.0], len(pts[::3]))
    for cells in (1, 16, 1000):
        cnt, total = _BlockCells(pts, cells).within(seeds, bw)
        near = np.sqrt(((seeds[:, None] - pts[None]) ** 2).sum(-1)) <= bw[:, None]
        assert (cnt == near.sum(1)).all()
        assert np.allclose(total, near.astype(float) @ pts)


def test_seeds_that_still_move_are_not_converged(spark):
    pts = _fixture(spark)
    width = estimate_bandwidth(pts, "label", "vec_id", 0.5)
    assert {r.converged for r in mean_shift(pts, "label", "vec_id", width, max_iter=1)[0].collect()} == {False}
    assert {r.converged for r in mean_shift(pts, "label", "vec_id", width)[0].collect()} == {True}
    assert mean_shift(pts.where("false"), "label", "vec_id", width)[0].count() == 0


def test_text_model_whitened(spark):
    from ctxrec.operators.reduce import fit_text_model, text_features
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = fit_text_model(docs, "doc_id", "text", 8)
    f = np.array([r.features for r in text_features(model, docs, "doc_id", "text").collect()])
    assert f.shape[1] == 8
    assert np.allclose(f.var(axis=0), 1.0, atol=1e-6)
    # no centering (as specified): the component scores are orthogonal as
    # raw cross-products, A V = U S
    g = f.T @ f
    d = np.sqrt(np.diag(g))
    assert np.abs(g / np.outer(d, d) - np.eye(8)).max() < 0.05
