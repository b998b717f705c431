"""Invariants of the iterative and similarity operators."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxrec.operators import cluster
from ctxrec.operators.features import positions
from ctxrec.operators.sequence import carry_last
from ctxrec.operators.similarity import nearest
from ctxrec.plans import catalog

SF = "/root/testdata/sf0.001"


def _emb(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    return e.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("features"))


def test_kmeans_assigns_nearest_center(spark):
    pts = _emb(spark)
    a, centers = cluster.grouped_kmeans(pts, "label", "vec_id", 4, iterations=5)
    p = {r.vec_id: np.array(r.features) for r in pts.collect()}
    c = {(r.label, r.cluster): np.array(r.center) for r in centers.collect()}
    for r in a.collect():
        d = {cl: float(np.round(((p[r.vec_id] - v) ** 2).sum(), 9)) for (lab, cl), v in c.items() if lab == r.label}
        assert d[r.cluster] == min(d.values())


def test_kmeans_inertia_not_increasing(spark):
    pts = _emb(spark)
    inertia = []
    for t in (1, 2, 4, 8):
        a, _ = cluster.grouped_kmeans(pts, "label", "vec_id", 4, iterations=t)
        inertia.append(a.agg(F.sum("sq_dist")).first()[0])
    assert all(x >= y - 1e-9 for x, y in zip(inertia, inertia[1:]))


def test_kmeans_k_capped_by_distinct_points(spark):
    df = spark.createDataFrame([("g", 1, [0.0]), ("g", 2, [0.0]), ("g", 3, [1.0])], "g string, k int, features array<double>")
    a, c = cluster.grouped_kmeans(df, "g", "k", 5, iterations=2)
    assert c.count() == 2 and {r.cluster for r in a.collect()} == {0, 1}


def test_nearest_matches_brute_force(spark):
    pts = _emb(spark).select(F.col("vec_id").cast("string").alias("id"),
                             F.col("label").cast("string").alias("owner"), "features")
    nn = nearest(pts, 3, exclude_self=True, exclude_same_owner=True, block_size=16)
    rows = pts.collect()
    X = np.array([r.features for r in rows])
    ids = [r.id for r in rows]
    own = [r.owner for r in rows]
    got = {}
    for r in nn.collect():
        got.setdefault(r.id_a, []).append((r.rank, r.id_b))
    for i, a in enumerate(ids[:40]):
        d = np.round(np.sqrt(((X - X[i]) ** 2).sum(1)), 9)
        cand = sorted((d[j], ids[j]) for j in range(len(ids)) if own[j] != own[i])
        assert [b for _, b in sorted(got[a])] == [b for _, b in cand[:3]]


def test_no_own_profile_and_ranks_in_range(spark):
    _, pv = catalog._profile_inputs(spark, SF)
    from ctxrec.operators.cf import profile_matches
    m = profile_matches(pv, 10)
    assert m.where(F.col("username") == F.col("match_username")).count() == 0
    assert m.where((F.col("similarity") <= 0) | (F.col("similarity") > 1)).count() == 0
    r = catalog.QUERIES["rank_heuristic"](spark, SF)
    assert r.where((F.col("score") < 0) | (F.col("score") > 5)).count() == 0


def test_carry_last_equals_lag(spark):
    df = spark.range(0, 500).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 11).alias("v"))
    got = carry_last(df.withColumn("b", F.floor(F.col("t") / 17)), ["k"], ["t"], "b",
                     {"p": (F.col("v") > 4, F.col("v"))}).select("k", "t", F.col("p.v").alias("p"))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.select("k", "t", F.last(F.when(F.col("v") > 4, F.col("v")), ignorenulls=True).over(w).alias("p"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_positions_equal_row_number(spark):
    df = spark.range(0, 300).select((F.col("id") % 2).alias("k"), (F.col("id") * 13 % 101).alias("t"),
                                    F.col("id").alias("i"))
    got = positions(df.withColumn("b", F.floor(F.col("t") / 10)), ["k"], ["t", "i"], "b").select("k", "i", "pos")
    w = Window.partitionBy("k").orderBy("t", "i")
    exp = df.select("k", "i", (F.row_number().over(w) - 1).cast("bigint").alias("pos"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_learned_ranks_cover_unrated_urls(spark):
    from ctxrec.operators import ranking
    from ctxrec.sources import adapters
    v = adapters.driver_views(spark, SF)
    r = adapters.driver_resources(spark, SF)
    learned = ranking.rank_learned(v, r)
    data = ranking.learned_dataset(v, r)
    want = {(x.username, x.url) for x in data.where(F.col("label").isNull()).collect()}
    got = learned.collect()
    assert {(x.username, x.url) for x in got} == want
    assert all(0 <= x.score <= 5 for x in got)


def test_kmeans_odd_points_and_many_groups(spark):
    """Nulls, NaN, copies, null groups and groups of more than a block: each
    point's cluster is the one SQL's order gives, whether the centers are sent
    or shuffled."""
    rng = np.random.default_rng(3)
    nan = float("nan")
    rows = [(None, 0, [1.0, 2.0]), ("a", 1, [0.0, 0.0]), ("a", 2, [nan, 0.0]), ("a", 3, [1.0, None]), ("a", 4, None),
            ("a", 4, None), ("a", 5, [5.0, 5.0]), ("a", 6, [5.0, 5.0]), ("c", 1, None), ("d", None, [1.0, 1.0])]
    rows += [("b", i, [float(x) for x in rng.integers(0, 40, 2) / 4]) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, features array<double>")
    for k in (4,):
        sent = cluster.grouped_kmeans(df, "g", "k", k, iterations=3)
        old, cluster.SENT_BYTES = cluster.SENT_BYTES, 0
        try:
            moved = cluster.grouped_kmeans(df, "g", "k", k, iterations=3)
        finally:
            cluster.SENT_BYTES = old
        got = [sorted(map(str, a.collect())) for a, _ in (sent, moved)]
        assert got[0] == got[1] and len(got[0]) == len(rows) - 1
        a, centers = sent
        pts = df.join(centers.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("c")), "g")
        best = F.array_min(F.transform("c", lambda c: F.struct(
            F.round(cluster.sq_dist(F.col("features"), c["center"]), 9).alias("d"), c["cluster"].alias("cluster"))))
        want = pts.select("g", "k", best["cluster"].alias("cluster"), best["d"].alias("sq_dist"))
        assert sorted(map(str, want.collect())) == got[0]


def test_kmeans_sends_no_growing_table(spark):
    """Centers of many groups meet their points by a shuffle, not on the driver."""
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").alias("k"),
                                    F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    a, _ = cluster.grouped_kmeans(df, "g", "k", 3, iterations=1)
    assert "BroadcastHashJoin" not in a._jdf.queryExecution().executedPlan().toString()
    assert a.select("cluster").distinct().count() == 3
