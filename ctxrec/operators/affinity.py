"""Affinity propagation per group: over all pairs of a group, or on an edge table.

An edge (i, k) carries the similarity ``s = -distance^2``, the responsibility ``r``
(how well k suits i against i's other candidates) and the availability ``a`` (how
much support k has). A round is

* ``r(i,k) = s(i,k) - max over k' != k of (a(i,k') + s(i,k'))``;
* ``a(i,k) = min(0, r(k,k) + sum over i' not in (i, k) of max(0, r(i',k)))`` and
  ``a(k,k) = sum over i' != k of max(0, r(i',k))``,

both damped. Every point is a candidate of every other one of its group. The pair
table is never stored: what a row i learns of the others in a round are two numbers
a candidate k (the sum over i' and ``r(k,k)``), so a task that holds some rows makes
their ``r`` and ``a`` anew from the points and the numbers of the rounds before. A
round moves the points once a block of rows and returns two numbers a candidate and
block; a task holds about CELLS pairs. The work is quadratic in a group's points
(and in the rounds, whose replay costs less than a stored pair table).

With ``neighbours`` given, each point is linked with so many nearest points only, on
an edge table: an approximation.

A point with ``r(k,k) + a(k,k) > 0`` is an exemplar (a group without any takes
the one with the largest sum, then the smallest key); points go to their group's
nearest exemplar. The preference ``s(k,k)`` is the group's median similarity
unless given; groups of one point are their own exemplar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxrec.operators.similarity import _block_dist, all_pairs, nearest
from ctxrec.operators.topk import top_k
from ctxrec.session import ship_package
from ctxrec.sources.store import materialised

#: pairs of points in a task
CELLS = 1 << 21
ROUNDS = 30
DAMPING = 0.5
#: accuracy of the median: exact up to about this many edges a group
MEDIAN_ACCURACY = 1_000_000


def similarity_edges(points: DataFrame, group: str, key: str, neighbours: int | None = None, preference: float | None = None) -> DataFrame:
    """``(g, i, k, s)``: the other points of each point's group (with ``neighbours``,
    so many nearest ones) and itself. Keys are unique over all groups."""
    pts = points.select(F.col(key).cast("string").alias("id"), F.col(group).cast("string").alias("owner"),
                        F.col("features").cast("array<double>").alias("features"))
    near = all_pairs(pts, within=True) if neighbours is None else nearest(pts, neighbours, within=True)
    near = near.join(pts.select(F.col("id").alias("id_a"), F.col("owner").alias("g")), on="id_a").select(
        "g", F.col("id_a").alias("i"), F.col("id_b").alias("k"), (-F.col("distance") * F.col("distance")).alias("s"))
    near = materialised(near, "affinity-edges")
    if preference is None:
        middle = near.groupBy("g").agg(F.percentile_approx("s", 0.5, MEDIAN_ACCURACY).alias("p"))
    else:
        middle = pts.select(F.col("owner").alias("g")).distinct().withColumn("p", F.lit(float(preference)))
    own = (pts.select(F.col("owner").alias("g"), F.col("id").alias("i"), F.col("id").alias("k")).join(middle, on="g", how="left")
           .select("g", "i", "k", F.coalesce("p", F.lit(0.0)).alias("s")))
    return near.unionByName(own)


def pass_messages(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(g, i, k, s, r, a)`` after the rounds."""
    state = materialised(edges.select("g", "i", "k", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("a")), "affinity")
    two = F.slice(F.sort_array(F.collect_list(F.col("a") + F.col("s")), asc=False), 1, 2)
    other = F.when(F.col("a") + F.col("s") == F.col("both")[0], F.coalesce(F.get("both", F.lit(1)), F.col("s") - 1.0)).otherwise(F.col("both")[0])
    pull = F.greatest(F.col("r"), F.lit(0.0))
    for _ in range(rounds):
        asked = state.join(state.groupBy("i").agg(two.alias("both")), on="i").select(
            "g", "i", "k", "s", (damping * F.col("r") + (1 - damping) * (F.col("s") - other)).alias("r"), "a")
        asked = materialised(asked, "affinity")
        support = asked.groupBy("k").agg(F.sum(F.when(F.col("i") != F.col("k"), pull).otherwise(0.0)).alias("t"),
                                         F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).alias("own"))
        given = F.when(F.col("i") == F.col("k"), F.col("t")).otherwise(F.least(F.lit(0.0), F.col("own") + F.col("t") - pull))
        state = materialised(asked.join(support, on="k").select(
            "g", "i", "k", "s", "r", (damping * F.col("a") + (1 - damping) * given).alias("a")), "affinity")
    return state


# --- all pairs of a group ------------------------------------------------------------------

def _similarities(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the rows of this block, distances of their points to all, which are finite);
    a point's distance to itself does not count."""
    rows = np.flatnonzero(pdf["mine"].to_numpy())
    X = np.stack(pdf["features"].to_numpy()).astype(np.float64)
    d = np.empty((len(rows), len(X)))
    step = max(1, (1 << 20) // max(1, X.size))
    with np.errstate(invalid="ignore", over="ignore"):
        for lo in range(0, len(rows), step):
            d[lo:lo + step] = np.round(_block_dist(X[rows[lo:lo + step]], X, "euclidean"), 9)
    d[np.arange(len(rows)), rows] = np.nan
    return rows, d, np.isfinite(d)


def _digits_fn(shift: int):
    """How many distances of a block, of those that begin with the bits ``prefix``,
    go on with each 16 bits. The bits of positive doubles are in their order."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        _, d, have = _similarities(pdf)
        bits = (d[have] + 0.0).view(np.int64)
        if shift < 48:
            bits = bits[(bits >> (shift + 16)) == pdf["prefix"].iat[0]]
        digit, n = np.unique((bits >> shift) & 0xFFFF, return_counts=True)
        return pd.DataFrame({"g": pdf["g"].iat[0], "digit": digit.astype(np.int64), "n": n.astype(np.int64)})
    return fn


def _median_similarity(work: DataFrame) -> DataFrame:
    """``(g, p)``: the lower median of the similarities of all pairs of a group,
    selected exactly by 16 bits of the distance at a time."""
    found = None
    for shift in (48, 32, 16, 0):
        part = work if found is None else work.join(found.select("g", "prefix"), on="g")
        n = part.groupBy("g", "b").applyInPandas(_digits_fn(shift), "g string, digit long, n long").groupBy("g", "digit").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("g").orderBy("digit")  # 65,536 rows at most
        n = n.withColumn("upto", F.sum("n").over(w))
        if found is None:  # the k-th smallest similarity is the k-th largest distance
            total = F.sum("n").over(Window.partitionBy("g"))
            n = n.withColumn("rank", total - F.ceil(total / 2) + 1).withColumn("prefix", F.lit(0).cast("long"))
        else:
            n = n.join(found, on="g")
        n = n.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        found = materialised(n.select("g", (F.col("prefix") * 65536 + F.col("digit")).alias("prefix"),
                                      (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "affinity-median")

    def value(batches):
        for pdf in batches:
            d = pdf["prefix"].to_numpy(np.int64).view(np.float64)
            yield pd.DataFrame({"g": pdf["g"], "p": -d * d})
    return found.select("g", "prefix").mapInPandas(value, "g string, p double")


def _round_fn(damping: float):
    """(g, pos, t, own): what the block's rows add to the sum of max(0, r) of each
    candidate, and r(k,k) of its own, after the rounds whose sums are given."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        rows, d, have = _similarities(pdf)
        at = np.arange(len(rows))
        s = -d * d
        s[at, rows] = pdf["p"].to_numpy()[rows]
        have[at, rows] = True
        s[~have] = -np.inf
        alone = have.sum(axis=1) == 1
        sums, owns = (np.stack(pdf[c].to_numpy()) for c in ("sums", "owns"))
        r, a = np.zeros(s.shape), np.zeros(s.shape)
        for t in range(sums.shape[1] + 1):
            x = a + s
            best = x.argmax(axis=1)
            top = x[at, best]
            x[at, best] = -np.inf
            second = x.max(axis=1)
            second[alone] = s[at, rows][alone] - 1.0
            other = np.broadcast_to(top[:, None], s.shape).copy()
            other[at, best] = second
            new = np.where(have, s - np.where(have, other, 0.0), 0.0)
            r = damping * r + (1 - damping) * new
            if t < sums.shape[1]:
                given = np.minimum(0.0, owns[None, :, t] + sums[None, :, t] - np.maximum(r, 0.0))
                given[at, rows] = sums[rows, t]
                a = damping * a + (1 - damping) * given
        own = np.full(len(pdf), np.nan)
        own[rows] = r[at, rows]
        r[at, rows] = 0.0
        return pd.DataFrame({"g": pdf["g"], "pos": pdf["pos"], "t": np.maximum(r, 0.0).sum(axis=0), "own": own})
    return fn


def dense_scores(points: DataFrame, group: str, key: str, rounds: int = ROUNDS, damping: float = DAMPING,
                 preference: float | None = None) -> DataFrame:
    """``(g, id, e)``: r(k,k) + a(k,k) of every point after the rounds, over all
    pairs of its group. Rows of an equal key are points of their own."""
    ship_package(points.sparkSession)
    pts = points.select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("id"),
                        F.col("features").cast("array<double>").alias("features")).dropna()
    of_g = Window.partitionBy("g")
    pts = materialised(pts.withColumn("pos", F.row_number().over(of_g.orderBy("id", "features"))), "affinity-points")
    size = pts.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # some blocks also of a small group, for as many tasks
    size = size.select("g", F.greatest(F.ceil(F.col("n") * F.col("n") / CELLS), F.least(F.lit(4), F.ceil(F.col("n") / 128))).cast("int").alias("blocks"))
    work = pts.join(size, on="g").select("g", "pos", "features", (F.col("pos") % F.col("blocks")).alias("own"),
                                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    work = materialised(work.select("g", "b", "pos", (F.col("own") == F.col("b")).alias("mine"), "features"), "affinity-blocks")
    none = F.array().cast("array<double>")
    told = pts.select("g", "pos", "id", none.alias("sums"), none.alias("owns"))
    if preference is None:
        told = told.join(_median_similarity(work), on="g", how="left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    else:
        told = told.withColumn("p", F.lit(float(preference)))
    told = materialised(told, "affinity-sums")
    schema = "g string, pos int, t double, own double"
    for _ in range(rounds):
        sent = (work.join(told.drop("id"), on=["g", "pos"]).groupBy("g", "b").applyInPandas(_round_fn(damping), schema)
                .groupBy("g", "pos").agg(F.sum("t").alias("t"), F.max(F.nanvl("own", F.lit(None))).alias("own")))
        told = materialised(told.join(sent, on=["g", "pos"]).select(
            "g", "pos", "id", "p", F.concat("sums", F.array("t")).alias("sums"), F.concat("owns", F.array("own")).alias("owns")), "affinity-sums")
    a = F.aggregate("sums", F.lit(0.0), lambda a, t: damping * a + (1 - damping) * t)
    r = F.coalesce(F.element_at("owns", -1), F.lit(0.0)) if rounds else F.lit(0.0)
    return told.select("g", "id", F.round(r + a, 9).alias("e"))


def affinity_propagation(points: DataFrame, group: str, key: str, neighbours: int | None = None, rounds: int = ROUNDS,
                         damping: float = DAMPING, preference: float | None = None) -> DataFrame:
    """``(group, key, exemplar)`` of every point; ``exemplar`` is a key as a string.
    All points of a group are candidates unless ``neighbours`` says how many."""
    if neighbours is None:
        score = dense_scores(points, group, key, rounds, damping, preference)
    else:
        sent = pass_messages(similarity_edges(points, group, key, neighbours, preference), rounds, damping)
        score = sent.where("i = k").select("g", F.col("k").alias("id"), F.round(F.col("r") + F.col("a"), 9).alias("e"))
    chosen = top_k(score, ["g"], [F.col("e").desc(), F.col("id")], 1).select("g", "id", "e")
    exemplars = score.where("e > 0").unionByName(chosen).select("g", "id").distinct()
    pts = points.select(F.col(key).cast("string").alias("id"), F.col(group).cast("string").alias("owner"),
                        F.col("features").cast("array<double>").alias("features"), F.col(group), F.col(key))
    heads = pts.join(exemplars, on="id", how="left_semi")
    near = nearest(pts.select("id", "owner", "features"), 1, exclude_self=False, within=True, others=heads.select("id", "owner", "features"))
    return (pts.select("id", group, key).join(near.select(F.col("id_a").alias("id"), F.col("id_b").alias("exemplar")), on="id")
            .select(group, key, "exemplar"))
