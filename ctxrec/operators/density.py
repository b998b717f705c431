"""Density-based clustering per group: bandwidth estimation and mean shift.

Both need, for every point, facts about all other points of its group; all
of them run as block-pair passes (:mod:`ctxrec.operators.blocks`) that emit
one small row per point and block, never the pairs themselves.

* ``estimate_bandwidth(q)``: with m = max(1, floor(n q)) for a group of n
  points, the mean over its points of the distance to the m-th nearest
  point, the point itself counted first. The m-th distances of all quantiles
  are selected together: the distances to a few points of the group give a first
  interval for each; passes over all points count the distances below its edges and
  keep the part with the m-th one, until few are left in it, which are measured and
  handed on, equal ones once. An interval without the m-th one gives way to the side
  that has it, so the result is exact whatever the first interval.
* ``mean_shift``: every point is a seed; a seed moves to the mean of the
  points within the bandwidth until it moves less than 1e-3 bandwidth (at
  most 50 rounds, ``converged`` says which). A block's points lie in cells that
  keep (count, sum): by the triangle inequality a cell inside the bandwidth is
  taken whole, one outside is skipped, and only the points of the others are
  compared. Centers are taken by decreasing point count
  (ties by center), dropping those within the bandwidth of a kept one
  (decided exactly, in rounds); points go to the nearest kept center.

Squared distances come from one matrix product, with a bound of its error; pairs
nearer to a limit than that are measured.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxrec.operators.blocks import block_apply
from ctxrec.operators.topk import top_k
from ctxrec.session import checkpoint_dir

#: points of a block at most, rows of it compared at once
BLOCK = 16_384
CHUNK = 256
#: points of a group that give the first intervals, edges of an interval, distances
#: left in an interval when they are handed on
SAMPLE = 1024
BINS = 64
VALUES = 128
#: pairs measured at once
CELLS = 16_384


def _error_unit(dims: int) -> float:
    """Times the sum of two squared lengths: the largest error of ``_squares``."""
    return 8 * (dims + 8) * np.finfo(np.float64).eps


def _squares(L: np.ndarray, R: np.ndarray, chunk: int = CHUNK):
    """(first row, squared distances of a chunk of L to R, their largest error a row)."""
    own, other = (L * L).sum(1), (R * R).sum(1)
    most, unit = other.max(initial=0.0), _error_unit(L.shape[1])
    for s in range(0, len(L), chunk):
        l = own[s:s + chunk, None]
        yield s, np.maximum(l + other[None, :] - 2.0 * (L[s:s + chunk] @ R.T), 0.0), unit * (l + most)


def _measured(L: np.ndarray, R: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of the pairs (row i of L, row j of R)."""
    out = np.empty(len(i))
    for at in range(0, len(i), CELLS):
        diff = L[i[at:at + CELLS]] - R[j[at:at + CELLS]]
        out[at:at + CELLS] = np.sqrt(np.einsum("ik,ik->i", diff, diff))
    return out


def _near(L: np.ndarray, R: np.ndarray, width: np.ndarray):
    """(first row, pairs of a chunk of L with R at most ``width`` of the row of L apart)."""
    for s, d, err in _squares(L, R):
        limit = np.square(width[s:s + len(d), None])
        err = err + 1e-12 * limit
        near = d <= limit
        i, j = np.nonzero(np.abs(d - limit) <= err)
        near[i, j] = _measured(L, R, i + s, j) <= width[i + s]
        yield s, near & (width[s:s + len(d), None] >= 0)


def _stack(pdf: pd.DataFrame, col: str = "features") -> np.ndarray:
    return np.stack(pdf[col].to_numpy()).astype(np.float64)


def _points(df: DataFrame, group: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.col(group).cast("string").alias("owner"),
                     F.col("features").cast("array<double>").alias("features"))


# --- estimate_bandwidth ---------------------------------------------------------------

def _slots(left: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all open intervals, in the order of the points: the row of each, its ends."""
    row = np.repeat(np.arange(len(left)), left["m"].map(len).to_numpy())
    return row, *(np.concatenate(left[c].to_numpy()) for c in ("lo", "hi"))


def _first_fn(left, right):
    """First intervals of squared distances for the ranks m of each left point, from
    ``right``, some of the ``n`` points of its group; ``few`` is about how many are in one."""
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("id", "owner", "err", "top", "m", "lo", "hi", "few")})
    L, R = _stack(left), _stack(right)
    size, top, n = len(R), left["top"].to_numpy(), left["n"].to_numpy()
    out = {c: [] for c in ("m", "lo", "hi", "few")}
    for s, d, err in _squares(L, R):
        d.sort(axis=1)
        for i, (row, e) in enumerate(zip(d, err[:, 0]), s):
            m = np.array(sorted({int(x) for x in left["ms"].iat[i] if x <= n[i]}), dtype=np.int64)
            share = m / n[i]
            spread = 4 * np.sqrt(size * share * (1 - share)) + 2 if size < n[i] else np.zeros(len(m))
            a, b = np.floor(share * size - spread).astype(int) - 1, np.ceil(share * size + spread).astype(int) - 1
            out["m"].append(m)
            out["lo"].append(np.where(a >= 0, np.maximum(row[a.clip(0, size - 1)] - 3 * e, 0.0), 0.0))
            out["hi"].append(np.where(b < size, np.minimum(row[b.clip(0, size - 1)] + 3 * e, top[i]), top[i]))
            out["few"].append((b - a + 1) * (n[i] / size))
    return left[["id", "owner", "err", "top"]].assign(**out)


def _edges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo[:, None] + (hi - lo)[:, None] * (np.arange(BINS + 1) / BINS)[None, :]


def _count_fn(left, right):
    """Per left point: the numbers of squared distances below the edges of its intervals."""
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("id", "owner", "below")})
    row, lo, hi = _slots(left)
    edges, begin = _edges(lo, hi), np.searchsorted(row, np.arange(len(left) + 1))
    below = []
    for s, d, _ in _squares(_stack(left), _stack(right)):
        d.sort(axis=1)
        below += [np.searchsorted(x, edges[begin[i]:begin[i + 1]].ravel()) for i, x in enumerate(d, s)]
    return pd.DataFrame({"id": left["id"], "owner": left["owner"], "below": below})


def _value_fn(left, right):
    """Per left point and interval: how many distances are below it, and those inside,
    each once with its number."""
    names = ["id", "owner", "m", "below", "d", "cnt"]
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
    L, R = _stack(left), _stack(right)
    row, lo, hi = _slots(left)
    found = []
    for s, d, _ in _squares(L, R):
        at = np.arange(*np.searchsorted(row, [s, s + len(d)]))
        for k in at:
            x = d[row[k] - s]
            j = np.flatnonzero((x >= lo[k]) & (x <= hi[k]))
            v, cnt = np.unique(_measured(L, R, np.full(len(j), row[k]), j), return_counts=True)
            found.append((int((x < lo[k]).sum()), v, cnt))
    below, v, cnt = zip(*found)
    return pd.DataFrame({"id": left["id"].to_numpy()[row], "owner": left["owner"].to_numpy()[row],
                         "m": np.concatenate(left["m"].to_numpy()), "below": below, "d": v, "cnt": cnt})


_POINT = "id string, owner string, err double, top double, "
_INTERVALS = _POINT + "m array<long>, lo array<double>, hi array<double>, few array<double>"


def _narrowed(batches):
    """The part of each interval with the m-th distance, or the side that has it."""
    for pdf in batches:
        out = {c: [] for c in ("m", "lo", "hi", "few")}
        for p in pdf.itertuples():
            m, lo, hi = (np.asarray(x) for x in (p.m, p.lo, p.hi))
            below = np.sum(np.stack(p.below), axis=0).reshape(len(m), BINS + 1)
            edges, k = _edges(lo, hi), np.arange(len(m))
            e = (below < m[:, None]).sum(axis=1) - 1  # the last edge with fewer than m below
            inside = e.clip(0, BINS - 1)
            few = np.where((e >= 0) & (e < BINS), below[k, inside + 1] - below[k, inside], np.inf)
            out["m"].append(m)
            out["lo"].append(np.where(e < 0, 0.0, np.maximum(edges[k, e.clip(0)] - 3 * p.err, 0.0)))
            out["hi"].append(np.minimum(np.where(e >= BINS, p.top, edges[k, (e + 1).clip(0, BINS)] + 3 * p.err), p.top))
            out["few"].append(few)
        yield pdf[["id", "owner", "err", "top"]].assign(**out)


def _selected(batches):
    """``d``, the m-th distance, where the interval has it surely; else another interval."""
    names = ["id", "owner", "err", "top", "m", "lo", "hi", "few", "d"]
    for pdf in batches:
        rows = []
        for p in pdf.itertuples():
            v, cnt = np.concatenate(list(p.d)), np.concatenate(list(p.cnt))
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(np.cumsum(cnt[order]), p.m - p.below)
            if p.m > p.below and at < len(v):
                d = v[order[at]]
                low, high = p.lo > 0 and d * d < p.lo + p.err, p.hi < p.top and d * d > p.hi - p.err
            else:
                d, low, high = None, p.m <= p.below, p.m > p.below
            lo, hi = (0.0, p.lo + 3 * p.err) if low else (p.hi - 3 * p.err, p.top)
            rows.append((p.id, p.owner, p.err, p.top, p.m, max(lo, 0.0), hi, np.inf, None if low or high else float(d)))
        yield pd.DataFrame(rows, columns=names)


def ranked_distances(points: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """For each point ``(id, owner, features, ms array<bigint>)`` and each rank m
    of ``ms``: the distance to its m-th nearest point of the same owner (itself
    first). ``(id, owner, m, d)``. Points without a finite length have no distances."""
    checkpoint_dir(points.sparkSession)
    key = ["id", "owner"]
    length = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    all_pts = points.select("id", "owner", "features", F.array_distinct("ms").alias("ms"), length.alias("sq"),
                            F.size("features").alias("dims")).checkpoint(eager=True)
    pts = all_pts.where(F.col("sq") < float("inf"))
    of_owner = pts.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("most"))
    err = (F.col("dims") + 8) * F.lit(8 * np.finfo(np.float64).eps) * (F.col("sq") + F.col("most"))  # as _squares has it
    top = 2.0 * (F.col("sq") + F.col("most")) + 8 * F.col("err")  # beyond any squared distance
    pts = (pts.join(of_owner, on="owner").withColumn("err", err).withColumn("top", top)
           .select(*key, "features", "ms", "n", "err", "top").checkpoint(eager=True))
    right = pts.select(*key, "features")
    some = top_k(right, ["owner"], [F.xxhash64("id"), F.col("id")], SAMPLE).drop("rank")
    def flat(df):  # an interval a row
        return df.select(*key, "err", "top", F.explode(F.arrays_zip("m", "lo", "hi", "few")).alias("s")).select(*key, "err", "top", "s.*")

    def compared(slots, fn, schema):
        asked = slots.groupBy(*key).agg(F.first("err").alias("err"), F.first("top").alias("top"),
                                        F.sort_array(F.collect_list(F.struct("m", "lo", "hi"))).alias("s"))
        asked = asked.select(*key, "err", "top", F.col("s.m").alias("m"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
        return asked, block_apply(right.join(asked, on=key), right, fn, schema, within=True, block_size=block_size)

    slots = flat(block_apply(pts, some, _first_fn, _INTERVALS, within=True, block_size=block_size)
                 .dropDuplicates(key)).checkpoint(eager=True)
    done = None
    # an interval of a few errors' width holds equal distances
    wide = (F.col("few") > VALUES) & (F.col("hi") - F.col("lo") > 64 * F.col("err"))
    while True:
        more = slots.where(wide)
        if not more.isEmpty():
            asked, counts = compared(more, _count_fn, "id string, owner string, below array<long>")
            counts = counts.groupBy(*key).agg(F.collect_list("below").alias("below"))
            parts = flat(asked.join(counts, on=key).mapInPandas(_narrowed, _INTERVALS))
            slots = slots.where(~wide).unionByName(parts).checkpoint(eager=True)
            continue
        _, values = compared(slots, _value_fn, "id string, owner string, m long, below long, d array<double>, cnt array<long>")
        values = values.groupBy(*key, "m").agg(F.sum("below").alias("below"), F.collect_list("d").alias("d"), F.collect_list("cnt").alias("cnt"))
        found = (slots.select(*key, "m", "lo", "hi", "err", "top").join(values, on=[*key, "m"])
                 .mapInPandas(_selected, _POINT + "m long, lo double, hi double, few double, d double").checkpoint(eager=True))
        met = found.where(F.col("d").isNotNull()).select(*key, "m", "d")
        done = met if done is None else done.unionByName(met)
        slots = found.where(F.col("d").isNull()).drop("d")
        if slots.isEmpty():
            return right.select(*key).join(done, on=key).select("id", "owner", "m", "d")


def estimate_bandwidths(points: DataFrame, group: str, key: str, quantiles: list[float],
                        block_size: int = BLOCK) -> DataFrame:
    """``(group, quantile, bandwidth)`` for ``points(group, key, features)``, all quantiles in the same passes."""
    pts = _points(points, group, key)
    n = pts.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    ms = F.array(*[F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(q))).cast("bigint") for q in quantiles])
    of_owner = n.select("owner", ms.alias("ms")).checkpoint(eager=True)
    d = ranked_distances(pts.join(of_owner, on="owner"), block_size)
    mean = d.groupBy("owner", "m").agg(F.avg("d").alias("bandwidth"))
    asked = of_owner.select("owner", F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in quantiles]).alias("q"), F.col("ms").alias("m"))).alias("__a"))
    return (asked.select("owner", F.col("__a")["q"].alias("quantile"), F.col("__a")["m"].alias("m")).join(mean, on=["owner", "m"])
            .select(F.col("owner").alias(group), "quantile", "bandwidth"))


def estimate_bandwidth(points: DataFrame, group: str, key: str, quantile: float,
                       block_size: int = BLOCK) -> DataFrame:
    """``(group, bandwidth)`` for ``points(group, key, features)``."""
    return estimate_bandwidths(points, group, key, [quantile], block_size).drop("quantile")


# --- mean shift ---------------------------------------------------------------------------

class _BlockCells:
    """A block's points in cells around a few of them, with counts and sums."""

    def __init__(self, R: np.ndarray, cells: int):
        self.pivots = R[np.linspace(0, len(R) - 1, min(cells, len(R))).astype(int)]
        own, far = np.empty(len(R), dtype=np.int64), np.empty(len(R))
        for s, d, err in _squares(R, self.pivots):
            own[s:s + len(d)] = d.argmin(axis=1)
            far[s:s + len(d)] = np.sqrt(np.maximum(d.min(axis=1), 0.0) + err[:, 0])
        order = np.argsort(own, kind="stable")
        self.points, n = R[order], len(self.pivots)
        self.size = np.bincount(own, minlength=n)
        self.begin = np.cumsum(self.size) - self.size
        self.radius = np.full(n, -np.inf)
        np.maximum.at(self.radius, own, far)
        self.sum = np.zeros((n, R.shape[1]))
        np.add.at(self.sum, own, R)

    def within(self, centers: np.ndarray, bw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, sum) of the points within ``bw`` of each center. Distances
        near the bounds are left to the points themselves."""
        cnt, total = np.zeros(len(centers), dtype=np.int64), np.zeros(centers.shape)
        some = self.size > 0
        for s, t, err in _squares(centers, self.pivots):
            c, w = centers[s:s + len(t)], bw[s:s + len(t), None]
            t = np.sqrt(np.maximum(t, 0.0))
            slack = np.sqrt(err) + 1e-9 * (1 + w + t)
            whole = some & (t + self.radius <= w - slack)
            cnt[s:s + len(t)] += whole @ self.size
            total[s:s + len(t)] += whole.astype(float) @ self.sum
            for j in np.flatnonzero((some & ~whole & (t - self.radius <= w + slack)).any(axis=0)):
                i = np.flatnonzero(~whole[:, j] & (t[:, j] - self.radius[j] <= w[:, 0] + slack[:, j]))
                pts = self.points[self.begin[j]: self.begin[j] + self.size[j]]
                for at, near in _near(c[i], pts, w[i, 0]):
                    to = s + i[at:at + len(near)]
                    cnt[to] += near.sum(axis=1)
                    total[to] += near.astype(float) @ pts
        return cnt, total


def _shift_fn(dims: int, cells: int = 32):
    cols = [f"s{j}" for j in range(dims)]

    def fn(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series([], dtype=object), "cnt": pd.Series([], dtype="int64"),
                                 **{c: pd.Series([], dtype="float64") for c in cols}})
        cnt, sums = _BlockCells(_stack(right), cells).within(_stack(left, "center"), left["bw"].to_numpy())
        out = pd.DataFrame(sums, columns=cols)
        out.insert(0, "cnt", cnt)
        out.insert(0, "id", left["id"].astype(str).to_numpy())
        return out
    return fn


def _suppress_fn(left, right):
    if left.empty or right.empty:
        return pd.DataFrame({"id": pd.Series([], dtype=object), "kept_near": pd.Series([], dtype=bool),
                             "open_near": pd.Series([], dtype=bool)})
    L, R = _stack(left, "center"), _stack(right, "center")
    lp, rp = left["prio"].to_numpy(), right["prio"].to_numpy()
    rk = right["status"].to_numpy() == 1
    ro = right["status"].to_numpy() == 0
    bw = left["bw"].to_numpy()
    kept, open_ = np.zeros(len(L), dtype=bool), np.zeros(len(L), dtype=bool)
    for s, near in _near(L, R, bw):
        near &= rp[None, :] < lp[s:s + len(near), None]
        kept[s:s + len(near)] = (near & rk[None, :]).any(axis=1)
        open_[s:s + len(near)] = (near & ro[None, :]).any(axis=1)
    return pd.DataFrame({"id": left["id"].astype(str).to_numpy(), "kept_near": kept, "open_near": open_})


def mean_shift(points: DataFrame, group: str, key: str, bandwidth: DataFrame,
               max_iter: int = 50, tol: float = 1e-3, block_size: int = BLOCK):
    """Returns (assignments ``(group, key, cluster, converged)``, centers
    ``(group, cluster, center, intensity, converged)``); ``converged`` is false
    where a seed still moved after ``max_iter`` rounds. ``bandwidth``: ``(group, bandwidth)``."""
    from ctxrec.operators.features import range_positions
    from ctxrec.operators.similarity import nearest

    spark = points.sparkSession
    checkpoint_dir(spark)
    pts = _points(points, group, key).checkpoint(eager=True)
    dims = pts.agg(F.max(F.size("features"))).first()[0] or 0
    if not dims:  # no points
        none = pts.select(F.col("owner").alias(group), F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(True).alias("converged"))
        return none, pts.select(F.col("owner").alias(group), F.lit(0).alias("cluster"), F.col("features").alias("center"),
                                F.lit(0).cast("bigint").alias("intensity"), F.lit(True).alias("converged"))
    bw = bandwidth.select(F.col(group).cast("string").alias("owner"), F.col("bandwidth").alias("bw"))
    right = pts.select("id", "owner", "features")
    seeds = (pts.join(bw, on="owner").select("id", "owner", "bw", F.col("features").alias("center"),
                                             F.lit(0).cast("bigint").alias("cnt"))
             .checkpoint(eager=True))
    done = None
    scols = [f"s{j}" for j in range(dims)]
    for _ in range(max_iter):
        part = block_apply(seeds.select("id", "owner", "center", "bw"), right, _shift_fn(dims),
                           "id string, cnt long, " + ", ".join(f"{c} double" for c in scols),
                           within=True, block_size=block_size)
        agg = part.groupBy("id").agg(F.sum("cnt").alias("cnt"), *[F.sum(c).alias(c) for c in scols])
        new_center = F.when(F.col("cnt") > 0, F.array(*[F.col(c) / F.col("cnt") for c in scols])) \
            .otherwise(F.col("center"))
        moved = seeds.drop("cnt").join(agg, on="id").select(
            "id", "owner", "bw", new_center.alias("center"), "cnt",
            F.sqrt(F.aggregate(F.zip_with(new_center, F.col("center"), lambda a, b: (a - b) * (a - b)),
                               F.lit(0.0), lambda acc, x: acc + x)).alias("__shift")).checkpoint(eager=True)
        conv = moved.where(F.col("__shift") < F.lit(tol) * F.col("bw")).drop("__shift")
        done = conv if done is None else done.unionByName(conv)
        seeds = moved.where(F.col("__shift") >= F.lit(tol) * F.col("bw")).drop("__shift").checkpoint(eager=True)
        if seeds.isEmpty():
            break
    centers = seeds.withColumn("converged", F.lit(False))
    if done is not None:
        centers = done.withColumn("converged", F.lit(True)).unionByName(centers)
    centers = centers.checkpoint(eager=True)

    # priority: more points within the bandwidth first, then the larger center
    neg = F.transform("center", lambda x: -x)
    ranked = range_positions(centers.select("id", "owner", "bw", "center", "cnt", "converged",
                                            (-F.col("cnt")).alias("__nc"), neg.alias("__nx")),
                             ["owner"], ["__nc", "__nx", "id"]).drop("__nc", "__nx")
    state = ranked.select("id", "owner", "bw", "center", "cnt", "converged", F.col("pos").alias("prio"),
                          F.lit(0).alias("status")).checkpoint(eager=True)
    while state.where(F.col("status") == 0).limit(1).count() > 0:
        cand = state.where(F.col("status") == 0)
        flags = (block_apply(cand.select("id", "owner", "center", "prio", "bw"),
                             state.where(F.col("status") >= 0).select("id", "owner", "center", "prio", "status"),
                             _suppress_fn, "id string, kept_near boolean, open_near boolean",
                             within=True, block_size=block_size)
                 .groupBy("id").agg(F.bool_or("kept_near").alias("kn"), F.bool_or("open_near").alias("on")))
        status = (F.when(F.col("status") != 0, F.col("status"))
                  .when(F.col("kn"), F.lit(-1))
                  .when(~F.col("on"), F.lit(1)).otherwise(F.lit(0)))
        state = (state.join(flags, on="id", how="left").withColumn("status", status)
                 .drop("kn", "on").checkpoint(eager=True))
    kept = state.where(F.col("status") == 1)
    kept = range_positions(kept, ["owner"], ["prio"]).withColumn("cluster", F.col("pos").cast("int")).drop("pos")
    kept = kept.checkpoint(eager=True)
    nn = nearest(pts, 1, exclude_self=False, within=True,
                 others=kept.select(F.lpad(F.col("cluster").cast("string"), 10, "0").alias("id"), "owner",
                                    F.col("center").alias("features")))
    assign = (nn.join(centers.select(F.col("id").alias("id_a"), "owner", "converged"), on="id_a")
              .select(F.col("owner").alias(group), F.col("id_a").alias(key), F.col("id_b").cast("int").alias("cluster"), "converged"))
    return assign, kept.select(F.col("owner").alias(group), "cluster", "center", F.col("cnt").alias("intensity"), "converged")
