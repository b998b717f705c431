"""Exact nearest neighbours, without meeting all pairs.

Points are dealt into cells around pivots (a sample spread by hash, at most
MAX_PIVOTS). One pass measures every point against every pivot and keeps, per
cell, the least and largest distance of its members from the pivot and, per
pivot, the few smallest distances of any point. By the triangle inequality

* every point of cell i has its k nearest within
  ``reach_i = radius_i + (k-th smallest distance of a point from pivot i)``;
* a point at distance t from pivot i is at least ``t - radius_i`` and
  ``inner_i - t`` away from every member of cell i.

So a point travels only to the cells whose reach it can touch: on clustered
points to a few, on points without structure to all, which is then what a plain
block join costs, as a cell is no smaller than a block. Cells of more than a
block, and the points that travel to them, are cut into blocks again; a task
holds one block of each side and returns k rows a left point, and a partial
top-k merges them. The copies a point makes are counted before they are made.

Points excluded from an answer (the point itself, its owner's others) may be the
ones nearest to a pivot, so the bound counts on ``k`` plus the largest number of
excluded points. Pearson distance is half the squared euclidean distance of the
standardised vectors, in which the bounds are taken; constant vectors have no
correlation and take no part. With ``within`` only points of one owner meet, and
an owner with many points has several blocks.

Points of an equal vector (profiles of one page, say) are searched for together where
ids differ and few points are excluded; inside a task, a product in single precision
with its error bound picks the few pairs that are measured.

The reference builds the full n x n distance matrix and only ever reads the best
few entries of each row. Distances are exact (rounded to 9 digits, ties by
``id_b``); similarity = 1 / (1 + distance).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrec.operators.topk import top_k

_OUT = "id_a string, id_b string, distance double"
MAX_PIVOTS = 1024
#: points of a block, at least
BLOCK = 1024
#: beyond this many distances kept a pivot, a cell's reach counts as unbounded
MAX_KEPT = 1024
#: distances are rounded to 9 digits; bounds give way by more
SLACK = 1e-8


def _block_dist(L: np.ndarray, R: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.abs(L[:, None, :] - R[None, :, :]).sum(-1)
    if metric == "pearson":
        lc = L - L.mean(1, keepdims=True)
        rc = R - R.mean(1, keepdims=True)
        num = lc @ rc.T
        den = np.sqrt((lc * lc).sum(1))[:, None] * np.sqrt((rc * rc).sum(1))[None, :]
        return 1.0 - num / den
    diff = L[:, None, :] - R[None, :, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


#: steps of the grid on which Manhattan distances are bounded
STEPS = 1000


def _grid(L: np.ndarray, R: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Both sides rounded to a grid, as rows of coordinates, and its step; nothing
    where sums of steps would not fit or numbers are not finite."""
    low, high = min(L.min(initial=0.0), R.min(initial=0.0)), max(L.max(initial=0.0), R.max(initial=0.0))
    step = (high - low) / STEPS
    if not (np.isfinite(step) and step > 0):
        return None
    if L.shape[1] * STEPS > np.iinfo(np.int32).max:
        return None
    kind = np.int16 if L.shape[1] * STEPS <= np.iinfo(np.uint16).max else np.int32
    return *(np.ascontiguousarray(np.rint((x - low) / step).astype(kind).T) for x in (L, R)), step


def _standard(X: np.ndarray) -> np.ndarray:
    c = X - X.mean(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return c / np.sqrt((c * c).sum(1))[:, None]


def _pairs(l: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """The distances of row i of l to row i of r."""
    if metric == "manhattan":
        return np.abs(l - r).sum(-1)
    if metric == "pearson":
        lc, rc = l - l.mean(1, keepdims=True), r - r.mean(1, keepdims=True)
        return 1.0 - (lc * rc).sum(1) / (np.sqrt((lc * lc).sum(1)) * np.sqrt((rc * rc).sum(1)))
    diff = (l - r)[:, None, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))[:, 0]


def _bounded(L: np.ndarray, R: np.ndarray, metric: str, chunk: int):
    """(first row, distances of a chunk of L to R, the most they are wrong by, limit),
    ``limit`` giving how far (in the same measure, without errors) a pair may be that
    rounds to a distance or less. Euclidean and Pearson distances come from a
    matrix product, Manhattan ones from sums on a grid."""
    near = 2e-9
    grid = _grid(L, R) if metric == "manhattan" else None
    if metric == "manhattan" and grid is None:  # temporaries of rows x R.size numbers
        chunk = max(1, min(chunk, (1 << 22) // max(1, R.size)))
        for s in range(0, len(L), chunk):
            yield s, _block_dist(L[s:s + chunk], R, metric), np.float64(1e-12), lambda d: d + near
    elif metric == "manhattan":
        a, b, step = grid
        width = 1 << 12  # columns at once: sums stay in the cache
        for s in range(0, len(L), chunk):
            out = np.empty((len(L[s:s + chunk]), len(R)))
            for t in range(0, len(R), width):
                part = b[:, t:t + width]
                diff = np.empty((len(out), part.shape[1]), dtype=a.dtype)
                size = diff.view(np.dtype(f"u{a.dtype.itemsize}"))
                total = np.zeros_like(size)
                for x, y in zip(a[:, s:s + chunk], part):
                    np.subtract(x[:, None], y[None, :], out=diff)
                    np.abs(diff, out=diff)
                    total += size
                out[:, t:t + width] = total
            out *= step
            yield s, out, np.float64(step * L.shape[1] * (1 + 1e-6)), lambda d: d + near
    else:
        if metric == "pearson":
            L, R = _standard(L), _standard(R)
        square = (R * R).sum(1)
        most = square[np.isfinite(square)].max(initial=0.0)
        unit = 8 * (R.shape[1] + 8) * np.finfo(np.float64).eps
        for s in range(0, len(L), chunk):
            l = L[s:s + chunk]
            own = (l * l).sum(1)[:, None]
            d = own + square[None, :] - 2.0 * (l @ R.T)
            # half a squared distance of standardised rows is a Pearson one
            yield s, d, unit * (own + most), (lambda d: d + 2 * near) if metric == "pearson" else lambda d: (np.sqrt(np.maximum(d, 0.0)) + near) ** 2


#: rows and columns of a product in single precision
SINGLE = (256, 2048)
#: more pairs a row and k that can be among the nearest are told apart in double precision
MANY = 32


def _candidates(L: np.ndarray, R: np.ndarray, k: int, metric: str, hidden):
    """(first row, end, rows, columns) of the pairs that can be among the k nearest of R
    to each row of L, by a product in single precision with the errors it can have; no
    rows where it cannot tell. Each block of columns is held against the k-th
    smallest found so far. ``hidden(slice)`` gives excluded pairs in order of their columns."""
    rows, width = SINGLE
    if metric == "pearson":
        A, B = _standard(L), _standard(R)
    else:
        mid = R[0]
        A, B = L - mid, R - mid
    square = (B * B).sum(1)
    eps = np.finfo(np.float32).eps
    unit = 8 * (B.shape[1] + 10) * eps
    one = np.ones((len(B), 1))
    right = np.ascontiguousarray(np.hstack((B, one, square[:, None])).astype(np.float32).T)
    for s in range(0, len(L), rows):
        a = A[s:s + rows]
        own = (a * a).sum(1)
        left = np.hstack((-2.0 * a, own[:, None], np.ones((len(a), 1)))).astype(np.float32)
        err = unit * (own + square.max())
        hi, hj = hidden(slice(s, s + len(a)))
        at = np.searchsorted(hj, np.arange(0, len(B) + width, width))
        limit = np.full(len(a), np.inf)
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

        def least(i, j, d):
            """The k-th smallest of each row, and only pairs within its limit."""
            order = np.lexsort((d, i))
            i, j, d = i[order], j[order], d[order]
            begin = np.searchsorted(i, np.arange(len(a)))
            end = np.searchsorted(i, np.arange(len(a)), side="right")
            have = end - begin >= k
            kth = d[begin[have] + k - 1].astype(np.float64)
            limit[have] = np.minimum(limit[have], within(kth, err[have]))
            keep = d <= limit[i]
            return i[keep], j[keep], d[keep]

        def within(kth, err):
            kth = np.maximum(kth, 0.0) + err
            top = kth + 4e-9 if metric == "pearson" else (np.sqrt(kth) + 2e-9) ** 2
            return (top + err) * (1 + 4 * eps)

        for c, lo in enumerate(range(0, len(B), width)):
            part = left @ right[:, lo:lo + width]
            part[hi[at[c]:at[c + 1]], hj[at[c]:at[c + 1]] - lo] = np.inf
            if lo == 0 and part.shape[1] > k:
                kth = np.partition(part, k - 1, axis=1)[:, k - 1].astype(np.float64)
                limit = np.where(np.isfinite(kth), within(kth, err), np.inf)
            x, y = np.nonzero(part <= np.minimum(limit, 3e38).astype(np.float32)[:, None])
            i, j, d = np.concatenate((i, x)), np.concatenate((j, y + lo)), np.concatenate((d, part[x, y]))
            if len(i) > 4 * k * len(a):
                i, j, d = least(i, j, d)
                if len(i) > MANY * k * len(a):
                    break
        else:
            i, j, d = least(i, j, d)
            yield s, s + len(a), i, j
            continue
        yield s, s + len(a), None, None


def _excluded_knn(L: np.ndarray, R: np.ndarray, k: int, metric: str, excluded, chunk: int = 64, hidden=None):
    """(row of L, row of R, distance) of the k nearest of R to each row of L,
    distances rounded to 9 digits, ties by the row of R; ``excluded(slice)``
    marks pairs of no interest (``hidden(slice)`` gives the same pairs as rows and columns, by
    column). Distances are first bounded; only pairs that can be among the k are measured."""
    with np.errstate(invalid="ignore"):
        plain = metric != "manhattan" and len(L) and len(R) > 4 * k and (np.abs(L) < LARGE).all() and (np.abs(R) < LARGE).all()
        if plain and metric == "pearson":
            plain = all(((x - x.mean(1, keepdims=True)) ** 2).sum(1).min() > 0 for x in (L, R))
    if not plain:
        return _bounded_knn(L, R, k, metric, excluded, chunk)
    if hidden is None:
        def hidden(rows):
            j, i = np.nonzero(excluded(rows).T)
            return i, j
    found = []
    for s, end, i, j in _candidates(L, R, k, metric, hidden):
        if i is None:
            part = _bounded_knn(L[s:end], R, k, metric, lambda rows: excluded(slice(rows.start + s, min(rows.stop, end - s) + s)), chunk)
            found.append((part[0] + s, *part[1:]))
            continue
        v = np.empty(len(i))
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                v[part] = np.round(_pairs(L[s + i[part]], R[j[part]], metric), 9)
        i, j, v = (x[np.isfinite(v)] for x in (i, j, v))
        order = np.lexsort((j, v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        found.append((i[first] + s, j[first], v[first]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _bounded_knn(L: np.ndarray, R: np.ndarray, k: int, metric: str, excluded, chunk: int = 64):
    """As ``_excluded_knn``, all in double precision."""
    found = []
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        for s, d, err, limit_of in _bounded(L, R, metric, chunk):
            l = L[s:s + len(d)]
            d[excluded(slice(s, s + len(d)))] = np.inf
            limit = limit_of(np.partition(d, k - 1, axis=1)[:, k - 1:k] + err) + err
            i, j = np.nonzero((d <= limit) & np.isfinite(d) if not np.isnan(limit).any() else np.isfinite(d))
            v = np.empty(len(i))
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                v[part] = np.round(_pairs(l[i[part]], R[j[part]], metric), 9)
            order = np.lexsort((j, v, i))
            i, j, v = i[order], j[order], v[order]
            first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
            found.append((i[first] + s, j[first], v[first]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _block_knn(k: int, exclude_self: bool, exclude_same_owner: bool, metric: str = "euclidean"):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _frame([], [], [])
        L = np.stack(left["features"].to_numpy()).astype(np.float64)
        R = np.stack(right["features"].to_numpy()).astype(np.float64)
        la, rb = left["id"].to_numpy(), right["id"].to_numpy()
        # integer codes: vectorised equality instead of Python string compares
        _, codes = np.unique(np.concatenate([la, rb]).astype(str), return_inverse=True)
        lac, rbc = codes[:len(la)], codes[len(la):]
        _, ocodes = np.unique(np.concatenate([left["owner"].to_numpy(), right["owner"].to_numpy()]).astype(str),
                              return_inverse=True)
        lo, ro = ocodes[:len(la)], ocodes[len(la):]
        order_b = np.argsort(rbc, kind="stable")          # ties -> smallest id_b
        R, rb, rbc, ro = R[order_b], rb[order_b], rbc[order_b], ro[order_b]

        def excluded(rows):
            out = np.zeros((len(lac[rows]), len(rb)), dtype=bool)
            if exclude_self:
                out |= lac[rows, None] == rbc[None, :]
            if exclude_same_owner:
                out |= lo[rows, None] == ro[None, :]
            return out

        def equal(codes, others):
            order = np.argsort(others, kind="stable")
            lo, hi = (np.searchsorted(others, codes, side=x, sorter=order) for x in ("left", "right"))
            n = hi - lo
            return np.repeat(np.arange(len(codes)), n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

        def hidden(rows):
            i, j = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *(
                [equal(lac[rows], rbc)] if exclude_self else []), *([equal(lo[rows], ro)] if exclude_same_owner else [])))
            order = np.argsort(j, kind="stable")
            return i[order], j[order]

        at_a, at_b, dist = _excluded_knn(L, R, min(k, len(rb)), metric, excluded, hidden=hidden)
        return _frame(la[at_a], rb[at_b], dist)
    return fn


def _frame(a, b, d) -> pd.DataFrame:
    return pd.DataFrame({"id_a": pd.Series(a, dtype=object), "id_b": pd.Series(b, dtype=object),
                         "distance": pd.Series(d, dtype="float64")})


# --- cells ------------------------------------------------------------------------------

def _to_pivots(X: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    return np.concatenate([_block_dist(X[s:s + 64], pivots, metric) for s in range(0, len(X), 64)])


#: coordinates of at least this are not multiplied
LARGE = 1e9


class Cells:
    """Pivots and what is known of the cells around them."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        n = len(pivots)
        self.inner, self.radius = np.full(n, np.inf), np.full(n, -np.inf)
        self.reach = np.full(n, np.inf)

    def distances(self, pdf: pd.DataFrame) -> np.ndarray:
        return _to_pivots(np.stack(pdf["space"].to_numpy()).astype(np.float64), self.pivots, self.metric)

    def bounds(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least, largest possible distance to each pivot, nearest pivot) of each point.
        Euclidean distances come from a matrix product and are right within the bounds;
        the nearest pivot is measured where more than one can be it."""
        X = np.stack(pdf["space"].to_numpy()).astype(np.float64)
        plain = (np.abs(X) < LARGE).all(axis=1)
        if self.metric != "euclidean" or not (np.abs(self.pivots) < LARGE).all() or not plain.any():
            t = _to_pivots(X, self.pivots, self.metric)
            return t, t, t.argmin(axis=1)
        if not plain.all():
            low, high = np.empty((2, len(X), len(self.pivots)))
            own = np.empty(len(X), dtype=np.int64)
            for some in (plain, ~plain):
                low[some], high[some], own[some] = self.bounds(pdf[some])
            return low, high, own
        mid = self.pivots[0]
        x, p = X - mid, self.pivots - mid
        mine, square = (x * x).sum(axis=1)[:, None], (p * p).sum(axis=1)[None, :]
        d = mine + square - 2.0 * (x @ p.T)
        err = 8 * (X.shape[1] + 8) * np.finfo(np.float64).eps * (mine + square.max() + (mid * mid).sum() + (X * X).sum(axis=1)[:, None])
        low, high = np.sqrt(np.maximum(d - err, 0.0)), np.sqrt(np.maximum(d + err, 0.0))
        own = d.argmin(axis=1)
        near = low <= high[np.arange(len(own)), own][:, None]
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            some = np.flatnonzero(near[i])
            own[i] = some[_block_dist(X[i:i + 1], self.pivots[some], self.metric)[0].argmin()]
        return low, high, own

    def touched(self, t: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """Which cells (with members) a point at distances ``t`` (to ``high``) from the pivots may be near to."""
        least = np.maximum(t - self.radius, self.inner - (t if high is None else high))
        return (self.radius >= 0) & (least <= self.reach * (1 + SLACK) + SLACK)


def _space(points: DataFrame, metric: str) -> DataFrame:
    """Adds ``space``: the vector whose distances obey the triangle inequality."""
    if metric != "pearson":
        return points.withColumn("space", F.col("features"))
    n = F.size("features")
    mean = F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform("features", lambda x: x - F.col("__mean"))
    norm = F.sqrt(F.aggregate("__c", F.lit(0.0), lambda s, x: s + x * x))
    return (points.withColumn("__mean", mean).withColumn("__c", centred).withColumn("__norm", norm)
            .where("__norm > 0").withColumn("space", F.transform("__c", lambda x: x / F.col("__norm")))
            .drop("__mean", "__c", "__norm"))


def build_cells(left: DataFrame, right: DataFrame, n_right: int, k: int, excluded: int, metric: str, cell_size: int) -> Cells:
    """Pivots from ``right`` and the bounds of their cells. What reaches the
    driver is at most MAX_PIVOTS vectors, and MAX_KEPT + 2 numbers a pivot."""
    near = "manhattan" if metric == "manhattan" else "euclidean"
    n = max(1, min(MAX_PIVOTS, math.ceil(n_right / cell_size)))
    sample = (right.select("space").orderBy(F.xxhash64("id"), "id").limit(n)).collect()
    cells = Cells(np.array([r.space for r in sample], dtype=np.float64), near)
    n = len(cells.pivots)

    def extent(batches):
        inner, radius = np.full(n, np.inf), np.full(n, -np.inf)
        for pdf in batches:
            if len(pdf):
                low, high, own = cells.bounds(pdf)
                np.minimum.at(inner, own, low[np.arange(len(own)), own])
                np.maximum.at(radius, own, high[np.arange(len(own)), own])
        have = np.flatnonzero(radius >= 0)
        yield pd.DataFrame({"cell": have, "inner": inner[have], "radius": radius[have]})

    for r in (left.select("space").mapInPandas(extent, "cell int, inner double, radius double")
              .groupBy("cell").agg(F.min("inner").alias("inner"), F.max("radius").alias("radius")).collect()):
        cells.inner[r.cell], cells.radius[r.cell] = r.inner, r.radius
    keep = k + excluded
    if keep > min(MAX_KEPT, n_right):
        return cells

    def smallest(batches):
        least = np.full((keep, n), np.inf)
        for pdf in batches:
            if len(pdf):
                t = np.concatenate((least, cells.bounds(pdf)[1]))
                least = np.partition(t, keep - 1, axis=0)[:keep]
        cell, place = np.nonzero(np.isfinite(least.T))
        yield pd.DataFrame({"cell": cell, "d": least.T[cell, place]})

    kth = top_k(right.select("space").mapInPandas(smallest, "cell int, d double"), ["cell"], [F.col("d")], keep)
    for r in kth.where(F.col("rank") == keep).collect():
        cells.reach[r.cell] = cells.radius[r.cell] + r.d
    return cells


def regions(pivots: np.ndarray, size: np.ndarray, block_size: int) -> np.ndarray:
    """The region of each cell: neighbouring cells (in the order of the pivots
    along their main direction) of at most a block together. A point travels
    once to a region however many of its cells it can touch."""
    centred = pivots - pivots.mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(pivots.shape[1])
    out, now, held = np.zeros(len(pivots), dtype=np.int64), 0, 0
    for c in np.argsort(centred @ axis, kind="stable"):
        if held and held + size[c] > block_size:
            now, held = now + 1, 0
        out[c] = now
        held += size[c]
    return out


def cell_blocks(left: DataFrame, right: DataFrame, cells: Cells, block_size: int) -> tuple[DataFrame, DataFrame, int]:
    """``left`` and ``right`` with the block keys (cell, ba, bb) at which they
    meet, and the number of (point, cell) pairs that travel."""
    n = len(cells.pivots)
    schema = "id string, owner string, features array<double>, cell int, ba int, bb int"
    region = np.arange(n)  # of each cell

    def touched(low, high):
        order = np.argsort(region, kind="stable")
        return np.logical_or.reduceat(cells.touched(low, high)[:, order], np.searchsorted(region[order], np.arange(region.max() + 1)), axis=1)

    def count(side):
        def run(batches):
            total = np.zeros(region.max() + 1, dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    low, high, own = cells.bounds(pdf)
                    total += np.bincount(own, minlength=n) if side == "left" else touched(low, high).sum(axis=0)
            yield pd.DataFrame({"cell": np.arange(len(total)), "n": total})
        return run

    def sizes(df, side):
        out = np.zeros(region.max() + 1, dtype=np.int64)
        for r in df.select("space").mapInPandas(count(side), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = r.n
        return out

    n_left = sizes(left, "left")
    region = regions(cells.pivots, n_left, block_size)
    n_left = np.bincount(region, weights=n_left).astype(np.int64)
    n_right = sizes(right, "right")
    blocks_a, blocks_b = (np.maximum(1, -(-x // block_size)) for x in (n_left, n_right))

    def deal(side):
        mine, others = (blocks_a, blocks_b) if side == "left" else (blocks_b, blocks_a)

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                low, high, own = cells.bounds(pdf)
                if side == "left":
                    row = np.flatnonzero(cells.radius[own] >= 0)  # a cell without bounds meets nobody
                    cell = region[own[row]]
                else:
                    row, cell = np.nonzero(touched(low, high))
                own = pdf["h"].to_numpy()[row] % mine[cell]
                copies = others[cell]
                other = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, cell, own = (np.repeat(x, copies) for x in (row, cell, own))
                ba, bb = (own, other) if side == "left" else (other, own)
                for lo in range(0, len(row), 4096):
                    s = slice(lo, lo + 4096)
                    out = pdf[["id", "owner", "features"]].iloc[row[s]].reset_index(drop=True)
                    yield out.assign(cell=cell[s], ba=ba[s], bb=bb[s])
        return run

    numbered = lambda df: df.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return (numbered(left).mapInPandas(deal("left"), schema), numbered(right).mapInPandas(deal("right"), schema), int(n_right.sum()))


def nearest(points: DataFrame, k: int, exclude_self: bool = True, exclude_same_owner: bool = False,
            block_size: int | None = None, others: DataFrame | None = None, within: bool = False,
            metric: str = "euclidean") -> DataFrame:
    """The k nearest ``others`` (default: the same points) of every point.

    ``points``/``others``: ``(id STRING, owner STRING, features ARRAY<DOUBLE>)``.
    ``within=True`` compares points of the same owner only. ``metric``:
    euclidean, manhattan, or pearson (distance 1 - correlation). Returns
    ``(id_a, id_b, distance, rank)``; ties by ``id_b``.
    """
    from ctxrec.operators.blocks import block_apply
    from ctxrec.session import checkpoint_dir, ship_package

    checkpoint_dir(points.sparkSession)
    cols = [F.col("id").cast("string").alias("id"), F.col("owner").cast("string").alias("owner"),
            F.col("features").cast("array<double>").alias("features")]
    if within:
        knn = _block_knn(k, exclude_self, exclude_same_owner, metric=metric)
        order = [F.col("distance"), F.col("id_b")]
        # read three times (size, left blocks, right blocks): materialise once
        left = points.select(*cols).checkpoint(eager=True)
        right = left if others is None else others.select(*cols).checkpoint(eager=True)
        return top_k(block_apply(left, right, knn, _OUT, within=True, block_size=block_size or 8 * BLOCK), ["id_a"], order, k)
    ship_package(points.sparkSession)
    left = points.select(*cols).checkpoint(eager=True)
    right = left if others is None else others.select(*cols).checkpoint(eager=True)
    excluded = _most_excluded(left, right, exclude_self, exclude_same_owner)
    if excluded is not None:
        return _nearest_of_equal(left, right, k, excluded, exclude_self, exclude_same_owner, metric, block_size)
    return _nearest(left, None if others is None else right, k, exclude_self, exclude_same_owner, metric, block_size)


#: a point's answer is taken from so many more neighbours at most as it may exclude
FEW = 64


def _most_excluded(left: DataFrame, right: DataFrame, exclude_self: bool, exclude_same_owner: bool) -> int | None:
    """How many points a point may exclude, if those are few, all ids differ and all
    vectors are finite."""
    finite = F.forall("features", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    for df in (left,) if left is right else (left, right):
        n, same, plain = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce(finite, F.lit(False))).alias("f")).agg(
            F.count("id"), F.max("n"), F.every("f")).first()
        if not n or same > 1 or not plain:
            return None
    most = int(exclude_self)
    if exclude_same_owner:
        most += right.groupBy("owner").count().agg(F.max("count")).first()[0]
    return most if most <= FEW else None


def _nearest_of_equal(left: DataFrame, right: DataFrame, k: int, excluded: int, exclude_self: bool, exclude_same_owner: bool,
                      metric: str, block_size: int | None) -> DataFrame:
    """``nearest`` with points of an equal vector searched for together.

    A vector's ``k + excluded`` nearest points hold the k nearest of each point that
    has it, as no point excludes more. Of the points of one vector, all at one distance
    from any other, those after the first ``k + excluded`` ids are behind as many that
    are as near, so they are in no such list. Vectors that occur once cost a list that is
    longer by ``excluded``."""
    want = k + excluded
    vectors = left.groupBy("features").agg(F.min("id").alias("vid")).checkpoint(eager=True)  # ids differ
    first = top_k(right, ["features"], [F.col("id")], want, "__r").drop("__r").checkpoint(eager=True)
    near = _nearest(vectors.select(F.col("vid").alias("id"), F.lit("").alias("owner"), "features"), first, want, False, False, metric, block_size)
    near = near.join(first.select(F.col("id").alias("id_b"), F.col("owner").alias("owner_b")), on="id_b")
    lists = near.groupBy(F.col("id_a").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("rank", "id_b", "owner_b", "distance"))).alias("near"))
    of = left.join(vectors, on="features").select("id", "owner", "vid").join(lists, on="vid")

    def allowed(n):
        out = F.lit(True)
        if exclude_self:
            out = out & ~n["id_b"].eqNullSafe(F.col("id"))
        return out & ~n["owner_b"].eqNullSafe(F.col("owner")) if exclude_same_owner else out

    kept = F.slice(F.filter("near", allowed), 1, k)
    return of.select(F.col("id").alias("id_a"), F.posexplode(kept).alias("__p", "__n")).select(
        "id_a", "__n.id_b", "__n.distance", (F.col("__p") + 1).alias("rank"))


def _nearest(left: DataFrame, right: DataFrame | None, k: int, exclude_self: bool, exclude_same_owner: bool, metric: str,
             block_size: int | None) -> DataFrame:
    """``nearest`` of stored points, cell by cell."""
    knn = _block_knn(k, exclude_self, exclude_same_owner, metric=metric)
    order = [F.col("distance"), F.col("id_b")]
    left = _space(left, metric).checkpoint(eager=True)
    right = left if right is None else _space(right, metric).checkpoint(eager=True)
    excluded = 0
    if exclude_same_owner:
        excluded = right.groupBy("owner").count().agg(F.max("count")).first()[0] or 0
    elif exclude_self:
        excluded = right.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    n_right = right.count()
    if n_right == 0:
        return left.sparkSession.createDataFrame([], _OUT).withColumn("rank", F.lit(1))
    # few points: small blocks, for many tasks; many: large ones, for few copies of a point
    block_size = block_size or min(32 * BLOCK, max(BLOCK, n_right // 12))
    cells = build_cells(left, right, n_right, k, excluded, metric, max(64, min(block_size, BLOCK) // 2))
    a, b, _ = cell_blocks(left, right, cells, block_size)
    keys = ["cell", "ba", "bb"]
    partial = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(knn, _OUT)
    return top_k(partial, ["id_a"], order, k)


# --- all pairs ----------------------------------------------------------------------------

#: distances that a task holds at once
PAIRS = 1 << 23
#: rows of an output batch
ROWS = 1 << 16


def _ranked(left: list, D: np.ndarray, right: list):
    """Batches (id_a, id_b, distance, rank): the finite distances of each row of D in
    their order, equal ones in the order of the columns."""
    import pyarrow as pa

    ids, others = pa.array(left, pa.string()), pa.array(right, pa.string())
    step = max(1, ROWS // max(1, D.shape[1]))
    for lo in range(0, len(D), step):
        d = D[lo:lo + step]
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        row, rank = np.nonzero(np.isfinite(d))
        for at in range(0, len(row), ROWS):
            i, j = row[at:at + ROWS], rank[at:at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(i + lo)), others.take(pa.array(order[i, j])), pa.array(d[i, j]), pa.array((j + 1).astype(np.int32))],
                names=["id_a", "id_b", "distance", "rank"])


def _meet(exclude_self: bool, exclude_same_owner: bool):
    """Rows (meeting, side, n, id, owner, features), the left points of a meeting
    before its ``n`` right ones, which stream by."""
    def measured(left, R, ids, owners, D, at):
        L = left["L"]
        step = max(1, (1 << 20) // max(1, R.size))
        with np.errstate(invalid="ignore", over="ignore"):
            for s in range(0, len(L), step):
                D[s:s + step, at:at + len(R)] = np.round(_block_dist(L[s:s + step], R, "euclidean"), 9)
        part = D[:, at:at + len(R)]
        part[~np.isfinite(part)] = np.inf
        if exclude_self:
            for j, x in enumerate(ids):
                if x in left["rows"]:
                    part[left["rows"][x], j] = np.inf
        if exclude_same_owner:
            code = left["codes"]
            part[left["owner"][:, None] == np.array([code.get(x, -1) for x in owners])[None, :]] = np.inf

    def packed(rows, owners):
        codes, of_id = {}, {}
        for i, (x, _) in enumerate(rows):
            of_id.setdefault(x, []).append(i)
        return {"L": np.concatenate([f for _, f in rows]), "rows": of_id, "codes": codes,
                "owner": np.array([codes.setdefault(x, len(codes)) for x in owners])}

    def run(batches):
        now, left, owners, D, right = None, [], [], None, []
        for batch in batches:
            meeting = batch["meeting"].to_numpy(zero_copy_only=False)
            side = batch["side"].to_numpy()
            cut = np.flatnonzero((meeting[1:] != meeting[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(side))):
                if lo == hi:
                    continue
                if meeting[lo] != now:
                    if D is not None:
                        yield from _ranked([x for x, _ in left], D, right)
                    now, left, owners, D, right = meeting[lo], [], [], None, []
                part = batch.slice(lo, hi - lo)
                ids, own = part["id"].to_pylist(), part["owner"].to_pylist()
                X = part["features"].flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if side[lo] == 0:
                    left += zip(ids, X[:, None, :])
                    owners += own
                elif left:
                    if D is None:
                        held = packed(left, owners)
                        D = np.empty((len(left), int(part["n"][0].as_py())))
                    measured(held, X, ids, own, D, len(right))
                    right += ids
        if D is not None:
            yield from _ranked([x for x, _ in left], D, right)
    return run


def all_pairs(points: DataFrame, exclude_self: bool = True, exclude_same_owner: bool = False, within: bool = False,
              pairs: int = PAIRS) -> DataFrame:
    """The distance of every pair of points: ``(id_a, id_b, distance, rank)``, as
    ``nearest`` has them for its k (pairs without a finite distance are left out;
    rows of an equal id are points of their own). ``within=True`` compares points of
    the same owner only.

    The result is quadratic. Some left points and all that they meet, one batch at a
    time, make a task's work, so it holds about ``pairs`` distances, no points but the
    left ones and a batch, and ranks need no further shuffle."""
    from ctxrec.session import checkpoint_dir, ship_package

    checkpoint_dir(points.sparkSession)
    ship_package(points.sparkSession)
    pts = points.select(F.col("id").cast("string").alias("id"), F.col("owner").cast("string").alias("owner"),
                        F.col("features").cast("array<double>").alias("features")).where("features IS NOT NULL").checkpoint(eager=True)
    g = F.col("owner") if within else F.lit("")
    size = pts.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n")).where("g IS NOT NULL")
    blocks = F.ceil(F.col("n") * F.col("n") / F.lit(pairs)).cast("bigint")
    pts = pts.withColumn("g", g).withColumn("at", F.xxhash64(F.monotonically_increasing_id())).join(
        size.withColumn("blocks", F.greatest(blocks, F.least(F.lit(8), F.ceil(F.col("n") / 256)).cast("bigint"))), on="g")
    out = ["id", "owner", "features"]
    left = pts.select("g", F.pmod("at", "blocks").alias("b"), F.lit(0).alias("side"), "n", *out)
    right = pts.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b"), F.lit(1).alias("side"), "n", *out)
    rows = left.unionByName(right).withColumn("meeting", F.concat(F.col("b").cast("string"), F.lit(":"), "g"))
    rows = rows.select("meeting", "side", "n", *out).repartition("meeting").sortWithinPartitions("meeting", "side", "id")
    return rows.mapInArrow(_meet(exclude_self, exclude_same_owner), _OUT + ", rank int")


def similarity(distance_col: str = "distance"):
    return 1.0 / (1.0 + F.col(distance_col))
