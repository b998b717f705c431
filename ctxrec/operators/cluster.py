"""Clustering many small groups at once (one k-means per user, all users in
the same Spark jobs), plus the global and density-based variants.

Points are ``(group, key, features ARRAY<DOUBLE>)``. They are packed once into
blocks: rows that hold up to 1,024 points of one group, written to the shared
folder. Grouped Lloyd keeps the centers as one small array per group (k
structs): each round joins the blocks to their group's centers, finds every
point's nearest center in numpy and returns a sum and a count for each group,
cluster and task, which are added up. Centers of up to 1 MB are sent to the
blocks, which then stay where they are; more centers are more groups, and meet
their blocks by a shuffle, so nothing that grows reaches the driver. A round is
one job; how far the centers moved is observed while they are written.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ctxrec.operators.topk import top_k
from ctxrec.session import ship_package
from ctxrec.sources.store import materialised

BLOCK_POINTS = 1024
CHUNK_POINTS = 8192
SENT_BYTES = 1 << 20  # centers up to this size are sent to every task


def sq_dist(a: Column, b: Column) -> Column:
    """Squared euclidean distance of two equal-length double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def initial_centers(points: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The first k distinct points of each group in key order (so k is at
    most the number of distinct points)."""
    distinct = points.groupBy(group, "features").agg(F.min(key).alias("__first"))
    first = top_k(distinct, [group], [F.col("__first")], k, rank_col="__r")
    return first.select(group, (F.col("__r") - 1).cast("int").alias("cluster"),
                        F.col("features").alias("center"))


def _pack(batches):
    """Rows (group, key, features), those of a group side by side, as blocks (group, keys, features)."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0)
        same = g.slice(1).to_pylist()
        first = [0] + [i + 1 for i, (x, y) in enumerate(zip(g.to_pylist(), same)) if x != y] + [len(g)]
        cuts = [c for lo, hi in zip(first, first[1:]) for c in range(lo, hi, BLOCK_POINTS)]
        offsets = pa.array(cuts + [len(g)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [g.take(pa.array(cuts, pa.int64())), *(pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (1, 2))],
            names=["group", "keys", "features"])


def _rows_of(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow list<double> column as a matrix, a mask of what is null or absent
    (0 there), and the lists' sizes, -1 where one is null."""
    size = np.asarray(lists.value_lengths().fill_null(-1)).astype(np.int64)
    flat = lists.flatten()
    width = max(0, int(size.max())) if len(size) else 0
    X, N = np.zeros((len(size), width)), np.ones((len(size), width), dtype=bool)
    have = np.arange(width)[None, :] < size[:, None]
    X[have] = np.asarray(flat.fill_null(0.0), dtype=np.float64)
    N[have] = np.asarray(flat.is_null().to_numpy(zero_copy_only=False))
    return X, N, size


def _widen(X: np.ndarray, width: int, fill) -> np.ndarray:
    return np.pad(X, ((0, 0), (0, width - X.shape[1])), constant_values=fill)


def _round9(d: float) -> float:
    """As SQL rounds a double to 9 digits."""
    return float(Decimal(repr(d)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if d < 2.0 ** 53 else d


def _nearest(X, N, size, of, C, M, csize) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest center, squared distance, whether that is null) of each point; ``of`` names
    its row of centers ``C[row, center, component]``, whose sizes are -2 where the
    row has fewer centers. As in SQL: the components are added in order, distances
    are rounded to 9 digits and ties go to the first center; a distance of anything
    null, or of unequal sizes, is null and comes first, NaN comes last."""
    n, width = X.shape
    one = len(C) == 1
    with np.errstate(all="ignore"):
        d = np.zeros((n, C.shape[1]))
        for j in range(width):
            side = np.ascontiguousarray(C[:, :, j])
            diff = X[:, j, None] - (side if one else side[of])
            d += diff * diff
        rank = np.where(np.isnan(d), np.inf, np.minimum(d, np.finfo(float).max))
    null = np.zeros((n, 1), dtype=bool)
    if N.any() or M.any() or (size != width).any() or (csize != width).any():
        x_has = np.arange(width)[None, :] < size[:, None]
        c_has = np.arange(width)[None, None, :] < csize[:, :, None]
        null = ((N & x_has).any(axis=1)[:, None] | (M & c_has).any(axis=2)[of]
                | (size[:, None] != csize[of]) | (size < 0)[:, None])
        rank = np.where(null, -1.0, rank)
        rank[csize[of] == -2] = np.inf
        rank[(csize[of] != -2) & (rank == np.inf)] = np.finfo(float).max  # NaN, still before no center
    best = rank.argmin(axis=1)
    least = rank[np.arange(n), best]
    close = (rank > least[:, None]) & (rank <= (least + 2e-9)[:, None]) & (least >= 0)[:, None]
    for i in np.flatnonzero(close.any(axis=1)):
        some = np.flatnonzero(close[i] | (rank[i] == least[i]))
        best[i] = min((_round9(float(rank[i, c])), c) for c in some)[1]
    return best, d[np.arange(n), best], null[np.arange(n), best if null.shape[1] > 1 else 0]


def _found(batches):
    """Blocks with their centers, (group, keys, features, centers) a row, some
    thousand points at a time: (group, keys, row of each point, cluster ids a row,
    what ``_nearest`` finds for each point, components, their nulls)."""
    for batch in batches:
        columns = [batch.column(c) for c in ("group", "keys", "features", "centers")]
        points = np.asarray(columns[1].value_lengths())
        lo = 0
        while lo < len(points):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(points[lo:lo + CHUNK_POINTS]), CHUNK_POINTS, side="right")))
            group, keys, features, centers = (c.slice(lo, hi - lo) for c in columns)
            of = np.repeat(np.arange(hi - lo), points[lo:hi])
            k = np.asarray(centers.value_lengths())
            here = np.arange(k.max())[None, :] < k[:, None]
            cells = centers.flatten()
            (X, N, size), (cx, cn, cs) = _rows_of(features.flatten()), _rows_of(cells.field("center"))
            width = max(X.shape[1], cx.shape[1])
            C, M = np.zeros((*here.shape, width)), np.zeros((*here.shape, width), dtype=bool)
            csize, ids = np.full(here.shape, -2), np.zeros(here.shape, dtype=np.int32)
            C[here], M[here], csize[here], ids[here] = _widen(cx, width, 0.0), _widen(cn, width, True), cs, np.asarray(cells.field("cluster"))
            X, N = _widen(X, width, 0.0), _widen(N, width, True)
            yield group, keys.flatten(), of, ids, *_nearest(X, N, size, of, C, M, csize), X, N
            lo = hi


def _assign_fn(batches):
    import pyarrow as pa

    for group, keys, of, ids, best, dist, null, _, _ in _found(batches):
        yield pa.RecordBatch.from_arrays(
            [group.take(pa.array(of)), keys, pa.array(ids[of, best], pa.int32()), pa.array(dist, mask=null)],
            names=["group", "key", "cluster", "d"])


def _sums_fn(dims: int):
    """(group, cluster, n<j>, s<j>): the number and the sum of each component
    that is not null, for each group and cluster of some thousand points."""
    def fn(batches):
        import pyarrow as pa

        for group, _, of, ids, best, _, _, X, N in _found(batches):
            names = group.to_pylist()
            run = np.cumsum([False, *(x != y for x, y in zip(names, names[1:]))])  # blocks of a group count together
            at, cell = np.unique(run[of] * ids.shape[1] + best, return_inverse=True)
            first = np.searchsorted(run, at // ids.shape[1])
            X, N = _widen(X, max(dims, X.shape[1]), 0.0), _widen(N, max(dims, X.shape[1]), True)
            cols = [group.take(pa.array(first)), pa.array(ids[first, at % ids.shape[1]], pa.int32())]
            cols += [pa.array(np.bincount(cell, ~N[:, j], len(at)).astype(np.int64)) for j in range(dims)]
            cols += [pa.array(np.bincount(cell, X[:, j], len(at))) for j in range(dims)]
            yield pa.RecordBatch.from_arrays(
                cols, names=["group", "cluster", *(f"n{j}" for j in range(dims)), *(f"s{j}" for j in range(dims))])
    return fn


def _blocks(pts: DataFrame, group: str, key: str) -> DataFrame:
    """Stored blocks (group, keys, features) of up to ``BLOCK_POINTS`` points of
    one group; a large group lies in many of them, over many files."""
    ship_package(pts.sparkSession)
    t = {f.name: f.dataType for f in pts.schema.fields}
    schema = StructType([StructField("group", t[group]), StructField("keys", ArrayType(t[key])),
                         StructField("features", ArrayType(t["features"]))])
    by_group = pts.where(F.col(group).isNotNull()).repartitionByRange(group, key).sortWithinPartitions(group)
    return materialised(by_group.mapInArrow(_pack, schema), "kmeans-blocks")


def _with_centers(blocks: DataFrame, centers: DataFrame, group: str, small: bool) -> DataFrame:
    c = centers.select(F.col(group).alias("group"), "centers")
    return blocks.join(F.broadcast(c) if small else c.hint("merge"), on="group")


def assign(blocks: DataFrame, centers: DataFrame, group: str, key: str, small: bool) -> DataFrame:
    """(group, key, cluster, sq_dist) of every point: the nearest center (squared
    distance rounded to 9 digits, ties to the lowest cluster id). ``centers``:
    (group, centers array of (cluster, center))."""
    t = {f.name: f.dataType for f in blocks.schema.fields}
    schema = StructType([StructField("group", t["group"]), StructField("key", t["keys"].elementType),
                         StructField("cluster", IntegerType()), StructField("d", DoubleType())])
    found = _with_centers(blocks, centers, group, small).mapInArrow(_assign_fn, schema)
    return found.select(F.col("group").alias(group), F.col("key").alias(key), "cluster", F.round("d", 9).alias("sq_dist"))


def array_mean(df: DataFrame, keys: list[str], col: str, dims: int, out: str) -> DataFrame:
    """Element-wise mean of a fixed-length array column per group: one plain
    ``avg`` per dimension (hash aggregation, partial before the shuffle)."""
    aggs = [F.avg(F.col(col)[j]).alias(f"__d{j}") for j in range(dims)]
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.array(*[F.col(f"__d{j}") for j in range(dims)]).alias(out))


def update_centers(blocks: DataFrame, centers: DataFrame, group: str, dims: int, small: bool) -> DataFrame:
    """(group, centers, moved): the mean of each cluster's points (an empty
    cluster keeps its center) and the largest coordinate change of the group."""
    names = [f"{x}{j}" for x in "ns" for j in range(dims)]
    schema = StructType([StructField("group", blocks.schema["group"].dataType), StructField("cluster", IntegerType()),
                         *(StructField(c, LongType() if c[0] == "n" else DoubleType()) for c in names)])
    sums = (_with_centers(blocks, centers, group, small).mapInArrow(_sums_fn(dims), schema)
            .groupBy(F.col("group").alias(group), "cluster").agg(*[F.sum(c).alias(c) for c in names]))
    means = sums.select(group, "cluster", F.array(*[F.try_divide(f"s{j}", f"n{j}") for j in range(dims)]).alias("__mean"))
    of_group = means.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "__mean"))).alias("__means"))  # k at most
    new = F.transform("centers", lambda c: F.struct(
        c["cluster"].alias("cluster"), F.coalesce(F.element_at("__means", c["cluster"]), c["center"]).alias("center")))
    step = F.aggregate(F.zip_with("__new", "centers", lambda a, b: F.aggregate(
        F.zip_with(a["center"], b["center"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))),
        F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    return (centers.select(group, "centers").join(of_group if small else of_group.hint("merge"), on=group, how="left").withColumn("__new", new)
            .select(group, F.col("__new").alias("centers"), step.alias("moved")))


def grouped_kmeans(points: DataFrame, group: str, key: str, k: int, iterations: int = 20,
                   tol: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Lloyd's k-means inside every group, at most ``iterations`` rounds;
    stops early once no center moves by more than ``tol`` (further rounds
    would repeat the same assignment). Returns (assignments, centers):
    assignments ``(group, key, cluster, sq_dist)``, centers ``(group, cluster, center)``."""
    pts = materialised(points.select(group, key, F.col("features").cast("array<double>").alias("features")), "kmeans-points")
    first = initial_centers(pts, group, key, k).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("centers"))
    size = Observation()
    centers = materialised(first.observe(size, F.max(F.size(F.col("centers")[0]["center"])).alias("dims"),
                                         F.count(F.lit(1)).alias("groups")), "kmeans-centers")
    dims = size.get["dims"] or 0
    small = size.get["groups"] * k * (max(dims, 0) + 4) * 8 <= SENT_BYTES
    blocks = _blocks(pts, group, key)
    for _ in range(iterations if dims else 0):
        seen = Observation()
        new = update_centers(blocks, centers, group, dims, small)
        centers = materialised(new.observe(seen, F.max("moved").alias("moved")), "kmeans-centers")
        if (seen.get["moved"] or 0.0) <= tol:
            break
    return (assign(blocks, centers, group, key, small),
            centers.select(group, F.explode("centers").alias("c")).select(group, "c.cluster", "c.center"))


def cluster_distribution(assignments: DataFrame, group: str) -> DataFrame:
    """Members per cluster and their share of the group (pie chart data)."""
    from pyspark.sql import Window

    counts = assignments.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("share", share)


def global_kmeans(points: DataFrame, k: int, seed: int = 1, max_iter: int = 20):
    """One KMeans over all points (Spark ML); returns (model, assignments)."""
    from pyspark.ml.clustering import KMeans

    data = points.withColumn("__v", array_to_vector(F.col("features").cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="cluster").fit(data)
    return model, model.transform(data).drop("__v")
