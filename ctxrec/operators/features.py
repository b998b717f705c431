"""Context features of views and of (user, url) pairs.

All of them are grouped aggregates or "previous row" lookups; none collects a
group's rows. Per-key ordering uses :func:`carry_last` over time buckets so a
hot user or url is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxrec.operators.sequence import carry_last, time_bucket

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

# The per-(user, url) statistics, in the order of the feature row.
INDICATORS = ["average", "mean", "median", "var", "std"]
CONTEXT_SERIES = ["daytime", "weekday", "location_changed"]


def views_features(views: DataFrame) -> DataFrame:
    """One row per view: lat, lon, duration, hour, four-hour day part, weekday."""
    return views.select(
        "view_id", "username", "url",
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        F.col("duration").cast("bigint").alias("duration"),
        F.col("daytime").cast("int").alias("daytime"),
        F.floor(F.col("daytime") / 4).cast("int").alias("day_part"),
        F.col("weekday").cast("int").alias("weekday"),
    )


VIEW_FEATURE_COLUMNS = ["lat", "lon", "duration", "daytime", "day_part", "weekday"]


def location_changed(views: DataFrame, bucket_ms: int = DAY_MS) -> DataFrame:
    """Adds ``location_changed``: the location differs from the previous view
    of the same (user, url) in (ts_ms, view_id) order; False for the first."""
    v = views.withColumn("__bucket", time_bucket("ts_ms", bucket_ms))
    v = carry_last(v, ["username", "url"], ["ts_ms", "view_id"], "__bucket", {
        "__prev_loc": (F.lit(True), F.struct("lat", "lon")),
    })
    prev = F.col("__prev_loc.v")
    same = prev["lat"].eqNullSafe(F.col("lat")) & prev["lon"].eqNullSafe(F.col("lon"))
    changed = F.when(F.col("__prev_loc").isNull(), F.lit(False)).otherwise(~same)
    return v.withColumn("location_changed", changed).drop("__bucket", "__prev_loc")


def _stat(ind: str, c: Column) -> Column:
    if ind in ("average", "mean"):
        return F.avg(c)
    if ind == "median":
        return F.median(c)
    if ind == "var":
        return F.var_pop(c)
    return F.stddev_pop(c)


def context_features(views: DataFrame, with_location: bool = True) -> DataFrame:
    """Per (username, url): n views, total duration, then each indicator over
    daytime, weekday (and location_changed), in that order (17 or 12 values).
    Variances are population variances."""
    series = CONTEXT_SERIES if with_location else CONTEXT_SERIES[:2]
    v = location_changed(views) if with_location else views
    v = v.withColumn("location_changed", F.col("location_changed").cast("double")) if with_location else v
    aggs = [F.count(F.lit(1)).alias("n_views"), F.sum("duration").alias("total_duration")]
    for ind in INDICATORS:
        for s in series:
            aggs.append(_stat(ind, F.col(s).cast("double")).alias(f"{ind}_{s}"))
    return v.groupBy("username", "url").agg(*aggs)


def context_feature_columns(with_location: bool = True) -> list[str]:
    series = CONTEXT_SERIES if with_location else CONTEXT_SERIES[:2]
    return ["n_views", "total_duration"] + [f"{i}_{s}" for i in INDICATORS for s in series]


def context_row_mean(features: DataFrame, with_location: bool = True) -> DataFrame:
    cols = context_feature_columns(with_location)
    total = sum((F.col(c).cast("double") for c in cols[1:]), F.col(cols[0]).cast("double"))
    return features.select("username", "url", (total / len(cols)).alias("row_mean"))


def recent_activity(views: DataFrame, shifts=(1, 2, 3, 4, 5), bucket_ms: int = DAY_MS) -> DataFrame:
    """Per view, for each shift s (hours): did the same user have a view in
    the open interval (t - s h, t)? Equivalent to: the user's latest view
    strictly before t is later than t - s h. That latest time is a running max
    inside (user, day bucket) plus a carried max of earlier buckets."""
    v = views.select("view_id", "username", "ts_ms").withColumn("__b", time_bucket("ts_ms", bucket_ms))
    w_in = (Window.partitionBy("username", "__b").orderBy("ts_ms")
            .rangeBetween(Window.unboundedPreceding, -1))
    local = v.withColumn("__prev_in", F.max("ts_ms").over(w_in))
    summary = v.groupBy("username", "__b").agg(F.max("ts_ms").alias("__bmax"))
    w_b = Window.partitionBy("username").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("username", "__b", F.max("__bmax").over(w_b).alias("__prev_b"))
    j = local.join(carried, on=["username", "__b"], how="left")
    prev = F.coalesce(F.col("__prev_in"), F.col("__prev_b"))
    out = [F.coalesce(prev > F.col("ts_ms") - F.lit(s * HOUR_MS), F.lit(False)).alias(f"active_{s}h")
           for s in shifts]
    return j.select("view_id", "username", "ts_ms", *out)


def positions(df: DataFrame, keys, order_cols, bucket: str) -> DataFrame:
    """0-based position of each row inside its key in ``order_cols`` order.

    ``bucket`` must be non-decreasing in the order within a key (a time bucket,
    or a range-partition id). Position = rank inside (key, bucket) + number
    of the key's rows in earlier buckets, so no window holds a whole key.
    """
    keys = list(keys)
    w_in = Window.partitionBy(*keys, bucket).orderBy(*order_cols)
    local = df.withColumn("__pos_in", F.row_number().over(w_in) - 1)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__cnt"))
    w_b = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("__cnt").over(w_b), F.lit(0)).alias("__off"))
    return (local.join(offsets, on=[*keys, bucket], how="left")
            .withColumn("pos", (F.col("__pos_in") + F.col("__off")).cast("bigint"))
            .drop("__pos_in", "__off"))


def range_buckets(df: DataFrame, keys, order_cols, n_parts: int | None = None,
                  bucket: str = "__rp") -> DataFrame:
    """Rows range-partitioned by (keys, order) with the partition id as a
    bucket that is non-decreasing in the order within a key. Range bounds are
    sampled per shuffle, so the bucketed rows are checkpointed (to the shared
    checkpoint folder) before several branches read them."""
    from ctxrec.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *keys, *order_cols)
            .withColumn(bucket, F.spark_partition_id())
            .checkpoint(eager=True))


def range_positions(df: DataFrame, keys, order_cols, n_parts: int | None = None) -> DataFrame:
    """:func:`positions` when the order is not a time: a large key spans
    several range partitions, whose ids serve as buckets."""
    keys = list(keys)
    ranged = range_buckets(df, keys, order_cols, n_parts)
    return positions(ranged, keys, order_cols, "__rp").drop("__rp")
