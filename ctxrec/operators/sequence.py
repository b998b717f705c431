"""Skew-safe "previous row" lookups.

A plain ``lag`` over ``Window.partitionBy(key)`` puts every row of a key into
one task; a key holding a third of the data then runs as one straggler. Here a
key is split into time buckets: a window inside ``(key, bucket)`` answers for
every row that has an earlier match in its own bucket, and a small per-bucket
summary (one row per key and bucket) carries the last match of earlier buckets
to the rest. The summary window is partitioned by key only, but it holds one
row per bucket, not per event.

All lookups are "last row strictly before this one, in (order) order, among
rows where ``cond`` holds". They are associative (a max over an ordering
struct), which is what makes the two-level split exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
               bucket: str, specs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Add one struct column ``name`` per spec: ``struct(o, v)`` of the last
    earlier row of the same key where ``cond`` holds (``o`` = ordering struct,
    ``v`` = value), or NULL when there is none.

    ``bucket`` must be a column of ``df`` that is non-decreasing in
    ``order_cols`` within a key (e.g. ``floor(ts_ms / width)``).
    """
    keys = list(keys)
    order = F.struct(*[F.col(c) for c in order_cols])
    tagged = {name: F.when(cond, F.struct(order.alias("o"), val.alias("v")))
              for name, (cond, val) in specs.items()}

    # Level 1: inside (key, bucket). One shuffle on (keys, bucket).
    w_in = (Window.partitionBy(*keys, bucket).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, -1))
    local = df
    for name, t in tagged.items():
        local = local.withColumn(f"__in_{name}", F.last(t, ignorenulls=True).over(w_in))

    # Level 2: one row per (key, bucket) with the bucket's last match (partially
    # aggregated before its shuffle, so it ships about one row per key, bucket
    # and map task), then the last match of all earlier buckets of the key.
    summary = df.groupBy(*keys, bucket).agg(
        *[F.max(t).alias(f"__b_{name}") for name, t in tagged.items()])
    w_b = (Window.partitionBy(*keys).orderBy(bucket)
           .rowsBetween(Window.unboundedPreceding, -1))
    carried = summary.select(
        *keys, bucket,
        *[F.last(f"__b_{name}", ignorenulls=True).over(w_b).alias(f"__c_{name}")
          for name in tagged])

    out = local.join(carried, on=[*keys, bucket], how="left")
    for name in tagged:
        out = (out.withColumn(name, F.coalesce(F.col(f"__in_{name}"), F.col(f"__c_{name}")))
               .drop(f"__in_{name}", f"__c_{name}"))
    return out


def time_bucket(ts_ms: str, width_ms: int) -> Column:
    return F.floor(F.col(ts_ms) / F.lit(width_ms)).cast("bigint")
