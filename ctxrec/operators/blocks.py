"""Block-pair computations over point sets.

Several operators need, for every point, something about *all* other points
(its nearest ones, the mean of those within a radius, how many lie closer
than a threshold). Emitting all pairs as rows is quadratic in output; here
points are hashed into blocks of bounded size and every (left block, right
block) pair is one cogroup task in which numpy computes the block's answer
and returns one small row per left point. With ``within`` set, blocks are
formed per owner (a user's points are only compared with that user's), and
an owner with many points simply gets more blocks, so a hot owner is spread
over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PointFrame = pd.DataFrame


def _with_blocks(points: DataFrame, mine, others, side: str) -> DataFrame:
    own = F.pmod(F.xxhash64("id"), mine).cast("bigint")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), (others - 1).cast("bigint")))
    ba, bb = (own, every) if side == "left" else (every, own)
    return points.select("*", ba.alias("ba"), bb.alias("bb"))


def block_apply(left: DataFrame, right: DataFrame, fn: Callable[[PointFrame, PointFrame], pd.DataFrame],
                schema: str, within: bool = False, block_size: int = 1024) -> DataFrame:
    """Run ``fn(left_block, right_block)`` for every pair of blocks.

    ``left``/``right`` have at least ``id STRING, owner STRING`` (plus what
    ``fn`` reads). With ``within=True`` only blocks of the same owner meet.
    The number of blocks of a side comes from its size (per owner when
    ``within``), so each task holds at most about ``block_size`` points per side.
    """
    from ctxrec.session import ship_package

    ship_package(left.sparkSession)
    keys = ["ba", "bb"]
    # fresh attribute ids on the right: left and right may be the same plan
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    if within:
        def blocks(df, name):
            n = df.groupBy("owner").agg(F.count(F.lit(1)).alias("__n"))
            return n.select("owner", F.ceil(F.col("__n") / block_size).cast("bigint").alias(name))

        nb = blocks(left, "__na").join(blocks(right, "__nb"), on="owner")
        lft = _with_blocks(left.join(nb, on="owner"), F.col("__na"), F.col("__nb"), "left").drop("__na", "__nb")
        rgt = _with_blocks(right.join(nb, on="owner"), F.col("__nb"), F.col("__na"), "right").drop("__na", "__nb")
        keys = ["owner", "ba", "bb"]
    else:
        na, nb = (F.lit(max(1, math.ceil(df.count() / block_size))).cast("bigint") for df in (left, right))
        lft = _with_blocks(left, na, nb, "left")
        rgt = _with_blocks(right, nb, na, "right")
    return lft.groupBy(*keys).cogroup(rgt.groupBy(*keys)).applyInPandas(fn, schema)
