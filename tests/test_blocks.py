"""Sizes of the blocks that meet in a task."""

import numpy as np
import pandas as pd

from ctxrec.operators.blocks import block_apply


def test_many_points_against_few_are_cut_into_blocks(spark):
    rows = [(f"p{i}", "a") for i in range(200)]
    points = spark.createDataFrame(rows, "id string, owner string")

    def sizes(left, right):
        return pd.DataFrame({"a": [len(left)], "b": [len(right)]})

    for within in (True, False):
        met = block_apply(points, points.where("id in ('p0', 'p1')"), sizes, "a int, b int", within=within, block_size=20).collect()
        assert max(r.a for r in met) < 60  # was all 200
        assert sum(r.a * r.b for r in met) == 400


def test_equal_distances_are_handed_on_once():
    from ctxrec.operators.density import _value_fn

    right = pd.DataFrame({"id": [str(i) for i in range(500)], "owner": "a", "features": [np.zeros(3)] * 300 + [np.ones(3)] * 200})
    left = pd.DataFrame({"id": ["0"], "owner": ["a"], "features": [np.zeros(3)], "m": [np.array([7])], "lo": [np.array([0.0])], "hi": [np.array([9.0])]})
    out = _value_fn(left, right).iloc[0]
    assert out["below"] == 0 and list(out["cnt"]) == [300, 200] and np.allclose(out["d"], [0.0, np.sqrt(3)])
