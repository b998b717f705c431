"""Print the formatted physical plan of operators, for plan review.

usage: python tools/explain.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from ctxrec.operators import features, ranking, views  # noqa: E402
from ctxrec.session import build_session  # noqa: E402
from ctxrec.sources import adapters  # noqa: E402

PLANS = {
    "events_to_views": lambda s, sf: views.events_to_views(adapters.driver_events(s, sf)),
    "rank_heuristic": lambda s, sf: ranking.rank_heuristic(
        views.events_to_views(adapters.driver_events(s, sf)).withColumn(
            "feedback", adapters.fixture_feedback_rule(F.col("username"), F.col("url")))),
    "recent_activity": lambda s, sf: features.recent_activity(views.events_to_views(adapters.driver_events(s, sf))),
}


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    names = [a for a in args if not os.path.isdir(a)] or list(PLANS)
    spark = build_session()
    for n in names:
        print(f"===== {n}")
        PLANS[n](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
