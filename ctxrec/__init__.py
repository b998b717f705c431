"""ctxrec: browsing-behaviour analytics and context-aware recommendation on Spark.

Every public operator is a function ``DataFrame(s) -> DataFrame``; nothing is
collected to the driver except fitted model parameters and loop counters.
"""

__all__ = ["session"]
