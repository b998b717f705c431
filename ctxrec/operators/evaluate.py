"""Accuracy of estimated ranks against explicit labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrec.operators.features import range_positions


def rank_histogram(ranks: DataFrame, score: str = "score") -> DataFrame:
    """Count of scores rounded to the nearest integer (a one-way histogram)."""
    return (ranks.groupBy(F.round(F.col(score)).cast("int").alias("score_bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def holdout_split(ranked: DataFrame, key: str = "username", order: str = "url") -> DataFrame:
    """Positional halves of each user's ranked urls in url order: the first
    floor(n/2) are the training half (0), the rest the test half (1)."""
    pos = range_positions(ranked.select(key, order), [key], [order])
    n = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return (pos.join(n, on=key)
            .select(key, order, F.when(F.col("pos") < F.floor(F.col("__n") / 2), 0).otherwise(1)
                    .cast("int").alias("half")))


def error_metrics(pairs: DataFrame, estimated: str = "estimated", actual: str = "actual",
                  group: list[str] | None = None) -> DataFrame:
    """MAE and RMSE. ``rmse_ref`` is sqrt(sum sq)/n as the reference computes
    it; ``rmse`` is the usual sqrt(mean sq)."""
    d = F.col(estimated).cast("double") - F.col(actual).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(d)).alias("mae"),
            (F.sqrt(F.sum(d * d)) / F.count(F.lit(1))).alias("rmse_ref"),
            F.sqrt(F.avg(d * d)).alias("rmse")]
    return pairs.groupBy(*(group or [])).agg(*aggs)


def estimator_pairs(views: DataFrame, resources: DataFrame) -> DataFrame:
    """Heuristic estimates vs explicit labels on each user's rated eligible
    urls, the heuristic reading all views of those urls:
    ``(username, url, estimated, actual)``."""
    from ctxrec.operators.ranking import heuristic_scores, ranked_dataset, resource_label

    ds = ranked_dataset(views, resources)
    est = heuristic_scores(views.join(ds, on=["username", "url"], how="left_semi"))
    lab = resource_label(views)
    return (est.join(lab, on=["username", "url"])
            .select("username", "url", F.col("score").cast("double").alias("estimated"),
                    F.col("label").cast("double").alias("actual")))


def classifier_pairs(views: DataFrame, resources: DataFrame) -> DataFrame:
    """Learned ranks trained on the first half of each user's rated urls and
    scored on the second half: ``(username, url, estimated, actual)``."""
    from ctxrec.operators.ranking import rank_learned, ranked_dataset, resource_label

    split = holdout_split(ranked_dataset(views, resources))
    train = split.where(F.col("half") == 0).select("username", "url")
    test = split.where(F.col("half") == 1).select("username", "url")
    # the training half counts as rated, the test half as unrated
    lab = resource_label(views)
    hidden = views.join(test, on=["username", "url"], how="left_semi").withColumn("feedback", F.lit("none"))
    shown = views.join(test, on=["username", "url"], how="left_anti")
    pred = rank_learned(shown.unionByName(hidden), resources, train=train, test=test)
    return (pred.join(lab, on=["username", "url"])
            .select("username", "url", F.col("score").alias("estimated"),
                    F.col("label").cast("double").alias("actual")))
