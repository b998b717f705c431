"""Rank visited urls 0..5: explicit feedback, a learned classifier per user, or
a heuristic on view counts and durations.

All users are ranked at once; per-user averages are a grouped aggregate
joined back on ``username`` (one row per user, so AQE may broadcast it and
its skew handling splits a hot user's side of the join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eligible_resources(resources: DataFrame) -> DataFrame:
    return resources.where(~F.col("blacklisted") & F.col("processed"))


def ranked_views(views: DataFrame) -> DataFrame:
    return views.where(F.col("feedback").isNotNull() & (F.col("feedback") != "none"))


def unranked_views(views: DataFrame) -> DataFrame:
    return views.where(F.col("feedback") == "none")


def ranked_dataset(views: DataFrame, resources: DataFrame) -> DataFrame:
    """(username, url) with explicit feedback and an eligible resource."""
    keys = ranked_views(views).select("username", "url").distinct()
    return keys.join(eligible_resources(resources).select("url"), on="url", how="left_semi")


def unranked_dataset(views: DataFrame, resources: DataFrame) -> DataFrame:
    keys = unranked_views(views).select("username", "url").distinct()
    return keys.join(eligible_resources(resources).select("url"), on="url", how="left_semi")


def first_view_per_resource(views: DataFrame) -> DataFrame:
    """One view per (username, url): the earliest by (ts_ms, view_id).

    A grouped ``min_by`` (partially aggregated before the shuffle) rather than
    a ``row_number`` window, so a hot (user, url) does not become one task.
    """
    cols = [c for c in views.columns if c not in ("username", "url")]
    first = views.groupBy("username", "url").agg(
        F.min_by(F.struct(*cols), F.struct("ts_ms", "view_id")).alias("__v"))
    return first.select("username", "url", *[F.col(f"__v.{c}").alias(c) for c in cols])


def resource_label(views: DataFrame) -> DataFrame:
    """Explicit rank of each rated (username, url): the feedback of its
    earliest rated view, as an int."""
    return (ranked_views(views).groupBy("username", "url")
            .agg(F.min_by(F.col("feedback").cast("int"), F.struct("ts_ms", "view_id")).alias("label")))


def rank_explicit(views: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    labels = resource_label(views)
    if resources is not None:
        labels = labels.join(eligible_resources(resources).select("url"), on="url", how="left_semi")
    return labels.select("username", "url", F.col("label").cast("double").alias("score"),
                         F.lit("explicit").alias("source"))


def heuristic_scores(views: DataFrame) -> DataFrame:
    """Score = [n > avg n] + [n > 3 avg n] + [d > avg d] + 2 [d > 3 avg d]
    over the given views: n views and mean duration d per (user, url), avg n
    over the user's urls, avg d over the user's views."""
    per_url = views.groupBy("username", "url").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration").alias("d"),
        F.sum("duration").alias("__sd"))
    per_user = per_url.groupBy("username").agg(
        F.avg("n").alias("an"), (F.sum("__sd") / F.sum("n")).alias("ad"))
    j = per_url.join(per_user, on="username")
    score = (F.when(F.col("n") > F.col("an"), 1).otherwise(0)
             + F.when(F.col("n") > 3 * F.col("an"), 1).otherwise(0)
             + F.when(F.col("d") > F.col("ad"), 1).otherwise(0)
             + F.when(F.col("d") > 3 * F.col("ad"), 2).otherwise(0))
    return j.select("username", "url", score.cast("int").alias("score"))


def rank_heuristic(views: DataFrame, first_view_only: bool = False) -> DataFrame:
    """Heuristic scores over a user's views without feedback (users with no
    such view get none). ``first_view_only`` reproduces the reference's
    one-view-per-url reading."""
    v = unranked_views(views)
    if first_view_only:
        v = first_view_per_resource(v)
    return heuristic_scores(v)


def rank_constant(views: DataFrame, resources: DataFrame, value: float = 2.5) -> DataFrame:
    """The older fallback: every unranked eligible url gets a fixed score."""
    return unranked_dataset(views, resources).select(
        "username", "url", F.lit(value).cast("double").alias("score"))


def user_averages(views: DataFrame) -> DataFrame:
    """Per user: mean duration over views without feedback, and mean views per url."""
    v = unranked_views(views)
    per_url = v.groupBy("username", "url").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("sd"))
    return per_url.groupBy("username").agg(
        (F.sum("sd") / F.sum("n")).alias("avg_duration"),
        F.avg("n").alias("avg_views_per_url"))


def merge_rankings(*rankings: DataFrame) -> DataFrame:
    """Union of rankings where an earlier argument wins for the same
    (username, url) (the reference's dict update order, reversed)."""
    parts = [r.select("username", "url", F.col("score").cast("double").alias("score"), "source")
             .withColumn("__prec", F.lit(i)) for i, r in enumerate(rankings)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    best = u.groupBy("username", "url").agg(
        F.min_by(F.struct("score", "source"), "__prec").alias("__b"))
    return best.select("username", "url", "__b.score", "__b.source")


LEARN_FEATURES = ["lat", "lon", "duration", "daytime", "day_part", "weekday"]


def learned_dataset(views: DataFrame, resources: DataFrame) -> DataFrame:
    """Users with both rated and unrated eligible urls: one row per such
    (user, url) with the first view's features, standardised within the user,
    and the explicit ``label`` (NULL when unrated)."""
    from ctxrec.operators.features import views_features
    from ctxrec.operators.svm import standardised

    ranked = ranked_dataset(views, resources).withColumn("__r", F.lit(True))
    unranked = unranked_dataset(views, resources).join(
        ranked.select("username", "url"), on=["username", "url"], how="left_anti").withColumn("__r", F.lit(False))
    items = ranked.unionByName(unranked)
    users = (items.groupBy("username").agg(F.max(F.col("__r").cast("int")).alias("__hr"),
                                           F.min(F.col("__r").cast("int")).alias("__lr"))
             .where((F.col("__hr") == 1) & (F.col("__lr") == 0)).select("username"))
    items = items.join(users, on="username", how="left_semi")
    first = views_features(first_view_per_resource(views.join(items, on=["username", "url"], how="left_semi")))
    scaled = standardised(first.select("username", "url", *LEARN_FEATURES), "username", LEARN_FEATURES)
    labels = resource_label(views)
    return (scaled.join(items, on=["username", "url"])
            .join(labels, on=["username", "url"], how="left")
            .withColumn("label", F.when(F.col("__r"), F.col("label")))
            .drop("__r"))


def rank_learned(views: DataFrame, resources: DataFrame, train: DataFrame | None = None,
                 test: DataFrame | None = None) -> DataFrame:
    """Predicted ranks of unrated urls: each user's own linear SVM, trained on
    the user's rated urls, all users in the same rounds (:mod:`ctxrec.operators.svm`).

    ``train``/``test`` (``username, url``) restrict the rated rows used for
    fitting and the rows predicted (for hold-out evaluation)."""
    from ctxrec.operators import svm
    from ctxrec.session import checkpoint_dir

    checkpoint_dir(views.sparkSession)
    # fitted and predicted rows both come from here: cut the lineage once
    data = learned_dataset(views, resources).checkpoint(eager=True)
    fit_rows, rows = data.where(F.col("label").isNotNull()), data.where(F.col("label").isNull())
    if train is not None:
        fit_rows = fit_rows.join(train, on=["username", "url"], how="left_semi")
        rows = data.join(test, on=["username", "url"], how="left_semi")
    models = svm.fit(fit_rows, "username", "label", LEARN_FEATURES)
    return (svm.predict(rows.drop("label"), models, "username", "label", LEARN_FEATURES)
            .select("username", "url", F.col("predicted").cast("double").alias("score"), F.lit("learned").alias("source")))


def rankings(views: DataFrame, resources: DataFrame, learned: bool = True) -> DataFrame:
    """All ranks: explicit, then learned (users with rated and unrated urls),
    then heuristic (everyone else's unrated urls)."""
    explicit = rank_explicit(views, resources)
    heur = rank_heuristic(views).withColumn("source", F.lit("heuristic"))
    if not learned:
        return merge_rankings(explicit, heur)
    lr = rank_learned(views, resources)
    learners = lr.select("username").distinct()
    heur = heur.join(learners, on="username", how="left_anti")
    return merge_rankings(explicit, lr, heur)
