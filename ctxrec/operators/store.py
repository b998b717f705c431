"""Writes to the collections, as DataFrame -> DataFrame transformations.

Each function returns the new state of a table; persisting it is a
``write.mode(...)`` by the caller (see ``ctxrec.sources.store``). Keys are
matched with joins (semi, anti, left), never with driver-side key lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _empty_strings():
    return F.array().cast("array<string>")


def resource_defaults(urls: DataFrame) -> DataFrame:
    """New resources for the given urls: unprocessed, not blacklisted, not
    textual, no content, no parents, date = now."""
    return urls.select(
        "url",
        F.lit(None).cast("string").alias("content"),
        _empty_strings().alias("parents"),
        F.lit(False).alias("processed"),
        F.current_timestamp().alias("date"),
        F.lit(False).alias("blacklisted"),
        F.lit(False).alias("textual"),
    )


def upsert_resources(resources: DataFrame | None, urls: DataFrame) -> DataFrame:
    """Get-or-create by url: existing resources as they are, plus a default
    resource for every url not present yet."""
    wanted = urls.select("url").where(F.col("url").isNotNull()).distinct()
    if resources is None:
        return resource_defaults(wanted)
    new = wanted.join(resources.select("url"), on="url", how="left_anti")
    return resources.unionByName(resource_defaults(new))


def record_feedback(views: DataFrame, submissions: DataFrame) -> DataFrame:
    """Set ``feedback`` on all views of each submitted (username, url); when a
    key was submitted more than once, the latest submission wins."""
    latest = (submissions.groupBy("username", "url")
              .agg(F.max_by("feedback", F.struct("ts_ms", "feedback")).alias("__fb")))
    return (views.join(latest, on=["username", "url"], how="left")
            .withColumn("feedback", F.coalesce(F.col("__fb"), F.col("feedback")))
            .drop("__fb"))


def feedback_worklist(views: DataFrame, resources: DataFrame) -> DataFrame:
    """Per user, distinct urls still without feedback whose resource exists
    and is not blacklisted (the page a user is asked to rate)."""
    pending = views.where(F.col("feedback") == "none").select("username", "url").distinct()
    ok = resources.where(~F.col("blacklisted")).select("url")
    return pending.join(ok, on="url", how="left_semi")


def register_users(existing: DataFrame, requested: DataFrame) -> DataFrame:
    """Users to insert: requested usernames not taken yet (one per name)."""
    return (requested.select("username").where(F.col("username").isNotNull()).distinct()
            .join(existing.select("username"), on="username", how="left_anti"))


def ingest_events(raw: DataFrame) -> DataFrame:
    """Raw posted events -> event rows: fields copied as they are, location
    split into lat/lon, browser and processed left unset."""
    return raw.select(
        F.col("event_id").cast("bigint"),
        F.col("type").cast("string"),
        F.col("title").cast("string"),
        F.col("url").cast("string"),
        F.col("timestamp").cast("bigint").alias("ts_ms"),
        F.col("tab_id").cast("string"),
        F.lit(None).cast("string").alias("browser"),
        F.col("username").cast("string"),
        F.col("lat").cast("double"),
        F.col("long").cast("double").alias("lon"),
        F.lit(None).cast("boolean").alias("processed"),
    )


def ingest_tab_relations(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("tab_id").cast("string"), F.col("parent_id").cast("string"),
                      F.col("username").cast("string"))


def reset_downloads(resources: DataFrame) -> DataFrame:
    """Resources ready to be fetched again (``textual`` is left as it is)."""
    return (resources.withColumn("processed", F.lit(False))
            .withColumn("blacklisted", F.lit(False))
            .withColumn("content", F.lit(None).cast("string")))


def clean_users(users: DataFrame, views: DataFrame) -> DataFrame:
    """Users that have at least one view (the others are deleted)."""
    return users.join(views.select("username"), on="username", how="left_semi")


def purge_user(tables: dict[str, DataFrame], username: str) -> dict[str, DataFrame]:
    """Every per-user table without the user's rows (account deletion)."""
    return {name: df.where(F.col("username") != username) for name, df in tables.items()}


def export_user(views: DataFrame, username: str) -> DataFrame:
    """A user's own views (data export)."""
    return views.where(F.col("username") == username)
