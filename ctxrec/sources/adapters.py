"""Driver tables -> the engine's collections (events, users, tabs, resources).

They are derived from the generated test tables by the rules fixed in
FIXTURES.md, as plain projections so that scans stay pruned and pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxrec.functions.timefns import ntz_to_ms
from ctxrec.sources.tables import read_table

# Driver event types -> browser tab event types (FIXTURES.md §3).
EVENT_TYPE_MAP = {
    "view": "ready",
    "click": "activate",
    "purchase": "deactivate",
    "error": "close",
}
OTHER_EVENT_TYPE = "open"


def site_url(k: Column) -> Column:
    """Url of site k: every 17th is a facebook page, every 29th an ftp site."""
    ks = k.cast("string")
    return (F.when(k % 17 == 0, F.concat(F.lit("http://www.facebook.com/site"), ks))
            .when(k % 29 == 0, F.concat(F.lit("ftp://site"), ks, F.lit(".example.com/")))
            .otherwise(F.concat(F.lit("http://site"), ks, F.lit(".example.com/"))))


def site_key(url: Column) -> Column:
    """Inverse of :func:`site_url` (the k of a generated url)."""
    return F.regexp_extract(url, r"site([0-9]+)", 1).cast("int")


def user_key(username: Column) -> Column:
    return F.regexp_extract(username, r"^u([0-9]+)$", 1).cast("bigint")


def _event_type(col: Column) -> Column:
    expr = F.lit(OTHER_EVENT_TYPE)
    for src, dst in reversed(list(EVENT_TYPE_MAP.items())):
        expr = F.when(col == src, F.lit(dst)).otherwise(expr)
    return expr


def driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw browser tab events with the engine's event schema."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    return e.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        _event_type(F.col("event_type")).alias("type"),
        F.lit(None).cast("string").alias("title"),
        site_url(k).alias("url"),
        ntz_to_ms("ts").alias("ts_ms"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 3).cast("string")).alias("tab_id"),
        F.lit(None).cast("string").alias("browser"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        (F.lit(40) + F.col("user_id") % 10).cast("double").alias("lat"),
        (F.lit(2) + F.floor(F.hour("ts") / 6)).cast("double").alias("lon"),
        F.lit(False).alias("processed"),
    )


def driver_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", "user_id")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username")).distinct()


def driver_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab edges: each tab's parent is the next smaller tab number of its user."""
    e = read_table(spark, sf_dir, "events", "user_id", "props")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    tabs = e.select("user_id", (k % 3).alias("n")).distinct()
    edges = (tabs.withColumn("pn", F.lag("n").over(Window.partitionBy("user_id").orderBy("n")))
             .where(F.col("pn").isNotNull()))
    uid = F.col("user_id").cast("string")
    return edges.select(
        F.concat(uid, F.lit("-"), F.col("n").cast("string")).alias("tab_id"),
        F.concat(uid, F.lit("-"), F.col("pn").cast("string")).alias("parent_id"),
        F.concat(F.lit("u"), uid).alias("username"),
    )


def driver_resources(spark: SparkSession, sf_dir: str, patterns=None) -> DataFrame:
    """Downloaded resources: the text of document k is the content of site k."""
    from ctxrec.functions.urls import url_blacklisted

    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    url = site_url(F.col("doc_id"))
    return d.select(
        url.alias("url"),
        F.col("text").alias("content"),
        F.array().cast("array<string>").alias("parents"),
        F.lit(True).alias("processed"),
        F.lit(None).cast("timestamp").alias("date"),
        url_blacklisted(url, patterns).alias("blacklisted"),
        (F.coalesce(F.length("text"), F.lit(0)) >= 200).alias("textual"),
    )


def fixture_feedback_rule(username: Column, url: Column) -> Column:
    """Feedback of the fixture: a user rated site k when (user + k) % 3 == 0,
    with score (7 user + k) % 6; otherwise 'none'."""
    u, k = user_key(username), site_key(url)
    return F.when(((u + k) % 3) == 0, ((u * 7 + k) % 6).cast("string")).otherwise(F.lit("none"))


def fixture_feedback(views: DataFrame) -> DataFrame:
    """The fixture's feedback as submissions (username, url, feedback, ts_ms)."""
    keys = views.select("username", "url").distinct()
    fb = fixture_feedback_rule(F.col("username"), F.col("url"))
    return (keys.select("username", "url", fb.alias("feedback"),
                        F.lit(0).cast("bigint").alias("ts_ms"))
            .where(F.col("feedback") != "none"))


def driver_views(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """Views converted from the driver events, with the fixture feedback.

    ``only`` filters the events first. A tab belongs to one user, so a filter on
    ``username`` gives exactly that user's views and reaches the scan.

    The fixture rule is a function of (username, url), so it is applied as a
    projection rather than through ``record_feedback``'s join.
    """
    from ctxrec.operators.views import events_to_views

    events = driver_events(spark, sf_dir)
    views = events_to_views(events if only is None else events.where(only))
    return views.withColumn("feedback", fixture_feedback_rule(F.col("username"), F.col("url")))
