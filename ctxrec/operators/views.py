"""Browser tab events -> page views (the central dataflow operator).

Semantics, per tab in (ts_ms, event_id) order:

* starters ``ready``/``activate`` (re)set the start of the open view;
* an ender ``deactivate``/``close`` with an open view emits it and resets;
  so an ender emits iff the previous starter/ender row of the tab is a starter,
  and the view's fields come from that starter;
* on ``ready``, when an earlier ``ready`` of the tab had a non-empty url, the
  open view's parent becomes that url; the parent is cleared by an emission,
  the previous url is not; ``activate`` keeps the parent;
* other event types are ignored.

Everything is expressed as "last earlier row where ..." lookups
(:func:`ctxrec.operators.sequence.carry_last`) over ``(tab_id, hour bucket)``,
so one very long tab is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrec.functions.timefns import hour_of_ms, weekday_of_ms
from ctxrec.operators.sequence import carry_last, time_bucket

# Event types that open and close a view.
STARTERS = ["ready", "activate"]
ENDERS = ["deactivate", "close"]

HOUR_MS = 3_600_000

VIEW_COLUMNS = ["view_id", "url", "username", "duration", "lat", "lon", "ts_ms",
                "daytime", "weekday", "feedback", "parent", "tab_id", "end_event_id"]


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _tab_sequence(events: DataFrame, only_unprocessed: bool, bucket_ms: int) -> DataFrame:
    ev = events
    if only_unprocessed:
        ev = ev.where(~F.coalesce(F.col("processed"), F.lit(False)))
    ev = ev.where(F.col("type").isin(*STARTERS, *ENDERS))
    ev = ev.select("event_id", "type", "url", "ts_ms", "tab_id", "username", "lat", "lon",
                   time_bucket("ts_ms", bucket_ms).alias("__bucket"))

    # Round A: previous starter/ender row, and the url of the previous ready.
    prev_row = F.struct("type", "event_id", "url", "ts_ms", "username", "lat", "lon")
    ev = carry_last(ev, ["tab_id"], ["ts_ms", "event_id"], "__bucket", {
        "__prev": (F.lit(True), prev_row),
        "__prev_ready": (F.col("type") == "ready", F.struct("url")),
    })
    ev = ev.withColumn(
        "__emit", F.col("type").isin(*ENDERS) & F.coalesce(F.col("__prev.v.type").isin(*STARTERS), F.lit(False)))
    ev = ev.withColumn(
        "__cand", F.when((F.col("type") == "ready") & _truthy(F.col("__prev_ready.v.url")),
                         F.col("__prev_ready.v.url")))

    # Round B: the last emission and the last parent candidate before each row.
    ev = carry_last(ev, ["tab_id"], ["ts_ms", "event_id"], "__bucket", {
        "__last_emit": (F.col("__emit"), F.lit(True)),
        "__last_cand": (F.col("__cand").isNotNull(), F.col("__cand")),
    })
    parent = F.when(
        F.col("__last_cand").isNotNull()
        & (F.col("__last_emit").isNull() | (F.col("__last_cand.o") > F.col("__last_emit.o"))),
        F.col("__last_cand.v"))
    return ev.withColumn("__parent", parent)


def events_to_views(events: DataFrame, only_unprocessed: bool = True,
                    bucket_ms: int = HOUR_MS) -> DataFrame:
    """Views (one per emitted starter/ender pair) with the view attributes:
    duration in whole seconds, url/user/location/time of the starter, hour and
    weekday (UTC), feedback 'none', and the parent url."""
    ev = _tab_sequence(events, only_unprocessed, bucket_ms)
    start = F.col("__prev.v")
    return ev.where("__emit").select(
        start["event_id"].alias("view_id"),
        start["url"].alias("url"),
        start["username"].alias("username"),
        F.floor((F.col("ts_ms") - start["ts_ms"]) / 1000).cast("bigint").alias("duration"),
        start["lat"].alias("lat"),
        start["lon"].alias("lon"),
        start["ts_ms"].alias("ts_ms"),
        F.lit("none").alias("feedback"),
        F.col("__parent").alias("parent"),
        F.col("tab_id"),
        F.col("event_id").alias("end_event_id"),
    ).withColumn("daytime", hour_of_ms("ts_ms")).withColumn("weekday", weekday_of_ms("ts_ms")) \
     .select(*VIEW_COLUMNS)


def mark_processed(events: DataFrame, views: DataFrame) -> DataFrame:
    """Events with ``processed`` set for both the starter and the ender of
    every view (the reference meant to mark both)."""
    used = (views.select(F.col("view_id").alias("event_id"))
            .unionByName(views.select(F.col("end_event_id").alias("event_id")))
            .withColumn("__used", F.lit(True)))
    return (events.join(used, on="event_id", how="left")
            .withColumn("processed", F.coalesce(F.col("processed"), F.lit(False)) | F.coalesce(F.col("__used"), F.lit(False)))
            .drop("__used"))


def reset_conversion(events: DataFrame) -> DataFrame:
    """Events flagged unprocessed again (views and resources start empty)."""
    return events.withColumn("processed", F.lit(False))


def resource_parents(views: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Every viewed url as a resource, with the set of its parent urls.

    New urls get the resource defaults; existing parents are kept and the new
    ones added (set union, sorted for a stable result).
    """
    from ctxrec.operators.store import upsert_resources

    new = views.groupBy("url").agg(
        F.sort_array(F.collect_set("parent")).alias("new_parents"))
    if resources is None:
        return upsert_resources(None, new.select("url")).join(new, "url") \
            .withColumn("parents", F.col("new_parents")).drop("new_parents")
    merged = upsert_resources(resources, new.select("url")).join(new, "url", "left")
    return merged.withColumn(
        "parents", F.sort_array(F.array_union(F.coalesce("parents", F.array().cast("array<string>")),
                                              F.coalesce("new_parents", F.array().cast("array<string>"))))
    ).drop("new_parents")


def previous_ready_url(events: DataFrame, bucket_ms: int = HOUR_MS) -> DataFrame:
    """For every ``ready`` event, the url of the previous ``ready`` of its tab."""
    ev = (events.where(F.col("type") == "ready")
          .select("event_id", "tab_id", "url", "ts_ms", time_bucket("ts_ms", bucket_ms).alias("__bucket")))
    ev = carry_last(ev, ["tab_id"], ["ts_ms", "event_id"], "__bucket",
                    {"__prev": (F.lit(True), F.struct("url"))})
    return ev.select("event_id", "tab_id", F.col("__prev.v.url").alias("prev_ready_url"))


def resource_parent_edges(views: DataFrame) -> DataFrame:
    """(url, parent) pairs: the scalable form of ``resources.parents``."""
    return views.where(F.col("parent").isNotNull()).select("url", "parent").distinct()


def tab_tree(spark, tabs: DataFrame, edges: DataFrame) -> DataFrame:
    """Root and depth of every tab in the tab tree. ``tabs``: ``(tab_id)``;
    ``edges``: ``(tab_id, parent_id)``.

    Pointer doubling: every tab points to an ancestor and knows its distance;
    each round it takes over its ancestor's pointer, so a chain of n tabs takes
    log2(n) rounds, whatever its depth. Tabs on a cycle, or below one, have no
    root and are left out, as are tabs whose chain leaves ``tabs``."""
    from ctxrec.session import checkpoint_dir

    checkpoint_dir(spark)
    nodes = tabs.select("tab_id").distinct()
    up = edges.select("tab_id", "parent_id").distinct()
    # root: the topmost known ancestor; done: it has no parent itself
    state = (nodes.join(up, "tab_id", "left")
             .select("tab_id", F.coalesce("parent_id", "tab_id").alias("root"),
                     F.col("parent_id").isNotNull().cast("long").alias("depth"), F.col("parent_id").isNull().alias("done"))
             .checkpoint())
    n, reach = state.count(), 1
    while reach < 2 * n and not state.where("not done").isEmpty():
        above = state.select(F.col("tab_id").alias("root"), F.col("root").alias("r"), F.col("depth").alias("d"),
                             F.col("done").alias("end"))
        state = (state.join(above, "root", "left")
                 .where(F.col("done") | F.col("r").isNotNull())
                 .select("tab_id", F.when(F.col("done"), F.col("root")).otherwise(F.col("r")).alias("root"),
                         (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.col("d"))).alias("depth"),
                         (F.col("done") | F.coalesce("end", F.lit(False))).alias("done")).distinct().checkpoint())
        reach *= 2
    return state.where("done").select("tab_id", "root", F.col("depth").cast("int").alias("depth"))
