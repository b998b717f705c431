"""Streaming event -> view conversion, ordered by event time.

Micro-batches may bring a tab's events in any order. The state (one for a
bucket of tabs) holds of each tab the events that the watermark has not passed
yet, and a small carried row; once the watermark passes events, they are applied
in (ts_ms, event_id) order (the same "previous row" rules as the batch operator
:func:`ctxrec.operators.views.events_to_views`). So the views equal the batch
form's for every order of arrival within ``delay_ms``; events behind the
watermark of the batch before theirs are late and dropped by Spark. A tab without events for ``idle_ms`` (event
time) gives up its state.

A bounded run ends with an :func:`end_marker` row, which moves the watermark
past every real event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ctxrec.functions.timefns import hour_of_ms, weekday_of_ms
from ctxrec.operators.views import ENDERS, STARTERS

OUT_SCHEMA = ("view_id long, url string, username string, duration long, lat double, lon double, "
              "ts_ms long, parent string, tab_id string, end_event_id long")
STATE_SCHEMA = "tabs string"  # [tab, waiting events, carried row] of each tab
FIELDS = ["event_id", "type", "url", "ts_ms", "username", "lat", "lon"]
DAY_MS = 86_400_000
DEFAULT_DELAY_MS = 3_600_000
DEFAULT_IDLE_MS = 30 * DAY_MS
MARKER_TAB = "__end_of_input__"
#: groups of tabs that share a state (a call costs milliseconds, however few its events)
TAB_BUCKETS = 4096

#: the row before a tab's first event
_FRESH = {"row": dict.fromkeys(FIELDS), "ready_url": None, "parent": None}
_TYPE, _URL, _TS = (FIELDS.index(c) for c in ("type", "url", "ts_ms"))
VIEW_COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


def _rows(events: pd.DataFrame) -> list[tuple]:
    """The events' ``FIELDS`` as plain tuples, missing values as None."""
    return list(zip(*([None if v is None or v != v else v for v in events[c].tolist()] for c in FIELDS)))


def _apply(ordered: list[tuple], carried: dict, tab: str | None = None) -> tuple[list[tuple], dict]:
    """Views (``VIEW_COLUMNS``) that the ordered events of one tab close, and
    the row to carry on: a few steps an event, as a tab has few in a batch."""
    previous = tuple(carried["row"][c] for c in FIELDS)
    ready_url, parent, views = carried["ready_url"], carried["parent"], []
    for row in ordered:
        if row[_TYPE] == "ready":
            parent = ready_url or parent
            ready_url = row[_URL] or ""
        elif row[_TYPE] in ENDERS and previous[_TYPE] in STARTERS:
            event_id, _, url, ts_ms, username, lat, lon = previous
            views.append((event_id, url, username, (row[_TS] - ts_ms) // 1000, lat, lon, ts_ms, parent, tab, row[0]))
            parent = None
        previous = row
    return views, {"row": dict(zip(FIELDS, previous)), "ready_url": ready_url, "parent": parent}


def apply_events(ordered: pd.DataFrame, carried: dict) -> tuple[pd.DataFrame, dict]:
    """Views that the ordered events of one tab close, and the row to carry on.

    The carried row stands in front of the events: its type and fields answer
    for "the previous row", ``ready_url`` for "the url of the previous ready",
    ``parent`` for the parent found since the last emitted view."""
    views, carried = _apply(_rows(ordered), carried)
    return pd.DataFrame(views, columns=VIEW_COLUMNS, dtype=object), carried


def _converter(idle_ms: int):
    def convert(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tabs = {tab: ([tuple(e) for e in waiting], carried)
                for tab, waiting, carried in json.loads(state.get[0] if state.exists else "[]")}
        if not state.hasTimedOut:
            for b in batches:
                for tab, event in zip(b["tab_id"].tolist(), _rows(b)):
                    tabs.setdefault(tab, ([], _FRESH))[0].append(event)
        passed = state.getCurrentWatermarkMs()
        kept, views, wake = [], [], None
        for tab, (events, carried) in tabs.items():
            rest = [e for e in events if e[_TS] >= passed]
            if len(rest) < len(events):
                due = sorted((e for e in events if e[_TS] < passed), key=lambda e: (e[_TS], e[0] is None, e[0] or 0))
                found, carried = _apply(due, carried, tab)
                views += found
            if rest:
                at = min(e[_TS] for e in rest)
            else:
                at = carried["row"]["ts_ms"]
                if at is None or at + idle_ms < passed:
                    continue
                at += idle_ms
            kept.append((tab, rest, carried))
            wake = at + 1 if wake is None else min(wake, at + 1)
        if views:
            yield pd.DataFrame(views, columns=VIEW_COLUMNS, dtype=object)
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(wake, passed + 1))
        elif state.exists:
            state.remove()
    return convert


def stream_views(events: DataFrame, delay_ms: int = DEFAULT_DELAY_MS, idle_ms: int = DEFAULT_IDLE_MS,
                 buckets: int = TAB_BUCKETS) -> DataFrame:
    """Streaming events (engine schema) -> streaming views."""
    from ctxrec.session import ship_package

    ship_package(events.sparkSession)
    ev = (events.where(F.col("type").isin(*STARTERS, *ENDERS)).withColumn("__et", F.timestamp_millis("ts_ms"))
          .withWatermark("__et", f"{delay_ms} milliseconds").select("tab_id", *FIELDS, "__et")
          .withColumn("__bucket", F.pmod(F.xxhash64("tab_id"), F.lit(buckets))))
    views = ev.groupBy("__bucket").applyInPandasWithState(
        _converter(idle_ms), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return (views.withColumn("daytime", hour_of_ms("ts_ms")).withColumn("weekday", weekday_of_ms("ts_ms"))
            .withColumn("feedback", F.lit("none")))


def end_marker(events: DataFrame, delay_ms: int = DEFAULT_DELAY_MS) -> DataFrame:
    """One row of the events' schema, for a tab of its own, late enough to move
    the watermark past all of ``events``; it opens a view that nothing closes."""
    last = events.agg((F.coalesce(F.max("ts_ms"), F.lit(0)) + F.lit(delay_ms) + DAY_MS).alias("ts_ms"))
    known = {"type": F.lit(STARTERS[1]), "ts_ms": F.col("ts_ms"), "tab_id": F.lit(MARKER_TAB), "event_id": F.lit(-1)}
    return last.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields))


def start_views(events: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
                delay_ms: int = DEFAULT_DELAY_MS, idle_ms: int = DEFAULT_IDLE_MS) -> StreamingQuery:
    w = (stream_views(events, delay_ms, idle_ms).writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
