"""Streaming views: event-time order through state and watermark."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ctxrec.operators.views import ENDERS, STARTERS, events_to_views
from ctxrec.sources.adapters import driver_events
from ctxrec.streaming import views as V

from test_views import CASES, _events

COLUMNS = ["view_id", "url", "duration", "parent", "tab_id", "end_event_id"]


@pytest.mark.parametrize("seq,expected", CASES)
@pytest.mark.parametrize("step", [1, 2, 100])
def test_carried_row(spark, seq, expected, step):
    """The same views however the ordered events are cut into batches."""
    events = _events(spark, seq).where(F.col("type").isin(*STARTERS, *ENDERS)).toPandas()
    carried, found = V._FRESH, []
    for lo in range(0, len(events), step):
        views, carried = V.apply_events(events.iloc[lo: lo + step], carried)
        found += [(r.url, None if pd.isna(r.parent) else r.parent) for r in views.itertuples()]
    assert Counter(found) == Counter(expected)


def _run(spark, events, files, base, delay):
    rng = random.Random(4)
    parts = events.randomSplit([1.0] * files, seed=2)
    rng.shuffle(parts)
    for p in parts:  # one file each, its events in any order
        p.coalesce(1).write.mode("append").parquet(f"{base}/in")
    V.end_marker(events, delay).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    V.start_views(stream, f"{base}/out", f"{base}/check", delay_ms=delay).awaitTermination()
    return Counter(tuple(r) for r in spark.read.parquet(f"{base}/out").select(*COLUMNS).collect())


def test_shuffled_files_equal_the_batch_form(spark, tmp_path):
    events = driver_events(spark, "/root/testdata/sf0.001").checkpoint()
    want = Counter(tuple(r) for r in events_to_views(events).select(*COLUMNS).collect())
    assert len(want) > 50
    assert _run(spark, events, 3, str(tmp_path), 400 * V.DAY_MS) == want


def test_late_events_are_dropped(spark, tmp_path):
    """Events behind the watermark of the batch before theirs change nothing."""
    hour, base = 3_600_000, str(tmp_path)
    early = _events(spark, "R a, D", step=hour, start=10 * hour)
    far = _events(spark, "R b, D", tab="t2", step=hour, start=100 * hour)
    farther = _events(spark, "R c, D", tab="t3", step=hour, start=200 * hour)
    late = _events(spark, "R a, D, R late, C", step=hour, start=10 * hour).where("event_id >= 2")
    for part in (early, far, farther, late):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    V.end_marker(farther, hour).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(early.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    V.start_views(stream, f"{base}/out", f"{base}/check", delay_ms=hour).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{base}/out").collect()) == ["a", "b", "c"]


class _State:
    """A group's state outside Spark."""

    def __init__(self, watermark):
        self.watermark, self.value, self.hasTimedOut = watermark, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, at):
        self.wakes = at

    def remove(self):
        self.value = None


def test_tabs_share_a_call_and_wait_with_all_digits():
    """A call serves all tabs of its group; waiting events keep their values."""
    lat, tabs = 0.1 + 0.2, ["a", "b", None]
    row = {"username": "u", "lat": lat, "lon": float("nan")}
    batch = pd.DataFrame([{"tab_id": t, "event_id": 2 * i + e, "type": ty, "url": f"{t}", "ts_ms": 1000 * e, **row}
                          for i, t in enumerate(tabs) for e, ty in enumerate(["ready", "close"])])
    state, convert = _State(0), V._converter(10_000)
    assert list(convert((7,), iter([batch]), state)) == []
    state.watermark, state.hasTimedOut = 5_000, True
    views = pd.concat(convert((7,), iter([]), state))
    assert sorted(map(str, views["tab_id"])) == ["None", "a", "b"]
    assert views["lat"].tolist() == [lat] * 3 and views["lon"].tolist() == [None] * 3
    assert state.wakes == 11_001
    state.watermark = 20_000
    assert list(convert((7,), iter([]), state)) == [] and not state.exists
