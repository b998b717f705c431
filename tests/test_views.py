"""Event -> view conversion: hand-written tab sequences, and equality with the
SQL specification on generated events."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ctxrec.operators.views import events_to_views
from ctxrec.plans.oracle import ORACLE
from ctxrec.sources.adapters import driver_events

SCHEMA = ("event_id bigint, type string, title string, url string, ts_ms bigint, tab_id string, "
          "browser string, username string, lat double, lon double, processed boolean")

CODES = {"R": "ready", "A": "activate", "D": "deactivate", "C": "close", "O": "open"}

# (sequence, expected views as (url, parent)); see FIXTURES.md
CASES = [
    ("R a, D", [("a", None)]),
    ("R a, R b, C", [("b", "a")]),
    ("R a, D, A a, C", [("a", None), ("a", None)]),
    ("R a, D, R b, C", [("a", None), ("b", "a")]),
    ("R a, R b, A b, D", [("b", "a")]),
    ("R a, R a, D", [("a", "a")]),
    ("D, C", []),
    ("R a, D, C", [("a", None)]),
    ("R a, O, D", [("a", None)]),
    ("R a", []),
]


def _events(spark, seq, tab="t1", step=1000, start=0):
    rows = []
    for i, tok in enumerate(s.strip() for s in seq.split(",")):
        parts = tok.split()
        url = parts[1] if len(parts) > 1 else None
        rows.append((i, CODES[parts[0]], None, url, start + i * step, tab, None, "u1", 1.0, 2.0, False))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seq,expected", CASES)
def test_tab_sequences(spark, seq, expected):
    got = events_to_views(_events(spark, seq)).select("url", "parent").collect()
    assert Counter((r.url, r.parent) for r in got) == Counter(expected)


@pytest.mark.parametrize("seq,expected", CASES)
def test_tab_sequences_across_buckets(spark, seq, expected):
    # one event per bucket: every lookup must come through the bucket carry
    ev = _events(spark, seq, step=10_000)
    got = events_to_views(ev, bucket_ms=10_000).select("url", "parent").collect()
    assert Counter((r.url, r.parent) for r in got) == Counter(expected)


def test_duration_and_attributes(spark):
    ev = _events(spark, "R a, D", step=2_999)
    v = events_to_views(ev).collect()[0]
    assert v.duration == 2 and v.view_id == 0 and v.daytime == 0 and v.weekday == 3  # 1970-01-01 was a Thursday


@pytest.mark.parametrize("bucket_ms", [3_600_000, 60_000])
def test_equals_sql(spark, bucket_ms):
    """The generated events against the SQL specification, at two bucket widths."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    want = con.sql(ORACLE["events_to_views"]).df()[["view_id", "url", "duration", "parent"]]
    got = events_to_views(driver_events(spark, sf), bucket_ms=bucket_ms).select("view_id", "url", "duration", "parent").toPandas()
    rows = lambda df: Counter(tuple(None if v != v else v for v in r) for r in df.itertuples(index=False))
    assert rows(got) == rows(want) and len(want) == 1860


def test_only_unprocessed(spark):
    ev = _events(spark, "R a, D, R b, C").withColumn(
        "processed", F.col("event_id") < 2)
    got = events_to_views(ev).select("url").collect()
    assert [r.url for r in got] == ["b"]
