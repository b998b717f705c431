"""Scalar functions: url blacklist golden cases, tokens, time."""

from pyspark.sql import functions as F

from ctxrec.functions.timefns import hour_of_ms, weekday_of_ms
from ctxrec.functions.urls import glob_to_regex, url_blacklisted
from ctxrec.operators.text import tokens

PATTERNS = ["blacklisted", "black-listed"]
GOLDEN = [
    ("http://fr.blacklisted.org", True),
    ("http://blacklisted.org/content/", True),
    ("http://black-listed.com/content/", True),
    ("http://example.org/content", False),
    ("ftp://example.org/test/test", True),
    ("sftp://example.org", True),
]


def test_blacklist_golden(spark):
    df = spark.createDataFrame(GOLDEN, "url string, expected boolean")
    got = df.select("expected", url_blacklisted(F.col("url"), PATTERNS).alias("got")).collect()
    assert all(r.expected == r.got for r in got)


def test_blacklist_globs(spark):
    df = spark.createDataFrame([("http://ads.example.com/x",), ("http://example.com/ad",), ("HTTPS://a.b",)], "url string")
    got = [r.b for r in df.select(url_blacklisted(F.col("url"), ["ads.*.com", "x?z"]).alias("b")).collect()]
    assert got == [True, False, False]
    assert glob_to_regex("a*b?[!c]") == "a.*b.[^c]"


def test_tokens_unicode(spark):
    df = spark.createDataFrame([("Été à l'École, x y_z 42 Straße",)], "t string")
    assert df.select(tokens(F.col("t")).alias("k")).first().k == ["été", "école", "y_z", "42", "straße"]


def test_time_is_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1704067207179,)], "ts_ms bigint")  # 2024-01-01 00:00:07 UTC, a Monday
        r = df.select(hour_of_ms("ts_ms").alias("h"), weekday_of_ms("ts_ms").alias("w")).first()
        assert (r.h, r.w) == (0, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
