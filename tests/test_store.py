"""Kept feature tables: built once, reloaded, built anew for other rows or after a cut-off write."""

from ctxrec.plans import catalog
from ctxrec.sources.store import cached_table, materialised
from ctxrec.session import checkpoint_dir


def test_built_once_then_reloaded(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    path = str(tmp_path / "features")
    assert cached_table(spark, path, build).count() == 5
    assert cached_table(spark, path, build).count() == 5
    assert len(built) == 1
    (tmp_path / "features" / "_SUCCESS").rename(tmp_path / "mark")  # as if the writing had been cut off
    assert cached_table(spark, path, build).count() == 5
    assert len(built) == 2


def test_other_rows_have_another_place(spark):
    checkpoint_dir(spark)
    events = catalog._events(spark, "/root/testdata/sf0.001")
    path = catalog._feature_path(spark, events)
    assert path == catalog._feature_path(spark, events.repartition(3))
    assert path != catalog._feature_path(spark, events.where("event_id <> 7"))
    assert catalog._feature_path(spark, events.where("false")) not in ("", path)


def test_materialised_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (None, None)], "a int, b array<double>")
    kept = materialised(df, "test")
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
