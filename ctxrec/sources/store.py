"""Persisting and reloading collections and fitted models.

Tables are written as parquet (or JSON for an export another store can
read) under a caller-given path; on a cluster that path is in the shared
folder named by ``spark.checkpoint.dir`` (see ``ctxrec.session``).
"""

from __future__ import annotations

import gc
import os
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def export_table(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Full dump of a collection (the store's export)."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def load_export(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """Reload a dump with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).format(fmt).load(path)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """Reuse a wholly written feature table if present, else build and write it
    (a table whose writing was cut off has no success mark and is built anew)."""
    if _exists(spark, os.path.join(path, "_SUCCESS")):
        return spark.read.parquet(path)
    save_table(build(), path)
    return spark.read.parquet(path)


def model_path(base: str, name: str, *params) -> str:
    """File name = object name + its parameters joined by '-'."""
    suffix = "-".join(str(p) for p in params)
    return os.path.join(base, "models", name + suffix)


def table_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. As with a checkpoint
    the lineage ends here; unlike one, the table has a known size, so a later
    join can send it to every task if it is small. Removed when the
    application's Python ends."""
    import uuid

    from ctxrec.session import remove_at_exit, scratch_path

    spark = df.sparkSession
    path = remove_at_exit(spark, scratch_path(spark, f"rounds/{name}-{uuid.uuid4().hex}"))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete ``materialised`` tables that nothing lazy needs any more: all that was
    made from them is itself stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished work: its cleaner acts on
    what the driver's JVM has collected, by itself every 30 minutes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
