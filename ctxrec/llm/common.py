"""Shared pieces of the operators: table access, scratch tables, task batches."""

from __future__ import annotations

import gc
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ctxrec.session import checkpoint_dir, remove_at_exit, scratch_path, ship_package
from ctxrec.sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` (and its DuckDB SQL)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors' Python, fix the shared folder, and
    keep Arrow batches small enough for long texts."""
    ship_package(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here,
    and a lost executor costs a reread, not a recomputation. The table is
    removed when the application's Python ends."""
    spark = df.sparkSession
    path = remove_at_exit(spark, scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}"))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy needs any more: all that was made
    from them is itself stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished work: its cleaner acts on
    what the driver's JVM has collected, by itself every 30 minutes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` (a stored table) as the side of a join: sent to every executor if
    its counted rows (``row_bytes`` each, or by a column, where rows differ)
    take at most BROADCAST_BYTES, else joined by a shuffle."""
    if isinstance(row_bytes, Column):
        size = df.agg(F.sum(row_bytes)).first()[0] or 0
    else:
        size = df.count() * row_bytes
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def per_text(docs: DataFrame, columns: str, fn: Callable[[list], list], id_col: str = "doc_id",
             text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``extra`` columns of the input as they are, then ``columns``
    (DDL). ``fn`` gets the texts of a batch (None for null) and returns one
    sequence per column. Every input row gives one row; ids are never touched,
    so null and repeated ids pass through."""
    made = StructType.fromDDL(columns)
    types = [to_arrow_type(f.dataType) for f in made]
    names = [id_col, *extra, *made.fieldNames()]
    src = docs.select(F.col(text_col).alias("_text"), F.col(id_col), *extra)
    schema = StructType([*src.drop("_text").schema.fields, *made.fields])

    def run(batches):
        for batch in batches:
            out = fn(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(c, type=t, from_pandas=True) for c, t in zip(out, types))], names=names)

    return src.mapInArrow(run, schema)
