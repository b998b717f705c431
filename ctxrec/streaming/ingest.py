"""Streaming event intake: raw posted events from a file source, appended to
the events table (a parquet sink with exactly-once file commits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ctxrec.operators.store import ingest_events


def read_raw_events(spark: SparkSession, path: str, schema: StructType, fmt: str = "json",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def start_ingest(raw_stream: DataFrame, out_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """``readStream`` raw events -> event rows -> append to ``out_path``."""
    w = (ingest_events(raw_stream).writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
