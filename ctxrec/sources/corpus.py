"""Training corpora: the eligible resources themselves, or a folder of texts.

An external corpus (the reference's newsgroup collection) is a folder with one
text a file, at any depth. Files are read whole by Spark's reader, so the folder
may be in any store Spark reads; a text's id is its path below the folder, which
stays the same however files are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrec.operators.ranking import eligible_resources


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc, text)`` of every file below ``folder``; one final line end is not part of a text."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    below = F.regexp_extract(path, r"[^/]/+" + folder.rstrip("/").rpartition("/")[2].replace(".", r"\.") + r"/(.*)$", 1)
    return files.select(F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("doc"),
                        F.regexp_replace("value", r"\r?\n\z", "").alias("text"))


def training_corpus(spark: SparkSession, training_set: str, resources: DataFrame | None = None,
                    folder: str | None = None) -> DataFrame:
    """``(doc, text)`` a text model is trained on. ``training_set``: ``docs`` (the
    downloaded, not blacklisted resources) or ``folder`` (an external corpus)."""
    if training_set == "docs":
        return eligible_resources(resources).select(F.col("url").alias("doc"), F.col("content").alias("text"))
    if training_set == "folder":
        return read_folder(spark, folder)
    raise ValueError(f"no training set {training_set!r}")
