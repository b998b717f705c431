"""Benchmark decontamination by winnowing.

The hashes of all runs of ``GRAM`` words of a text are slid over by windows of
``WINDOW - GRAM + 1`` hashes; the smallest of each window is a fingerprint. Two
texts that share ``WINDOW`` consecutive words share the fingerprint of that
window, so every shared span of ``WINDOW`` words or more is found. Documents
and benchmark items are joined on fingerprints; each hit is extended to the
whole windows around it, whose words are then compared as they are.

An item of fewer than ``WINDOW`` words (but some) is one window of its own
length; all runs of that length are its fingerprints.

DataFrame functions only. One pass over all texts stores each document's words
count and distinct fingerprints; only the texts of documents that share one are
read again. A window carries the number of its set of items (windows that the
same items hold share it), which is resolved once per document. Benchmark-sized
tables are broadcast if their counted size allows, else both sides are shuffled.
A document is identified by its id and the hash of its text, so rows that repeat an id
with another text stay apart and equal rows each get their (equal) result.
Null and empty texts have no words and no hits; very long texts are read whole,
as one row; a null id is kept as a value; items with a null id are left out;
empty tables give no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, lower_ascii, query, sized, stored
from ctxrec.sources.tables import read_table

WINDOW = 10
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NONE = "array<bigint>"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _runs(words: Column, k: int) -> Column:
    """Hashes of all runs of k words (``words`` must be a column, not an expression)."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
                  ).otherwise(F.array().cast(_NONE))


def _fingerprints(df: DataFrame, size: int) -> DataFrame:
    """Adds ``mark``: for each window of ``size`` words of ``words``, its fingerprint."""
    if size < WINDOW:
        return df.withColumn("mark", _runs(F.col("words"), size))
    span, h = WINDOW - GRAM + 1, F.col("gram")
    return df.withColumn("gram", _runs(F.col("words"), GRAM)).withColumn(
        "mark", F.when(F.size(h) >= span, F.transform(
            F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: F.array_min(F.slice(h, i, span)))
        ).otherwise(F.array().cast(_NONE))).drop("gram")


def _windows(df: DataFrame, size: int, keep: Column) -> DataFrame:
    """One row per window whose fingerprint ``keep(mark, i)`` holds: start, window."""
    at = F.explode(keep).alias("start")
    return df.select("*", at).withColumn("window", F.array_join(F.slice("words", F.col("start"), size), " "))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return (items.where(F.col(item_id).isNotNull())
            .select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("words"))
            .withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).where("size > 0").distinct())


def _marked(src: DataFrame, sizes: list[int]) -> DataFrame:
    """(_id, _hash, n_words) of every document with its distinct fingerprints
    of each window size (``m<size>``): the one pass over all texts."""
    df = src.select("_id", "_hash", words_of(F.col("_text")).alias("words"))
    for size in sizes:
        df = _fingerprints(df, size).withColumnRenamed("mark", f"m{size}")
    return stored(df.select("_id", "_hash", F.size("words").cast("long").alias("n_words"),
                            *[F.array_distinct(f"m{size}").alias(f"m{size}") for size in sizes]), "leak-marks")


def _found(src: DataFrame, bench: DataFrame, marked: DataFrame, sizes: list[int]) -> DataFrame:
    """(_id, _hash, spans, n_hit, items) of the documents that hold a window."""
    hits, sets = None, None
    for size in sizes:
        of_size = _fingerprints(bench.where(F.col("size") == size), size)
        marks = stored(of_size.select(F.explode("mark").alias("mark")).distinct(), "leak-bench-marks")
        # windows that the same items hold share one set of items
        owned = (_windows(of_size, size, F.sequence(F.lit(1), F.size("mark")))
                 .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
                 .withColumn("set", F.md5(F.to_json("items"))))
        owned = stored(owned, "leak-windows")
        own_sets = owned.groupBy("set").agg(F.first("items").alias("items"))
        sets = own_sets if sets is None else sets.unionByName(own_sets)
        shared = (marked.select("_id", "_hash", F.explode(f"m{size}").alias("mark")).join(sized(marks, 16), "mark")
                  .groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.collect_set("mark").alias("shared")))
        shared = stored(shared, "leak-shared")
        # the texts of these documents only
        near = src.join(sized(shared, 32 + 8 * F.size("shared")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
        near = _fingerprints(near.select("_id", "_hash", "shared", words_of(F.col("_text")).alias("words")), size)
        fits = F.filter(F.sequence(F.lit(1), F.size("mark")),
                        lambda i: F.array_contains(F.col("shared"), F.get(F.col("mark"), i - 1)))
        found = (_windows(near, size, fits).join(sized(owned.select("window", "set"), 48 + F.octet_length("window")), "window")
                 .select("_id", "_hash", (F.col("start") - 1).alias("start"), F.lit(size).alias("size"), "set"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return src.select("_id", "_hash", F.array().cast(_SPANS).alias("spans"), F.lit(0).cast("long").alias("n_hit"),
                          F.array().cast(f"array<{dict(bench.dtypes)['item']}>").alias("items")).where("false")
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"))
    per_doc = stored(hits.groupBy("_id", "_hash").agg(
        F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("set").alias("sets")), "leak-hits")
    of_doc = (per_doc.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.explode("sets").alias("set"))
              .join(sets.dropDuplicates(["set"]), "set")
              .groupBy("_i", "_h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))

    def join_span(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        widened = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["end"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(widened))
                      ).otherwise(F.concat(done, F.array(s)))

    merged = per_doc.withColumn("spans", F.aggregate("spans", F.array().cast(_SPANS), join_span))
    return (merged.join(of_doc, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_hash").eqNullSafe(F.col("_h")))
            .select("_id", "_hash", "spans",
                    F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), "items"))


def _search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    src, bench = _source(docs, id_col, text_col), _items(items, item_id, item_text)
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most WINDOW values
    marked = _marked(src, sizes)
    return marked, _found(src, bench, marked, sizes)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document that holds a window of an item: id, text_hash,
    spans (array of start word, end word; 0-based, end exclusive, sorted and
    merged), n_hit, items (sorted item ids)."""
    _, found = _search(docs, items, id_col, text_col, item_id, item_text)
    return found.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), "spans", "n_hit", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (null without hits)."""
    marked, found = _search(docs, items, id_col, text_col, "item_id", "text")
    found = stored(found.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "n_hit", "items"), "leak-found")
    return (marked.select("_id", "_hash", "n_words")
            .join(sized(found, 32 + 24 * F.size("items")), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_hash").eqNullSafe(F.col("_h")), "left")
            .select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items"))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_W}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_W}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw))),
hit AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op5_decontaminate", _SQL)
def op5_decontaminate(spark, sf_dir):
    """Every document against every benchmark item."""
    found = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                        F.sha2(F.coalesce(F.array_join(names, ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
