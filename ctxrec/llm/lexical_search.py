"""Ranked lexical search by norm buckets of impact vectors (the LEMP scheme).

Terms are runs of digits, A-Z, a-z (A-Z lower-cased) and code points from
U+0080 on. A document's impact vector holds, for each term of the queries, what
one occurrence in a query is worth before the term's weight:
``(10**9 * tf) div (1000 * tf + 8 * m)`` with m from the document's length
against the average; a query's vector holds ``weight * occurrences``. A score
is their inner product, in 64-bit integers.

Vectors are stored ordered by length (Euclidean norm). The longest few percent
are searched first, which gives every query a threshold: the score of its k-th
best so far. The rest is searched with it:

- a document whose norm times the largest possible query norm stays below every
  threshold is not even read (a filter on the stored norm);
- inside a task, vectors form buckets; a query skips a bucket if
  ``|q| * (largest norm in it)`` is below its threshold (Cauchy-Schwarz);
- inside a bucket, the query's heaviest coordinates are summed from the bucket's
  inverted lists, and a document survives only if this sum plus
  ``|rest of q| * |rest of the vector|`` reaches the threshold;
- survivors are scored exactly in integers. Bounds are floating point with a
  margin far above their rounding; ties at the threshold survive.

Every task gives at most k rows a query; the best k of all are kept by
(score descending, id ascending). Queries are dealt into blocks of about
BLOCK_CHARS characters, each one pass over all documents, so what is sent to the
executors is bounded however many queries there are.

Null and empty texts have no terms: as documents they are never found (nor
counted in N), as queries they have no rows. Texts of any length are read whole,
a stretch at a time. Documents that repeat an id are ranked row by row; a null
id comes after all others of its score. Each query row has results of its own,
also if it repeats an id. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ctxrec.session import remove_at_exit, scratch_path
from ctxrec.sources.tables import read_table

from .common import documents, per_text, query, stored

K = 10
#: characters of the queries of a block: bounds the vocabulary sent to executors
BLOCK_CHARS = 4 << 20
#: vectors of a bucket
BUCKET = 2048
#: the share of vectors searched first, for the thresholds
HEAD_SHARE = 0.02
#: the coordinates summed first hold at least this share of a query's squared norm
FOCUS = 0.8
#: relative margin of the floating-point bounds
MARGIN = 1e-9
#: bytes of a text cut into terms at a time
STRETCH = 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None):
    """The terms of a text, as lists of UTF-8 bytes, one list a stretch."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""
    lo = 0
    while lo < len(folded):
        hi = folded.find(b" ", lo + STRETCH)
        hi = len(folded) if hi < 0 else hi
        yield folded[lo:hi].split()
        lo = hi


def term_counts(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (all terms), terms and tfs (those that ``number`` numbers, from 1) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(texts):
        get = sent.value.get
        n = np.zeros(len(texts), dtype=np.int64)
        size, flat, tfs = [0], [], []
        for i, text in enumerate(texts):
            found: Counter[int] = Counter()
            for some in terms(text):
                n[i] += len(some)
                found.update(filter(None, map(get, some)))
            flat += found.keys()
            tfs += found.values()
            size.append(len(flat))
        ends = pa.array(size, pa.int32())
        return [n, *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (flat, tfs))]

    return per_text(docs, "n long, terms array<int>, tfs array<int>", run, id_col, text_col)


def impacts(counts: DataFrame, id_col: str, documents_n: int, terms_n: int) -> DataFrame:
    """id, norm, terms and x (impacts) of every document with a numbered term, the longest first in each task."""
    types = {f.name: f for f in counts.schema}
    schema = StructType([types[id_col], *StructType.fromDDL("norm double, terms array<int>, x array<long>").fields])

    def run(batches):
        for batch in batches:
            ids, n, at, tfs = batch.columns
            size = np.diff(at.offsets.to_numpy())
            m = 25 + (75 * n.to_numpy() * documents_n) // max(terms_n, 1)
            tf = tfs.flatten().to_numpy().astype(np.int64)
            x = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size))
            square = np.bincount(np.repeat(np.arange(len(size)), size), weights=x.astype(float) ** 2, minlength=len(size))
            ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.sqrt(square)), pa.ListArray.from_arrays(ends, at.flatten()), pa.ListArray.from_arrays(ends, pa.array(x))],
                names=schema.fieldNames())

    # the order within a task is all that is needed: buckets look at their own largest norm
    return (counts.where("size(terms) > 0").select(id_col, "n", "terms", "tfs").mapInArrow(run, schema)
            .sortWithinPartitions(F.desc("norm")))


@dataclass
class Query:
    """One query: term numbers by falling weight, whole weights, norms."""
    row: int
    term: np.ndarray
    q: np.ndarray
    norm: float
    focus: int       # the first so many coordinates are summed from inverted lists
    rest: float      # norm of the others
    threshold: int   # a score known to be reached by k documents

    @staticmethod
    def of(row: int, weight: dict[int, int], threshold: int = 0) -> "Query":
        term = np.array(sorted(weight, key=lambda t: (-weight[t], t)), dtype=np.int64)
        q = np.array([weight[int(t)] for t in term], dtype=np.int64)
        square = np.cumsum(q.astype(float) ** 2)
        whole = float(square[-1]) if len(q) else 0.0
        focus = int(np.searchsorted(square, FOCUS * whole)) + 1
        return Query(row, term, q, math.sqrt(whole), focus, math.sqrt(float((q[focus:].astype(float) ** 2).sum())), threshold)


class Bucket:
    """Some impact vectors by row and as inverted lists."""

    def __init__(self, norm: np.ndarray, size: np.ndarray, term: np.ndarray, x: np.ndarray):
        self.norm, self.size, self.term, self.x = norm, size, term, x
        self.first = np.concatenate(([0], np.cumsum(size)))
        order = np.argsort(term, kind="stable")
        self.by_term = term[order]
        self.row = np.repeat(np.arange(len(size)), size)[order]
        self.value = x[order].astype(float)
        self.longest = float(norm.max()) if len(norm) else 0.0

    def survivors(self, q: Query, threshold: int) -> np.ndarray:
        """Rows whose score may reach the threshold (and is above 0)."""
        if q.norm * self.longest * (1 + MARGIN) < max(threshold, 1):
            return np.zeros(0, dtype=np.int64)
        part, square = np.zeros(len(self.norm)), np.zeros(len(self.norm))
        los, his = (np.searchsorted(self.by_term, q.term[:q.focus], side) for side in ("left", "right"))
        for w, lo, hi in zip(q.q, los, his):
            at, v = self.row[lo:hi], self.value[lo:hi]
            part[at] += w * v
            square[at] += v * v
        bound = part + q.rest * np.sqrt(np.maximum(self.norm ** 2 * (1 + MARGIN) - square, 0))
        return np.flatnonzero(bound * (1 + MARGIN) >= max(threshold, 1))

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of the rows; ``weight`` holds the query's weight of every term."""
        size = self.size[rows]
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(begin[-1]) + np.repeat(self.first[rows] - begin[:-1], size)
        total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(weight[self.term[at]] * self.x[at])))
        return total[begin[1:]] - total[begin[:-1]]


def search(vectors: DataFrame, queries: list[Query], vocabulary: int, id_col: str, k: int) -> DataFrame:
    """(row, id, score): of every task at most k documents a query, its best among them."""
    sent = vectors.sparkSession.sparkContext.broadcast(queries)
    schema = StructType([StructField("row", LongType()), StructField(id_col, vectors.schema[id_col].dataType),
                         StructField("score", LongType())])

    def run(batches):
        asked = sent.value
        best: list[list[tuple]] = [[] for _ in asked]
        least = [q.threshold for q in asked]
        weight = np.zeros(vocabulary + 1, dtype=np.int64)
        kind = pa.null()

        def settle(held):
            ids = pa.concat_arrays([b.column(0) for b in held])
            size = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
            bucket = Bucket(np.concatenate([b.column(1).to_numpy() for b in held]), size,
                            *(np.concatenate([b.column(i).flatten().to_numpy() for b in held]) for i in (2, 3)))
            for i, q in enumerate(asked):
                rows = bucket.survivors(q, least[i])
                if not len(rows):
                    continue
                weight[q.term] = q.q
                score = bucket.scores(rows, weight)
                weight[q.term] = 0
                floor = max(least[i], 1)
                if len(score) > k:
                    floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
                rows, score = rows[score >= floor], score[score >= floor]
                found = zip(score.tolist(), ids.take(pa.array(rows)).to_pylist())
                best[i] = sorted(best[i] + [(-s, d is None, d) for s, d in found],
                                 key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))[:k]
                if len(best[i]) == k:
                    least[i] = max(least[i], -best[i][-1][0])

        held, rows = [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, BUCKET):
                part = batch.slice(lo, BUCKET)
                if rows and rows + part.num_rows > BUCKET:
                    settle(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            settle(held)
        flat = [(q.row, e) for q, found in zip(asked, best) for e in found]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in flat], pa.int64()), pa.array([e[2] for _, e in flat], kind),
                 pa.array([-e[0] for _, e in flat], pa.int64())], names=schema.fieldNames())

    return vectors.select(id_col, "norm", "terms", "x").mapInArrow(run, schema)


def best_of(found: DataFrame, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
                   head_share: float = HEAD_SHARE) -> DataFrame:
    """(item id, rank, id, score): the k best documents of every item."""
    spark = docs.sparkSession
    asked = stored(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
                   .withColumn("row", F.monotonically_increasing_id()), "search-items")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    made = StructType([StructField("row", LongType()), docs.schema[id_col], StructField("score", LongType()),
                       *StructType.fromDDL("rank int").fields])
    path = remove_at_exit(spark, scratch_path(spark, f"llm/search-found-{uuid.uuid4().hex}"))
    spark.createDataFrame([], made).write.parquet(path)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").collect()  # about block_chars
        wanted = {r.row: Counter(t for some in terms(r.text) for t in some) for r in rows}
        names = sorted(set().union(*wanted.values()))
        number = {t: i + 1 for i, t in enumerate(names)}
        counts = stored(term_counts(docs, number, id_col, text_col), "search-counts")
        n, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # at most one row a term of the block
        df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = {i: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in number.values()}
        queries = [Query.of(row, {number[t]: c * weight[number[t]] for t, c in some.items() if number[t] in df})
                   for row, some in wanted.items()]
        queries = [q for q in queries if q.norm > 0]
        if not queries:
            continue
        vectors = stored(impacts(counts, id_col, n, length), "search-impacts")
        cut = vectors.agg(F.percentile_approx("norm", 1 - head_share, 1000)).first()[0]
        head = stored(best_of(search(vectors.where(F.col("norm") >= cut), queries, len(number), id_col, k), id_col, k), "search-head")
        kth = dict(head.where(F.col("rank") == k).select("row", "score").collect())
        for q in queries:
            q.threshold = kth.get(q.row, 0)
        least = min(q.threshold / q.norm for q in queries) * (1 - MARGIN)
        tail = search(vectors.where((F.col("norm") < cut) & (F.col("norm") >= least)), queries, len(number), id_col, k)
        best_of(head.drop("rank").unionByName(tail), id_col, k).select(*made.fieldNames()).write.mode("append").parquet(path)
    found = spark.read.schema(made).parquet(path)
    return found.join(asked.select("row", "item"), "row").select(
        F.col("item").alias(item_id), "rank", F.col(id_col), "score")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_terms) AS m FROM d, c WHERE len(w) > 0),
x AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * m) AS x FROM tf JOIN m USING (doc_id)),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * x) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN x USING (t) GROUP BY 1, 2 HAVING sum(c * w * x) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query("op11_lexical_search", _SQL)
def op11_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return rank_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
