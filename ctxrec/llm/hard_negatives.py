"""Hard-negative mining with rotated one-bit codes.

Components become whole numbers, floor(256 * x), and a score is a whole inner
product. Every vector is indexed once: it is rotated by a fixed random rotation,
its code keeps one sign bit a dimension, and beside the code lie the vector's
norm and its alignment, the cosine a between vector and code direction b.

An anchor's rotated vector is kept in 8-bit steps, as eight bit planes, so that
``<q, b>`` comes from popcounts of plane AND code, up to the norm of what the
steps leave over. A unit vector is ``a * b + r`` with r across b and
``|r| = sqrt(1 - a*a)``, so by Cauchy-Schwarz

    <q, x> lies in |x| * (a * <q, b>  +-  sqrt(|q|^2 - <q, b>^2) * sqrt(1 - a*a)).

The interval is certain, not likely: a row whose interval misses what is asked
for cannot belong to the result, and every surviving row is scored in integers.
So the result is exact (recall 1). Positives: the interval's upper end must
reach the anchor's p-th best score so far. Negatives: the interval must meet
the window [low, high] % of a positive's score, above the best so far in it.
The rows with the highest estimates are scored first, for early thresholds.

Anchors are taken in blocks of about ANCHOR_BLOCK; a block is one pass of the
indexed table, each task giving at most p (n) rows an anchor (pair), merged by a
window. Nothing is shuffled but these.

Rows with a null id, label or vector, a null or non-finite component, or a
vector that is not as long as the most common length (of equally common ones
the longest) take no part, nor do rows whose components exceed the 64-bit range
of a score (``limit_of``). Zero vectors score 0. Rows that share an id are never
each other's positives; repeated rows are rows of their own. Ties go to the
smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxrec.session import remove_at_exit, scratch_path
from ctxrec.sources.tables import read_table

from .common import query, stored

POSITIVES, NEGATIVES = 5, 3
#: percent of the positive's score that a negative's score may have
LOW, HIGH = 50, 95
SCALE = 256
SEED = 20
ANCHOR_BLOCK = 4096
#: anchors compared with a batch of rows at a time
TILE = 512
PLANES = 8
MARGIN = 1e-9
#: pairs scored by gathering their two vectors at a time
PAIRS = 1 << 15
_LEAST = np.iinfo(np.int64).min
INDEX = "id long, label long, v binary, code binary, norm double, align double"
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation (the same everywhere up to rounding, which bounds allow for)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def limit_of(dim: int) -> int:
    """Largest component whose inner products fit into 64 bits."""
    return math.isqrt((1 << 62) // dim)


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, norm, alignment) of whole vectors."""
    n, dim = v.shape
    x = v.astype(float)
    turned = x @ turn
    bits = np.zeros((n, -(-dim // 64) * 64), dtype=np.uint8)
    bits[:, :dim] = turned >= 0
    code = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    norm = np.sqrt((x * x).sum(axis=1))
    align = np.abs(turned).sum(axis=1) / np.where(norm > 0, norm, 1) / math.sqrt(dim)
    return code, norm, np.minimum(align, 1.0)


def indexed(rows: DataFrame, dim: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """The index (INDEX columns) of every row that takes part."""
    turn = rows.sparkSession.sparkContext.broadcast(rotation(dim))  # dim x dim

    def run(batches):
        for batch in batches:
            ids, labels, vectors = batch.columns
            flat = vectors.flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dim)  # null components become NaN
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(SCALE * x)
                ok = np.flatnonzero((np.isfinite(x) & (np.abs(v) <= limit_of(dim))).all(axis=1))
            v = v[ok].astype(np.int64)
            code, norm, align = encode(v, turn.value)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(ok)), labels.take(pa.array(ok)), pa.array([r.tobytes() for r in v], pa.binary()),
                 pa.array([r.tobytes() for r in code], pa.binary()), pa.array(norm), pa.array(align)],
                names=["id", "label", "v", "code", "norm", "align"])

    part = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) == dim))
    return part.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vec_col)).mapInArrow(run, INDEX)


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A column of equally long byte strings as the rows of a matrix."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1) if n else np.zeros((0, 1), dtype=kind)


@dataclass
class Rows:
    """A batch of indexed rows."""
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    code: np.ndarray
    norm: np.ndarray
    align: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> "Rows":
        c = batch.columns
        return Rows(c[0].to_numpy(), c[1].to_numpy(), matrix(c[2], "<i8"), matrix(c[3], "<u8"), c[4].to_numpy(), c[5].to_numpy())

    def part(self, at: np.ndarray) -> "Rows":
        return Rows(self.id[at], self.label[at], self.v[at], self.code[at], self.norm[at], self.align[at])


@dataclass
class Anchors:
    """A block of anchors: whole vectors, and rotated ones as bit planes."""
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    planes: np.ndarray   # anchor x plane x word
    base: np.ndarray     # rotated component = base + step * value of the planes + what is left over
    step: np.ndarray
    left: np.ndarray     # norm of what is left over
    total: np.ndarray    # sum of base + step * value

    @staticmethod
    def of(ids: np.ndarray, label: np.ndarray, v: np.ndarray, turn: np.ndarray) -> "Anchors":
        n, dim = v.shape
        turned = v.astype(float) @ turn
        base = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - base) / ((1 << PLANES) - 1), 1e-300)
        value = np.rint((turned - base[:, None]) / step[:, None]).astype(np.int64)
        kept = base[:, None] + step[:, None] * value
        bits = np.zeros((n, PLANES, -(-dim // 64) * 64), dtype=np.uint8)
        for p in range(PLANES):
            bits[:, p, :dim] = (value >> p) & 1
        planes = np.packbits(bits, axis=2, bitorder="little").view("<u8")
        return Anchors(ids, label, v, np.sqrt((v.astype(float) ** 2).sum(axis=1)), planes, base, step,
                       np.sqrt(((turned - kept) ** 2).sum(axis=1)), kept.sum(axis=1))

    def interval(self, at: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each of the anchors with each row."""
        value = np.zeros((len(at), len(rows.id)), dtype=np.int32)
        ones = np.zeros(len(rows.id), dtype=np.int32)
        for w in range(rows.code.shape[1]):
            ones += np.bitwise_count(rows.code[:, w])
            for p in range(PLANES):
                value += np.bitwise_count(self.planes[at, p, w][:, None] & rows.code[:, w]).astype(np.int32) << p
        dim = self.v.shape[1]
        on = self.base[at, None] * ones + self.step[at, None] * value   # sum over the dimensions with a set bit
        along = (2 * on - self.total[at, None]) / math.sqrt(dim)
        left = self.left[at, None]
        across = np.sqrt(np.maximum(self.norm[at, None] ** 2 - np.maximum(np.abs(along) - left, 0) ** 2, 0))
        wide = rows.align * left + across * np.sqrt(np.maximum(1 - rows.align ** 2, 0)) + MARGIN * self.norm[at, None]
        middle = rows.align * along
        return rows.norm * (middle - wide), rows.norm * (middle + wide)

    def scores(self, i: np.ndarray, rows: Rows, j: np.ndarray) -> np.ndarray:
        """Whole scores of anchors i with rows j."""
        out = np.empty(len(i), dtype=np.int64)
        for lo in range(0, len(i), PAIRS):
            s = slice(lo, lo + PAIRS)
            out[s] = (self.v[i[s]] * rows.v[j[s]]).sum(axis=1)
        return out


class Best:
    """For each key its k best (score, id): highest score, then smallest id."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.score = np.full((keys, k), _LEAST, dtype=np.int64)
        self.id = np.zeros((keys, k), dtype=np.int64)
        self.filled = np.zeros(keys, dtype=np.int64)

    @property
    def least(self) -> np.ndarray:
        """The score that a further row must reach (with a smaller id if equal)."""
        return np.where(self.filled == self.k, self.score[:, -1], _LEAST)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least[key]
        key, score, ids = key[ok], score[ok], ids[ok]
        if not len(key):
            return
        hit = np.unique(key)
        old, place = np.nonzero(np.arange(self.k) < self.filled[hit][:, None])
        key = np.concatenate((key, hit[old]))
        score = np.concatenate((score, self.score[hit[old], place]))
        ids = np.concatenate((ids, self.id[hit[old], place]))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate((first, [len(key)]))))
        top = rank < self.k
        self.score[key[top], rank[top]] = score[top]
        self.id[key[top], rank[top]] = ids[top]
        self.filled[hit] = np.minimum(np.bincount(np.searchsorted(hit, key), minlength=len(hit)), self.k)

    def table(self, names: list[str]) -> pa.RecordBatch:
        key, place = np.nonzero(np.arange(self.k) < self.filled[:, None])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(self.id[key, place]), pa.array(self.score[key, place])], names=names)


def best_positives(index: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(a, id, score): of every task, each anchor's k best other rows of its label."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        q = sent.value
        best = Best(len(q.id), k)
        for batch in batches:
            whole = Rows.of(batch)
            for label in np.intersect1d(np.unique(whole.label), q.label):
                rows = whole.part(np.flatnonzero(whole.label == label))
                mine = np.flatnonzero(q.label == label)
                for lo in range(0, len(mine), TILE):
                    at = mine[lo: lo + TILE]
                    low, high = q.interval(at, rows)
                    other = q.id[at][:, None] != rows.id
                    middle = np.where(other, low + high, -np.inf)
                    first = np.zeros(other.shape, dtype=bool)
                    if len(rows.id) > k:  # the highest estimates, for the thresholds
                        np.put_along_axis(first, np.argpartition(middle, -k, axis=1)[:, -k:], True, axis=1)
                        i, j = np.nonzero(first & other)
                        best.add(at[i], q.scores(at[i], rows, j), rows.id[j])
                    i, j = np.nonzero(other & ~first & (high >= best.least[at].astype(float)[:, None]))
                    best.add(at[i], q.scores(at[i], rows, j), rows.id[j])
        yield best.table(["a", "id", "score"])

    return index.mapInArrow(run, "a long, id long, score long")


def best_negatives(index: DataFrame, anchors: Anchors, pair_anchor: np.ndarray, low_end: np.ndarray, high_end: np.ndarray,
                   k: int) -> DataFrame:
    """(pair, id, score): of every task, each pair's k best rows of another label
    whose score lies in [low_end, high_end]. Pairs are in the order of their anchors."""
    sent = index.sparkSession.sparkContext.broadcast((anchors, pair_anchor, low_end, high_end))

    def run(batches):
        q, owner, bottom, top = sent.value
        best = Best(len(owner), k)
        for batch in batches:
            rows = Rows.of(batch)
            for lo in range(0, len(q.id), TILE):
                at = np.arange(lo, min(lo + TILE, len(q.id)))
                pairs = np.arange(*np.searchsorted(owner, [at[0], at[-1] + 1]))
                if not len(pairs):
                    continue
                low, high = q.interval(at, rows)
                low[q.label[at][:, None] == rows.label] = np.inf  # never meets a window
                may = np.zeros(low.shape, dtype=bool)
                need = np.maximum(bottom[pairs], best.least[pairs]).astype(float)
                for p, floor in zip(pairs, need):
                    a = owner[p] - lo
                    may[a] |= (high[a] >= floor) & (low[a] <= top[p])
                i, j = np.nonzero(may)
                if not len(i):
                    continue
                score = q.scores(at[i], rows, j)
                # every pair of the anchor looks at the scored rows
                size = np.bincount(i, minlength=len(at))
                begin = np.concatenate(([0], np.cumsum(size)))
                own = owner[pairs] - lo
                key = np.repeat(pairs, size[own])
                ends = np.cumsum(size[own])
                see = np.arange(len(key)) + np.repeat(begin[own] - (ends - size[own]), size[own])
                inside = (score[see] >= bottom[key]) & (score[see] <= top[key])
                best.add(key[inside], score[see[inside]], rows.id[j[see[inside]]])
        yield best.table(["pair", "id", "score"])

    return index.mapInArrow(run, "pair long, id long, score long")


def ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """RESULT rows of every anchor (``is_anchor``: a condition on ``id``) and positive."""
    spark = rows.sparkSession
    path = remove_at_exit(spark, scratch_path(spark, f"llm/negatives-{uuid.uuid4().hex}"))
    spark.createDataFrame([], RESULT).write.parquet(path)
    length = rows.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.read.schema(RESULT).parquet(path)
    dim = int(length.n)
    index = stored(indexed(rows, dim, id_col, vec_col, label_col), "negatives-index")
    chosen = index.where(is_anchor).select("id", "label", "v")
    blocks = max(1, -(-chosen.count() // anchor_block))
    for block in range(blocks):
        # about anchor_block rows, however many there are in all
        got = chosen.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).orderBy("id").collect()
        if not got:
            continue
        anchors = Anchors.of(np.array([r.id for r in got], dtype=np.int64), np.array([r.label for r in got], dtype=np.int64),
                             np.frombuffer(b"".join(bytes(r.v) for r in got), dtype="<i8").reshape(-1, dim), rotation(dim))
        pairs = ranked(best_positives(index, anchors, positives), "a", positives).orderBy("a", "rank").collect()
        if not pairs:
            continue
        owner = np.array([p.a for p in pairs], dtype=np.int64)
        score = np.array([p.score for p in pairs], dtype=object)  # whole numbers of any size
        bottom = np.array([max(-((-low * s) // 100), -(1 << 62)) for s in score], dtype=np.int64)
        top = np.array([(high * s) // 100 for s in score], dtype=np.int64)
        ask = spark.createDataFrame([(i, int(anchors.id[p.a]), p.id, p.score) for i, p in enumerate(pairs)],
                                    "pair long, anchor_id long, positive_id long, positive_score long")
        (ranked(best_negatives(index, anchors, owner, bottom, top, negatives), "pair", negatives)
         .withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(ask, "pair")
         .select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
         .write.mode("append").parquet(path))
    return spark.read.schema(RESULT).parquet(path)


_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op12_hard_negatives", _SQL)
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of the best positives of every 50th vector."""
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), F.col("id") % 50 == 0)
