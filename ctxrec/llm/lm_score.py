"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every word from the two words on
either side: position-weighted sums of their embeddings, a tanh, then a
softmax in two steps (class of the word, word in the class). A document's score
is the sum of the log-probabilities of all its words, each given its own
context; ``pll_per_word`` divides it by the words.

Word counts come from the whole table: the ``FREQUENT`` commonest words have
rows of their own, all others share ``RARE`` rows by hash. The network is trained in numpy on
every document: tasks start from the same weights (warmed up on ``WARM_DOCS``
documents with the smallest hash of their id), pass once over all their words,
and Spark averages the tasks' weights by their number of words. What reaches
the driver is the vocabulary and the averaged weights, both of fixed size.

Null and empty texts have no words, a score of 0 and a null ``pll_per_word``.
Repeated rows each get their row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, per_text, query
from .words import WordBatch, chunks

_U = np.uint64
FREQUENT, RARE = 1024, 1024
WORDS = FREQUENT + RARE
PAD = WORDS
CLASSES, IN_CLASS = 64, 32
SIZE = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 16384
RATE = 0.1
WARM_DOCS = 300
_SHAPES = {"embed": (WORDS + 1, SIZE), "place": (len(OFFSETS), SIZE), "to_class": (SIZE, CLASSES),
           "class_bias": (CLASSES,), "to_word": (CLASSES, SIZE, IN_CLASS), "word_bias": (CLASSES, IN_CLASS)}
N_WEIGHTS = sum(int(np.prod(s)) for s in _SHAPES.values())


def word_ids(batch: WordBatch, frequent: np.ndarray) -> np.ndarray:
    """Vocabulary row of each word; ``frequent`` holds the sorted hashes of the
    frequent words. Rows are spread over the classes."""
    at = np.searchsorted(frequent, batch.hash)
    known = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == batch.hash) if len(frequent) else (
        np.zeros(len(batch.hash), dtype=bool))
    return np.where(known, at, FREQUENT + (batch.hash % _U(RARE)).astype(np.int64))


def contexts(batch: WordBatch, ids: np.ndarray) -> np.ndarray:
    """Rows of the words around each word of its own text, PAD beyond its ends."""
    n = len(ids)
    out = np.full((n, len(OFFSETS)), PAD, dtype=np.int64)
    for j, step in enumerate(OFFSETS):
        src = np.arange(n) + step
        ok = (src >= 0) & (src < n)
        ok[ok] &= batch.doc[src[ok]] == batch.doc[np.flatnonzero(ok)]
        out[ok, j] = ids[src[ok]]
    return out


class Network:
    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(11)
            parts = {k: rng.normal(0, 0.3 if k == "embed" else 0.1, s) for k, s in _SHAPES.items()}
            parts["place"] = np.full(_SHAPES["place"], 0.5)
            flat = np.concatenate([parts[k].ravel() for k in _SHAPES])
        self.flat = np.array(flat, dtype=np.float32)
        self.sums = np.full(N_WEIGHTS, 0.1, dtype=np.float32)  # of squared gradients
        at = 0
        for k, s in _SHAPES.items():
            size = int(np.prod(s))
            setattr(self, k, self.flat[at: at + size].reshape(s))
            at += size

    def run(self, around: np.ndarray, ids: np.ndarray, learn: bool) -> np.ndarray:
        """Log-probability of each word; with ``learn`` also one step of training."""
        vectors = [self.embed[around[:, j]] for j in range(len(OFFSETS))]
        h = np.tanh(sum(v * p for v, p in zip(vectors, self.place)))
        cls, inside = ids // IN_CLASS, ids % IN_CLASS
        log, first = _log_softmax(h @ self.to_class + self.class_bias, cls, learn)
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        grads = {k: np.zeros(s, dtype=np.float32) for k, s in _SHAPES.items()} if learn else {}
        dh = first @ self.to_class.T if learn else None
        for k in range(CLASSES):
            rows = order[cuts[k]: cuts[k + 1]]
            if not len(rows):
                continue
            own, second = _log_softmax(h[rows] @ self.to_word[k] + self.word_bias[k], inside[rows], learn)
            log[rows] += own
            if learn:
                grads["to_word"][k] = h[rows].T @ second
                grads["word_bias"][k] = second.sum(axis=0)
                dh[rows] += second @ self.to_word[k].T
        if learn:
            grads["to_class"], grads["class_bias"] = h.T @ first, first.sum(axis=0)
            dz = dh * (1 - h * h)
            grads["place"] = np.stack([(v * dz).sum(axis=0) for v in vectors])
            where = around.ravel()
            back = (dz[:, None, :] * self.place).reshape(len(where), SIZE)
            for d in range(SIZE):
                grads["embed"][:, d] = np.bincount(where, weights=back[:, d], minlength=WORDS + 1)
            g = np.concatenate([grads[k].ravel() for k in _SHAPES]) / max(len(ids), 1) * 64
            self.sums += g * g
            self.flat -= RATE * g / np.sqrt(self.sums)
        return log


def _log_softmax(x: np.ndarray, at: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(log-probability of ``at``, with ``learn`` the gradient of minus its sum)."""
    x -= x.max(axis=1, keepdims=True)
    rows = np.arange(len(x))
    own = x[rows, at]
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    log = own.astype(np.float64) - np.log(total[:, 0])
    if not learn:
        return log, None
    x /= total
    x[rows, at] -= 1
    return log, x


def train_on(net: Network, texts: list[str | None], frequent: np.ndarray) -> int:
    seen = 0
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], lower=True)
        ids = word_ids(batch, frequent)
        around = contexts(batch, ids)
        for at in range(0, len(ids), BATCH):
            net.run(around[at: at + BATCH], ids[at: at + BATCH], learn=True)
        seen += len(ids)
    return seen


def score_texts(net: Network, texts: list[str | None], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probability) of each text."""
    words, total = [], []
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], lower=True)
        ids = word_ids(batch, frequent)
        around = contexts(batch, ids)
        log = np.concatenate([net.run(around[at: at + 4 * BATCH], ids[at: at + 4 * BATCH], learn=False)
                              for at in range(0, len(ids), 4 * BATCH)] or [np.zeros(0)])
        words.append(batch.count)
        total.append(np.bincount(batch.doc, weights=log, minlength=batch.n))
    return (np.concatenate(words), np.concatenate(total)) if words else (np.zeros(0, dtype=np.int64), np.zeros(0))


def frequent_words(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the commonest words of the whole table."""
    def count(batches):
        held_h, held_n, size = [], [], 0

        def merged():
            h, inverse = np.unique(np.concatenate(held_h), return_inverse=True)
            return h, np.bincount(inverse, weights=np.concatenate(held_n)).astype(np.int64)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                h, n = np.unique(WordBatch(texts[lo:hi], lower=True).hash, return_counts=True)
                held_h.append(h)
                held_n.append(n)
                size += len(h)
                if size > 2_000_000:
                    h, n = merged()
                    if len(h) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])
                        h, n = h[:0], n[:0]
                    held_h, held_n, size = [h], [n], len(h)
        if held_h:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    top = (docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(FREQUENT).collect())
    return np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(_U))


def _trained(docs: DataFrame, text_col: str, flat: np.ndarray | None, frequent: np.ndarray) -> np.ndarray | None:
    """Weights averaged over the tasks of ``docs``; None without words."""
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast((flat, frequent))  # about 0.3 MB

    def run(batches):
        start, words = given.value
        net, seen = Network(start), 0
        for batch in batches:
            seen += train_on(net, batch.column(0).to_pylist(), words)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(N_WEIGHTS, dtype=np.int32)), pa.array(net.flat.astype(np.float64) * seen),
                 pa.array(np.full(N_WEIGHTS, float(seen)))], names=["i", "v", "w"])

    rows = (docs.select(text_col).mapInArrow(run, "i int, v double, w double").groupBy("i")
            .agg((F.sum("v") / F.sum("w")).alias("v")).toPandas())
    if rows.empty:
        return None
    out = np.zeros(N_WEIGHTS, dtype=np.float32)
    out[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray | None, np.ndarray]:
    """(weights, frequent words)."""
    frequent = frequent_words(docs, text_col)
    few = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
           .orderBy(F.xxhash64("_id"), "_id", "_text").limit(WARM_DOCS).repartition(1))
    warm = _trained(few, "_text", None, frequent)
    return _trained(docs, text_col, warm, frequent), frequent


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, pll (sum of log-probabilities) and pll_per_word."""
    flat, frequent = fit(docs, id_col, text_col)
    given = docs.sparkSession.sparkContext.broadcast((flat, frequent))

    def judge(texts):
        weights, words = given.value
        n, total = score_texts(Network(weights), texts, words)
        each = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
        return [n, total, each]

    return per_text(docs, "n_words long, pll double, pll_per_word double", judge, id_col, text_col)


@query("op6_lm_score")
def op6_lm_score(spark, sf_dir):
    """Every document's masked pseudo-likelihood."""
    return score_documents(documents(spark, sf_dir))
