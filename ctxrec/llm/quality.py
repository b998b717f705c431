"""Quality rules: an isolation forest on rule statistics.

Rule statistics of every whole text come from one vectorised pass (see
``words``). A fixed base rule rejects texts under 50 words or made half of
repeated three-word windows. The forest judges the rest: each tree splits a
small subsample at random features and values; a text that random splits
isolate after few steps is unlike the others. Features that tell labelled rows
apart are drawn for almost all splits; beside that forest, one for each single
feature rejects texts far outside the range of the good rows. All labelled rows count:
the shares, ranges and thresholds are taken over every one of them, and each
tree's subsample is drawn from all; the threshold is the one that best separates
them while at most ``MAX_GOOD_LOSS`` of the good ones fall beyond it.

Null texts have no words and fail the base rule, as empty ones do. Repeated
rows each get their row. With an empty table, or without usable labels, no
text is anomalous: ``kept`` is then the base rule's verdict. Columns other
than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, per_text, query, stored
from .words import WordBatch, chunks, mix64
from ctxrec.operators.topk import top_k
from ctxrec.sources.tables import read_table

BINS = 4096
RATIOS = [f"x{j}" for j in range(7)]
TREES = 100
SUBSAMPLE = 256
RARE = 0.03
MAX_GOOD_LOSS = 0.002
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b"!?@^~_=+{}[]\\/", dtype=np.uint8)] = True


def _per_text(flags: np.ndarray, offset: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offset[1:]] - total[offset[:-1]]


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per owner."""
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n)


def statistics(texts: list[str | None]) -> pd.DataFrame:
    """COUNTS and EXTRA of each text."""
    parts = []
    for lo, hi in chunks(texts):
        w = WordBatch(texts[lo:hi])
        n, b = w.n, w.bytes
        lead = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80, dtype=np.int64)))
        chars = np.bincount(w.doc, weights=lead[w.end] - lead[w.start], minlength=n).astype(np.int64)
        # lines: between line feeds (the separator behind each text is one)
        stop = np.flatnonzero(b == 10)
        begin = np.concatenate(([0], stop[:-1] + 1))
        solid = np.concatenate(([0], np.cumsum(~w.space, dtype=np.int64)))
        full = solid[stop] > solid[begin]
        begin, stop = begin[full], stop[full]
        owner = np.searchsorted(w.offset, begin, side="right") - 1
        lines = np.bincount(owner, minlength=n)
        dup = lines - _distinct(owner, w.span_hash(begin, stop), n)
        at, h = w.run_hash(3)
        key = mix64(h ^ mix64(w.doc[at].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.zeros(len(w.start) + 2, dtype=bool)
        twice = at[count[inverse] > 1] if len(at) else at
        for j in range(3):
            hit[twice + j] = True
        repeat = np.bincount(w.doc, weights=hit[: len(w.start)], minlength=n).astype(np.int64)
        parts.append(pd.DataFrame({
            "n_words": w.count.astype(np.int64), "word_chars": chars, "n_symbols": _per_text(_SYMBOL[b], w.offset),
            "n_dup_lines": dup.astype(np.int64), "n_repeat_words": repeat, "n_lines": lines.astype(np.int64),
            "n_upper": _per_text((b >= 65) & (b <= 90), w.offset), "n_digits": _per_text((b >= 48) & (b <= 57), w.offset),
            "n_marks": _per_text(_MARK[b], w.offset), "n_distinct": _distinct(w.doc, w.hash, n).astype(np.int64)}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
        {c: np.array([], dtype=np.int64) for c in COUNTS + EXTRA})


def base_failed(s: pd.DataFrame) -> np.ndarray:
    return ((s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)).to_numpy()


def features(s: pd.DataFrame) -> np.ndarray:
    """Ratios the forest splits on."""
    words, chars = np.maximum(s.n_words, 1).to_numpy(float), np.maximum(s.word_chars, 1).to_numpy(float)
    lines = np.maximum(s.n_lines, 1).to_numpy(float)
    return np.column_stack([
        np.minimum(s.n_symbols / words, 1.0), s.n_repeat_words / words, s.n_dup_lines / lines,
        np.minimum(chars / words, 20.0) / 20.0, s.n_upper / chars, s.n_digits / chars,
        np.minimum(s.n_marks / words, 1.0)]).astype(float)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), cut, range of the feature in the
    node's part, left child (right = left + 1), path length."""
    feature: np.ndarray
    cut: np.ndarray
    spread: np.ndarray
    left: np.ndarray
    length: np.ndarray
    scale: float
    threshold: float = np.inf
    single: list[Forest] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): 1 is anomalous. A node
        whose cut lies further off than its part is wide does not count as a step:
        else a value far beyond all fitted ones scores as the largest of them."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, spread, left, length in zip(self.feature, self.cut, self.spread, self.left, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            far = np.zeros(len(x))
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                r, k = rows[inner], node[inner]
                value = x[r, f[inner]]
                far[r] += np.abs(value - cut[k]) > spread[k]
                node[inner] = left[k] + (value >= cut[k])
            total += np.maximum(length[node] - far, 0.0)
        return 2.0 ** (-total / len(self.feature) / self.scale)


def verdict(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, whether it is rejected): the score of the forest, or that of a
    single feature's forest where it lies beyond its threshold."""
    score = forest.score(x)
    bad = score > forest.threshold
    for one in forest.single:
        alone = one.score(x)
        bad |= alone > one.threshold
        score = np.where(alone > one.threshold, np.maximum(score, alone), score)
    return score, bad


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def separation(rows: DataFrame, n_good: int, n_bad: int) -> np.ndarray:
    """Shares the features are drawn with: the eighth power of |2 AUC - 1| of
    each feature alone (ties counting half), so that features which tell bad
    rows from good ones are split on and the others hardly ever. Every row
    counts: rows are summed per value, values are ranked inside BINS bins of the
    unit interval, and the sums of the bins (a bounded number) give the rest."""
    values = (rows.select("good", F.posexplode(F.array(*RATIOS)).alias("f", "v"))
              .groupBy("f", "v").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
              .withColumn("bin", F.floor(F.col("v") * BINS).cast("int")))
    upto = F.sum("g").over(Window.partitionBy("f", "bin").orderBy("v"))
    bins = (values.withColumn("below", upto - F.col("g")).groupBy("f", "bin")
            .agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.sum(F.col("b") * (F.col("below") + F.col("g") / 2)).alias("u"))
            .toPandas().sort_values(["f", "bin"]))
    out = np.zeros(len(RATIOS))
    for f, part in bins.groupby("f"):
        lower = part.g.cumsum() - part.g
        out[f] = (2 * (part.u + part.b * lower).sum() / (n_good * n_bad) - 1) ** 8
    return out / out.sum() if out.sum() > 0 else np.full(len(out), 1 / len(out))


def grow(parts: list[np.ndarray], share: np.ndarray, rng: np.random.Generator) -> Forest:
    """A tree over each part."""
    size = len(parts[0])
    limit = int(np.ceil(np.log2(max(size, 2)))) + 4
    trees = []
    for part in parts:
        nodes: list[list[float]] = [[-1, 0.0, 0.0, -1, 0.0]]
        work = [(0, part, 0)]
        while work:
            at, part, depth = work.pop()
            spread = part.max(axis=0) - part.min(axis=0)
            able = np.flatnonzero((spread > 0) & (share > 0))
            if depth >= limit or len(part) <= 1 or not len(able):
                nodes[at][4] = depth + _expected(len(part))
                continue
            f = int(rng.choice(able, p=share[able] / share[able].sum()))
            cut = float(part[:, f].min() + spread[f] * rng.uniform(1e-6, 1.0))
            nodes[at][:4] = [f, cut, spread[f], len(nodes)]
            right = part[:, f] >= cut
            for child in (part[~right], part[right]):
                nodes.append([-1, 0.0, 0.0, -1, 0.0])
                work.append((len(nodes) - 1, child, depth + 1))
        trees.append(np.array(nodes))
    grid = np.zeros((len(trees), max(map(len, trees)), 5))
    grid[:, :, 0] = -1
    for i, t in enumerate(trees):
        grid[i, : len(t)] = t
    return Forest(grid[:, :, 0].astype(int), grid[:, :, 1], grid[:, :, 2], grid[:, :, 3].astype(int), grid[:, :, 4],
                  max(_expected(size), 1e-9))


def draws(rows: DataFrame, size: int, rare: int, n_good: int, n_bad: int) -> list[np.ndarray]:
    """For each tree ``rare`` bad and ``size - rare`` good rows of all labelled
    ones, without replacement: those with the smallest hashes of row and tree.
    Bad rows are the rare ones, so splits reach their values and isolate them early."""
    wanted = {True: size - rare, False: rare}

    def chosen(slack: float) -> pd.DataFrame:
        limit = {g: min(1.0, (k + slack * (np.sqrt(k) + 1)) / max(n, 1)) for (g, k), n in zip(wanted.items(), (n_good, n_bad))}

        def pick(batches):
            for pdf in batches:
                key = pdf["key"].to_numpy().view(np.uint64)
                least = np.where(pdf["good"], limit[True], limit[False])
                for tree in range(TREES):
                    u = (mix64(key ^ mix64(np.full(1, tree + 1, dtype=np.uint64))) >> np.uint64(11)) / float(1 << 53)
                    yield pdf.loc[u < least, ["good", *RATIOS]].assign(tree=tree, u=u[u < least])

        found = rows.select("key", "good", *RATIOS).mapInPandas(
            pick, "good boolean, " + ", ".join(f"{c} double" for c in RATIOS) + ", tree int, u double")
        top = top_k(found, ["tree", "good"], [F.col("u"), *map(F.col, RATIOS)], max(wanted.values()))
        return (top.where(F.when(F.col("good"), F.col("rank") <= wanted[True]).otherwise(F.col("rank") <= wanted[False]))
                .toPandas().sort_values(["tree", "good", "rank"], ascending=[True, False, True]))

    got = chosen(10.0)
    if len(got) < TREES * size:  # a draw with too few rows
        got = chosen(np.inf)
    return [part[RATIOS].to_numpy(float) for _, part in got.groupby("tree")]


def calibrate(scores: DataFrame, n_good: int) -> float:
    """Score from which a row is rejected: most bad rows beyond it with at most
    MAX_GOOD_LOSS of the good ones, and half way down to the next good score."""
    among = min(int(MAX_GOOD_LOSS * n_good), n_good - 1) + 1
    allowed = scores.where("good").select("score").orderBy(F.desc("score")).limit(among).agg(F.min("score")).first()[0]
    beyond = scores.where(~F.col("good") & (F.col("score") > allowed)).agg(F.min("score")).first()[0]
    return np.inf if beyond is None else float((allowed + beyond) / 2)


def text_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, COUNTS and EXTRA of every row, stored: texts are read once and never move."""
    return stored(per_text(docs, ", ".join(f"{c} long" for c in COUNTS + EXTRA),
                           lambda texts: [c for _, c in statistics(texts).items()], id_col, text_col), "quality-statistics")


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Statistics of every labelled row: ``_id, _label``, COUNTS and EXTRA."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")))
    return stats.select(F.col(id_col).alias("_id"), *COUNTS, *EXTRA).join(known, "_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> pd.DataFrame:
    """All ``labelled_rows`` of a small table, to look at; ``fit`` does not use it."""
    rows = labelled_rows(text_statistics(docs, id_col, text_col), labels, id_col, label_col)
    return rows.toPandas().sort_values(["_id", "_label"], ignore_index=True)


def labelled_ratios(rows: DataFrame) -> DataFrame:
    """``key`` (a hash of the row), ``good`` and the ratios of the labelled rows that pass the base rule."""
    def run(batches):
        for s in batches:
            s = s[~base_failed(s)]
            yield pd.DataFrame(features(s), columns=RATIOS).assign(key=s["key"].to_numpy(), good=(s["_label"] == 1).to_numpy())

    return rows.select("_label", *COUNTS, *EXTRA, F.xxhash64("_id", "_label").alias("key")).mapInPandas(
        run, ", ".join(f"{c} double" for c in RATIOS) + ", key long, good boolean")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Forest | None:
    return fit_statistics(text_statistics(docs, id_col, text_col), labels, id_col, label_col)


def fit_statistics(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Forest | None:
    """The forest of all labelled rows. Shares, ranges and thresholds are sums
    over all of them; a tree is grown over a draw from all of them. The driver
    gets the draws (TREES of SUBSAMPLE rows), the sums of bins and the ends."""
    rows = stored(labelled_ratios(labelled_rows(stats, labels, id_col, label_col)), "quality-labelled")
    ends = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"),
                    *[f(F.when(F.col("good"), F.col(c))).alias(f"{n}_{c}") for c in RATIOS for n, f in (("min", F.min), ("max", F.max))]).first()
    if ends.good < 20 or not ends.bad:
        return None
    rng = np.random.default_rng(7)
    size = min(SUBSAMPLE, ends.good)
    rare = min(ends.bad, max(1, int(RARE * size)))
    parts = draws(rows, size, rare, ends.good, ends.bad)
    forest = grow(parts, separation(rows, ends.good, ends.bad), rng)
    # a forest for each ratio that varies among the good rows, which splits on it
    # alone; its subsamples hold the least and the largest value of all good rows,
    # so that only rows outside their range come near 1
    for f, c in enumerate(RATIOS):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if high > low:
            forest.single.append(grow([np.vstack((p[: size - rare], np.full(len(RATIOS), low), np.full(len(RATIOS), high))) for p in parts],
                                      np.eye(len(RATIOS))[f], rng))

    def judge(batches):
        for pdf in batches:
            x = pdf[RATIOS].to_numpy(float)
            out = pd.DataFrame({"good": pdf["good"].to_numpy(), "score": forest.score(x)})
            yield out.assign(single=[list(r) for r in np.column_stack([o.score(x) for o in forest.single] or [np.zeros(len(x))])])

    scores = stored(rows.mapInPandas(judge, "good boolean, score double, single array<double>"), "quality-scores")
    highest = scores.where("good").agg(*[F.max(F.col("single")[i]) for i in range(len(forest.single))]).first() if forest.single else ()
    for one, top in zip(forest.single, highest):  # half way from the highest score of a good row to 1
        one.threshold = float(top + 1) / 2
    forest.threshold = calibrate(scores, ends.good)
    return forest


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the statistics, ``base_failed``, ``kept`` and ``anomaly`` (forest score, null if base failed)."""
    stats = text_statistics(docs, id_col, text_col)
    forest = fit_statistics(stats, labels, id_col)
    made = StructType.fromDDL(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")

    def judge(batches):
        for batch in batches:
            s = batch.select(COUNTS + EXTRA).to_pandas()
            failed = base_failed(s)
            score, bad = np.full(len(s), np.nan), np.zeros(len(s), dtype=bool)
            if forest is not None and (~failed).any():
                score[~failed], bad[~failed] = verdict(forest, features(s[~failed]))
            judged = [pa.array(failed), pa.array(~failed & ~bad), pa.array(score, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in COUNTS), *judged], names=[id_col, *made.fieldNames()])

    return stats.select(id_col, *COUNTS, *EXTRA).mapInArrow(judge, StructType([stats.schema[id_col], *made.fields]))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    """Every document's rule statistics and verdict."""
    return quality_rules(documents(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "quality"))
