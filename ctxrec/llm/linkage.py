"""Links between near-equal sets, and their components, without all pairs.

Nodes are distinct sets (``s``, 64-bit hash of the set), each with its size
``n`` and a parity sketch. Keys say which nodes may be linked. Every key's
nodes are first held against the key's smallest node; links are verified on
the texts and joined into components. A key whose nodes lie in one component
is done. The nodes of the other keys are compared by sketch inside tasks (in
blocks, so that no task holds a whole large group), only across components,
and what the sketches cannot rule out is verified. A group that would give very
many pairs gives a spanning forest first and is compared again afterwards, until
nothing is left: every two nodes with a common key are in one component, or
ruled out by their sketches, or verified not to be linked.

The sketch flips one bit for each element (its hash modulo a power of two), so
two sketches differ in at most as many bits as the sets' symmetric difference
has elements; a sketch folds to half its bits by XOR of its halves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .words import mix64, shingle_sets

_U = np.uint64
BLOCK = 2048
NUM, DEN = 4, 5  # Jaccard similarity of 0.8 or more


def most_different(total: int, num: int = NUM, den: int = DEN) -> int:
    """Largest symmetric difference of two linked sets of ``total`` elements together."""
    return total * (den - num) // (den + num)


def set_id(h: np.ndarray) -> int:
    """64-bit hash of a set of hashes, as a signed number."""
    mixed = mix64(h ^ _U(0x5851F42D4C957F2D))
    both = mix64(np.array([mixed.sum(dtype=_U), np.bitwise_xor.reduce(mixed) + _U(len(h))], dtype=_U))
    return int(mix64(both[:1] * _U(3) + both[1:]).view(np.int64)[0])


def sketch(h: np.ndarray) -> bytes:
    """Parity sketch of a set: a power of two of at least 2 n bits, 128 at least."""
    bits = max(128, 1 << int(2 * len(h) - 1).bit_length())
    at = (mix64(h ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest."""
    size = min(map(len, sketches))
    rows = np.empty((len(sketches), size), dtype=np.uint8)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, dtype=np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2:]
        rows[i] = x
    return rows.view(np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component. Labels spread
    along edges and jump to their label's label until nothing changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        near = (both.join(label.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = step.checkpoint()
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = step.join(jump, "label").select("node", "old", F.col("next").alias("label")).checkpoint()
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def _compare(s, comp, block, n, sketches, most: int, num: int, den: int):
    """Pairs of one group in different components that the sketches allow, and
    whether that is all of them: beyond ``most`` pairs per row, only a spanning
    forest of the components is given."""
    order = sorted(set(zip(s, comp, block, n, sketches)), key=lambda r: r[0])
    size: dict = {}
    for r in order:
        size[r[1]] = size.get(r[1], 0) + 1
    if len(size) < 2:
        return [], True
    largest = max(size, key=lambda c: (size[c], c))
    order.sort(key=lambda r: r[1] == largest)  # rows of the largest component need not be compared among themselves
    ids = [r[0] for r in order]
    labels = np.unique([r[1] for r in order], return_inverse=True)[1]
    blocks, count, x = np.array([r[2] for r in order]), np.array([r[3] for r in order]), _fold([r[4] for r in order])
    cross = len(set(blocks.tolist())) > 1
    root = labels.copy()
    out, tree = [], []
    for i in range(len(order) - size[largest]):
        total = count[i] + count[i + 1:]
        may = ((labels[i + 1:] != labels[i])
               & (num * np.maximum(count[i], count[i + 1:]) <= den * np.minimum(count[i], count[i + 1:])))
        if cross:
            may &= blocks[i + 1:] != blocks[i]
        at = np.flatnonzero(may)
        if not len(at):
            continue
        apart = np.bitwise_count(x[i] ^ x[i + 1 + at]).sum(axis=1)
        for j in at[apart <= total[at] * (den - num) // (den + num)] + i + 1:
            if len(out) <= most * len(order):
                out.append((ids[i], ids[j]))
            if root[i] != root[j]:
                tree.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return (out, True) if len(out) <= most * len(order) else (tree, False)


SMALL = 16
COLUMNS = ["key", "lo", "hi", "s", "comp", "block", "n", "sketch"]


def _small_pairs(key, group, s, comp, n, sketches, small, num: int, den: int):
    """Pairs of all small groups at once: rows some places apart in one group."""
    left, right = [], []
    for lag in range(1, SMALL):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & small[:-lag])
        if not len(i):
            break
        j = i + lag
        ok = (comp[i] != comp[j]) & (num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j]))
        left.append(i[ok])
        right.append(j[ok])
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    pair = np.unique(np.stack([np.minimum(s[i], s[j]), np.maximum(s[i], s[j])], axis=1), axis=0, return_index=True)[1]
    i, j = i[pair], j[pair]
    size = np.array([len(x) for x in sketches])
    keep = np.zeros(len(i), dtype=bool)
    for p in np.unique(size[i]):
        for q in np.unique(size[j][size[i] == p]):
            at = np.flatnonzero((size[i] == p) & (size[j] == q))
            x, y = (np.frombuffer(b"".join(sketches[r] for r in rows[at]), dtype=np.uint8).reshape(len(at), w)
                    for rows, w in ((i, p), (j, q)))
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
            apart = np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint64)).sum(axis=1)
            keep[at] = apart <= (n[i[at]] + n[j[at]]) * (den - num) // (den + num)
    return np.minimum(s[i[keep]], s[j[keep]]), np.maximum(s[i[keep]], s[j[keep]])


def _pairs(groups: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """Candidate pairs (a < b) of key groups (COLUMNS); a row with a key and no
    pair names a group of which only a forest is given."""
    def work(cols):
        key, lo, hi, s, comp, block, n = cols[:7]
        sketches = cols[7]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        small = ((size <= SMALL) & (lo[start] == hi[start]))[group]
        a, b = (x.tolist() for x in _small_pairs(key, group, s, comp, n, sketches, small, num, den))
        again = []
        for g in np.flatnonzero(~small[start]):
            part = slice(start[g], start[g] + size[g])
            found, whole = _compare(s[part].tolist(), comp[part].tolist(), block[part].tolist(), n[part].tolist(),
                                    sketches[part], most, num, den)
            a += [min(p) for p in found]
            b += [max(p) for p in found]
            if not whole:
                again.append(int(key[start[g]]))
        none = [None] * len(again)
        return pa.RecordBatch.from_arrays(
            [pa.array(a + none, pa.int64()), pa.array(b + none, pa.int64()), pa.array([None] * len(a) + again, pa.int64())],
            names=["a", "b", "key"])

    def run(batches):
        held: list = []

        def gathered():
            cols = [np.concatenate([h[c] for h in held]) for c in range(7)]
            return cols + [[x for h in held for x in h[7]]]

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in COLUMNS]
            held.append([c.to_numpy(zero_copy_only=False) for c in cols[:7]] + [cols[7].to_pylist()])
            if sum(len(h[0]) for h in held) >= 20_000:
                cols = gathered()
                last = [c[-1] for c in cols[:3]]
                cut = int(np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]) | (cols[2] != last[2]))[-1:].sum()) + 1
                if cut > 1:  # all but the last group, which may go on
                    yield work([c[:cut] for c in cols])
                    held = [[c[cut:] for c in cols]]
                else:
                    held = [cols]
        if held:
            yield work(gathered())

    return (groups.select(*COLUMNS).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(run, "a long, b long, key long"))


def _sketched(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and sketches allow."""
    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("s").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"x_{c}")), c)

    def run(batches):
        for batch in batches:
            a, b, na, nb, xa, xb = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                                    for c in ("a", "b", "n_a", "n_b", "x_a", "x_b"))
            keep = [num * max(p, q) <= den * min(p, q)
                    and int(np.bitwise_count(np.bitwise_xor(*_fold([x, y]))).sum()) <= most_different(p + q, num, den)
                    for p, q, x, y in zip(na, nb, xa, xb)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)],
                                             names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], k: int, lower: bool, num: int, den: int) -> DataFrame:
    """(a, b, linked) by the exact Jaccard similarity of the shingle sets."""
    ends = stored(pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct(), "ends")
    found = texts(ends)
    for c in ("a", "b"):
        pairs = pairs.join(found.select(F.col("s").alias(c), F.col("text").alias(f"t_{c}")), c)

    def run(batches):
        for batch in batches:
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "t_a", "t_b"))
            linked = []
            for x, y in zip(shingle_sets(ta.to_pylist(), k, lower), shingle_sets(tb.to_pylist(), k, lower)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long, linked boolean")


def linked_components(keys: DataFrame, nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], name: str,
                      k: int = 5, lower: bool = True, num: int = NUM, den: int = DEN) -> DataFrame:
    """(s, comp) of every node with a link. ``keys``: (key, s); ``nodes``: (s,
    n, sketch), one row each; ``texts(df of s)``: (s, text) of those nodes."""
    w = Window.partitionBy("key")
    shared = stored(keys.select("key", "s", F.min("s").over(w).alias("hub"), F.max("s").over(w).alias("top"))
                    .where("hub != top").select("key", "s", "hub"), f"{name}-keys")
    pairs = shared.where("s != hub").select(F.col("hub").alias("a"), F.col("s").alias("b")).distinct()
    checked = stored(_verified(stored(_sketched(pairs, nodes, num, den), f"{name}-near"), texts, k, lower, num, den), f"{name}-star")
    label = components(checked.where("linked")).select(F.col("node").alias("s"), F.col("label").alias("comp")).checkpoint()
    most, keys_left = 1, shared
    while True:
        rows = keys_left.join(label, "s", "left").select("key", "s", F.coalesce("comp", "s").alias("comp"))
        rows = (rows.distinct().withColumn("low", F.min("comp").over(w)).withColumn("top", F.max("comp").over(w))
                .withColumn("size", F.count("s").over(w)).where("low != top"))
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = (rows.withColumn("block", F.pmod(F.xxhash64("s"), parts).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
                .select("key", "s", "comp", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
        rows = rows.join(nodes.select("s", "n", "sketch"), "s")
        found = stored(_pairs(rows, most, num, den), f"{name}-pairs")
        pairs = stored(found.where("a is not null").select("a", "b").distinct()
                       .join(checked.select("a", "b"), ["a", "b"], "left_anti"), f"{name}-near")
        new = stored(_verified(pairs, texts, k, lower, num, den), f"{name}-checked")
        links = new.where("linked")
        if not links.isEmpty():
            of = lambda c: label.select(F.col("s").alias(c), F.col("comp").alias(f"c_{c}"))
            lifted = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
                      .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a != b"))
            up = components(lifted).select(F.col("node").alias("comp"), F.col("label").alias("up"))
            own = links.select(F.col("a").alias("s")).union(links.select("b")).distinct().withColumn("comp", F.col("s"))
            every = label.union(own.join(label, "s", "left_anti").select("s", "comp"))
            label = (every.join(up, "comp", "left").select("s", F.coalesce("up", "comp").alias("comp")).checkpoint())
        again = found.where("key is not null").select("key").distinct()
        if again.isEmpty():
            return label
        # groups with too many pairs for one turn: most are in one component by now; more pairs a row next time
        keys_left = shared.join(again, "key", "left_semi")
        checked = checked.unionByName(new)
        most *= 4
