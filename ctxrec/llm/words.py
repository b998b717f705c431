"""Vectorised word handling for tasks that run numpy on batches of texts.

A batch of texts is laid out as one byte buffer; word bounds, word hashes and
hashes of word runs come from a few whole-buffer numpy passes, so the cost per
word is tens of nanoseconds and no Python object is made per word.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return (UTF-8 never holds these bytes inside a longer code
point). Null texts count as empty. Hashes are 64 bits wide and equal on every
machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads every input bit over the whole word."""
    x = np.asarray(x, dtype=_U) + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the largest table made so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, n + 1)
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_U)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


_BYTE = mix64(np.arange(256, dtype=_U))


class WordBatch:
    """Words of several texts: ``start``/``end`` byte bounds, ``doc`` (index of
    the text), ``hash``; ``offset`` holds where each text begins."""

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        if lower:
            raw = [b.lower() for b in raw]  # bytes.lower touches A-Z only
        self.n = len(raw)
        sizes = np.fromiter((len(b) + 1 for b in raw), dtype=np.int64, count=self.n)
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", dtype=np.uint8)
        b = self.bytes
        self.space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self._prefix: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span (a function of its bytes alone)."""
        if self._prefix is None:
            p = _power_table(_BASE, len(self.bytes))
            self._prefix = np.concatenate(
                (np.zeros(1, dtype=_U), np.cumsum(_BYTE[self.bytes] * p[: len(self.bytes)], dtype=_U)))
        inv = _power_table(_INV, len(self.bytes))
        return mix64((self._prefix[end] - self._prefix[start]) * inv[start] + (end - start).astype(_U))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def run_hash(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word index, hash) of every run of k words inside one text."""
        h, m = self.hash, len(self.start)
        if m < k:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=_U)
        acc = np.zeros(m - k + 1, dtype=_U)
        for j in range(k):
            acc = acc * _U(0xD6E8FEB86659FD93) + h[j: m - k + 1 + j]
        at = np.flatnonzero(self.doc[: m - k + 1] == self.doc[k - 1:])
        return at, mix64(acc[at] + _U(k))

    def whole_hash(self, docs: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each named text (with words)."""
        out = np.zeros(len(docs), dtype=_U)
        for i, d in enumerate(docs):
            acc = 0
            for w in self.hash[self.first[d]: self.first[d + 1]]:
                acc = (acc * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF
            out[i] = acc
        return mix64(out + self.count[docs].astype(_U))


def chunks(texts: Sequence[str | None], max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each, so that the arrays of a
    chunk stay small; a text longer than that is a chunk of its own."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > max_bytes:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: Sequence[str | None], k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """The set of k-word shingle hashes of each text, sorted. A text of fewer
    words (but some) has one element, its whole sequence; else the set is empty."""
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], lower=lower)
        at, h = batch.run_hash(k)
        owner = batch.doc[at]
        cuts = np.searchsorted(owner, np.arange(batch.n + 1))
        short = np.flatnonzero((batch.count > 0) & (batch.count < k))
        whole = dict(zip(short.tolist(), batch.whole_hash(short)))
        for d in range(batch.n):
            if d in whole:
                yield np.array([whole[d]], dtype=_U)
            else:
                yield np.unique(h[cuts[d]: cuts[d + 1]])
