"""Token counts of whole texts by the whole-token shortcut.

A byte-level merge tokenizer cuts a text into pre-tokens and merges the bytes
of each on its own, so a text's count is the sum over its pre-tokens. Most
pre-tokens of real text are entries of the vocabulary, but an entry need not
come out whole when its own bytes are merged. Which do is proved once, on the
driver, by merging every vocabulary string; a pre-token among these counts one
without any merging. Only the rest is merged: the new ones of a chunk together,
in numpy rounds that merge the lowest-ranked pair of every word at once, and
their counts are kept in a table bounded in bytes.

The pre-token pattern names its letters, digits and blanks; which code points
those are depends on a library's Unicode version, so the classes are read from
the tokenizer itself. Special strings inside a text are one token each and cut
it, as is the library's default.

Null texts count as empty: no bytes, no tokens. Texts of any length are counted
whole, cut into stretches at blanks, where no pre-token can reach across, so
memory is bounded by the longest single pre-token. Repeated rows and null ids
each keep their row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, per_text, query

LIMIT = 512
#: characters of a stretch of a long text
STRETCH = 1 << 20
#: kept counts take about this many bytes a worker
CACHE_BYTES = 48 << 20
_ENTRY_BYTES = 140
#: longer pre-tokens are merged each time they come
KEPT_CHARS = 64
_NONE = np.iinfo(np.int32).max
#: fixed value: the suffixes that the pre-token pattern cuts off first
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def code_point_classes(pre_tokenizer) -> dict[str, str]:
    """Character-class bodies of the letters, digits and blanks of a library's
    pre-token pattern: a code point is a symbol if it joins a '%', a letter if it
    joins an 'a', a digit if it joins a '1', else a blank."""
    found: dict[str, list[list[int]]] = {"letter": [], "digit": [], "blank": []}
    probes = (("symbol", "%"), ("letter", "a"), ("digit", "1"))  # most code points first

    def add(kind: str, cp: int) -> None:
        if kind == "symbol":
            return
        spans = found[kind]
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])

    step = 4096
    for lo in range(0, 0x110000, step):
        points = [c for c in range(lo, lo + step) if not 0xD800 <= c < 0xE000]
        left = points
        for kind, before in probes:
            if not left:
                break
            text = "".join(f"\n{before}{chr(c)}" for c in left)
            starts = {a for _, (a, _) in pre_tokenizer.pre_tokenize_str(text)}
            joined = [c for i, c in enumerate(left) if 3 * i + 2 not in starts]
            for c in joined:
                add(kind, c)
            gone = set(joined)
            left = [c for c in left if c not in gone]
        for c in left:
            add("blank", c)
    return {kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) for kind, spans in found.items()}


@dataclass
class TokenCounter:
    """What tasks need of a tokenizer, about 2 MB."""
    pattern: str                # one pre-token
    cut: str                    # a blank behind another character
    special: str                # any special string, or empty
    symbol: np.ndarray          # vocabulary id of each byte
    pairs: np.ndarray           # left id * size + right id of every merge, ascending
    rank: np.ndarray            # its rank
    made: np.ndarray            # id made by the merge of each rank
    size: int
    whole: frozenset[str] = frozenset()
    kept: dict[str, int] = field(default_factory=dict)
    kept_bytes: int = 0

    def __getstate__(self):
        return self.__dict__ | {"kept": {}, "kept_bytes": 0}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], _NONE).astype(np.int32)

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (not empty) by merging its bytes. In every round
        each word merges all places of its lowest-ranked pair, left to right."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        out = np.ones(len(raw), dtype=np.int64)
        sym = self.symbol[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.pair_rank(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.concatenate((first, [len(sym)])))
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            out[word[first[done]]] = length[done]
            live = np.repeat(~done, length)
            hit = live & (rank == np.repeat(low, length))
            at = np.flatnonzero(hit)
            if not len(at):
                break
            if len(at) > 1:  # of places that overlap (one symbol repeated) every second one
                fresh = np.concatenate(([True], (np.diff(at) > 1)))
                run = np.flatnonzero(fresh)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
                at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            live[at + 1] = False
            changed = np.zeros(len(sym), dtype=bool)
            changed[at] = True
            before = at[at > 0] - 1
            changed[before] = True
            eaten = before[~live[before]]  # the left neighbour was eaten too: the one before it changed
            changed[eaten[eaten > 0] - 1] = True
            sym, word, rank, changed = sym[live], word[live], rank[live], changed[live]
            at = np.flatnonzero(changed)
            last = (at + 1 >= len(sym))
            after = np.minimum(at + 1, len(sym) - 1)
            rank[at] = np.where(last | (word[after] != word[at]), _NONE, self.pair_rank(sym[at], sym[after]))
        return out

    def stretches(self, text: str) -> Iterator[str]:
        """The text in pieces of about STRETCH characters whose pre-tokens are
        those of the whole: cut in front of a blank that follows another character."""
        if len(text) <= STRETCH:
            yield text
            return
        cut, lo = re.compile(self.cut), 0
        while lo < len(text):
            m = cut.search(text, lo + STRETCH)
            hi = m.start() if m else len(text)
            yield text[lo:hi]
            lo = hi

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. New pre-tokens of about STRETCH characters are merged together."""
        find = re.compile(self.pattern).findall
        special = re.compile(self.special) if self.special else None
        out = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            long = self.learn(set().union(*(words for _, words in held)))
            for i, words in held:
                out[i] += sum(map(self.kept.__getitem__, words))
            for w in long:
                del self.kept[w]
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if special:
                parts = special.split(text)
                out[i] = len(parts) - 1
            for part in parts:
                for piece in self.stretches(part):
                    held.append((i, find(piece)))
                    size += len(piece)
                    if size >= STRETCH:
                        settle()
                        size = 0
        settle()
        return out

    def learn(self, words: set[str]) -> list[str]:
        """Count the words not known yet; returns those too long to be kept."""
        if not self.kept or self.kept_bytes > CACHE_BYTES:
            self.kept, self.kept_bytes = dict.fromkeys(self.whole, 1), 0
        new = list(words.difference(self.kept))
        if not new:
            return []
        self.kept.update(zip(new, self.merge(new).tolist()))
        long = [w for w in new if len(w) > KEPT_CHARS]
        self.kept_bytes += sum(map(len, new)) - sum(map(len, long)) + _ENTRY_BYTES * (len(new) - len(long))
        return long


@functools.lru_cache(maxsize=4)
def load_counter(path: str) -> TokenCounter:
    """Read a byte-level merge file on the driver and prove its whole tokens."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if (model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
            or spec["normalizer"] or model["dropout"] or model["ignore_merges"] or odd):
        raise ValueError(f"{path}: not a plain byte-level merge tokenizer")
    vocab, names = model["vocab"], byte_names()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank_of = {a + b: i for i, (a, b) in enumerate(merges)}
    # a round may merge every place of a pair only if what it makes never belongs to a lower-ranked pair
    if len(rank_of) < len(merges) or any(rank_of.get(s, -1) >= i for i, m in enumerate(merges) for s in m):
        raise ValueError(f"{path}: merges are not in the order in which they build on each other")
    size = max(vocab.values()) + 1
    symbol = np.zeros(256, dtype=np.int32)
    for name, b in names.items():
        symbol[b] = vocab[name]
    pairs = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(pairs)
    made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)

    of = code_point_classes(Tokenizer.from_file(path).pre_tokenizer)
    other = f"[^{of['blank']}{of['letter']}{of['digit']}]"
    pattern = "|".join([*SUFFIXES, f" ?[{of['letter']}]+", f" ?[{of['digit']}]+", f" ?{other}+",
                        f"[{of['blank']}]+(?![^{of['blank']}])", f"[{of['blank']}]+"])
    special = "|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))
    counter = TokenCounter(pattern, f"(?<=[^{of['blank']}])[{of['blank']}]", special, symbol, pairs[order],
                           order.astype(np.int32), made, size)
    strings = []
    for name in vocab:
        try:
            strings.append(bytes(names[c] for c in name).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # a special string, or part of a code point: never a pre-token
    strings = [s for s in strings if s]
    counter.whole = frozenset(s for s, n in zip(strings, counter.merge(strings).tolist()) if n == 1)
    return counter


def count_tokens(docs: DataFrame, counter: TokenCounter, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(counter)  # a property of the tokenizer, about 2 MB

    def run(texts):
        tokens = sent.value.count(texts)
        size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
        return [size, tokens, tokens > limit]

    return per_text(docs, "n_bytes long, n_tokens long, over_limit boolean", run, id_col, text_col, extra)


@query("op13_token_count")
def op13_token_count(spark, sf_dir):
    """Token counts of every document."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), load_counter(public_tokenizers.path("byte_bpe_50k.json")))
