"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces of a tokenizer file lie in a double-array trie of their UTF-8
bytes. A text gets a dummy space in front, its spaces become the marker U+2581,
and the segmentation of least total cost (cost = minus log score) is found by
Viterbi; a code point that no piece covers becomes its byte pieces. Costs are
whole thousandths of a nat, so path sums are exact and equal on every machine;
of equal paths the one whose last piece is longest wins at every position.

No piece holds a marker behind another character, so texts are cut in front of
markers without changing the result. New stretches of about a million
characters are segmented together; their ids go into one flat array, and a text
is a gather from it. What a worker keeps is bounded in bytes.

A Unigram file's own log scores are used; a merge file holds merge ranks, which
count as ranks of a Zipf law: log score = -log(2 + rank).

Null texts have no ids (an empty list) and a null round trip; empty texts have
none and round-trip. Texts of any length are encoded whole, a piece between two
stretches at a time. Repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
A text that itself holds U+2581 decodes with a space there (``round_trip``
false), as the marker stands for a space.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, per_text, query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: the stretch of a tokenizer whose pieces hold markers inside
WHOLE = r"(?s).+"
#: added to the largest cost for a code point without a piece
UNKNOWN_PENALTY = 10
#: what is known of stretches takes about this many bytes a worker
KNOWN_BYTES = 128 << 20
_ENTRY_BYTES = 180
#: characters segmented together
PIECE = 1 << 20
_FAR = np.iinfo(np.int64).max // 4


def build_double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of node s by byte c is t = base[s] + c + 1
    if check[t] == s; value[t] is the key's index or -1. Node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for i, key in enumerate(keys):
        node = 0
        for c in key:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = len(children)
                children[node][c] = nxt
                children.append({})
                ends.append(-1)
            node = nxt
        ends[node] = i
    size = len(children) * 2 + 1024
    base, check, value = (np.full(size, x, dtype=np.int64) for x in (0, -1, -1))
    taken = np.zeros(size, dtype=bool)
    taken[0] = True
    place = {0: 0}
    value[0] = ends[0]
    hint = [1] * 257  # where to look first, by number of children
    order = [0]
    for node in order:  # breadth first; grows while it is read
        kids = sorted(children[node])
        if not kids:
            continue
        steps = np.array(kids) + 1
        look = hint[len(kids)]
        while True:
            if look + 8192 + 260 >= len(taken):
                grow = len(taken) + 8192
                base, check, value = (np.concatenate((a, np.full(grow, x, dtype=np.int64)))
                                      for a, x in ((base, 0), (check, -1), (value, -1)))
                taken = np.concatenate((taken, np.zeros(grow, dtype=bool)))
            free = np.flatnonzero(~taken[look: look + 4096]) + look - steps[0]
            free = free[free >= 0]
            fit = free[~taken[free[:, None] + steps].any(axis=1)]
            if len(fit):
                b = int(fit[0])
                hint[len(kids)] = max(look, b + int(steps[0]) - 512)
                break
            look += 4096
        at = place[node]
        base[at] = b
        for c in kids:
            t, kid = b + c + 1, children[node][c]
            taken[t] = True
            check[t] = at
            value[t] = ends[kid]
            place[kid] = t
            order.append(kid)
    last = int(np.flatnonzero(taken).max()) + 260
    pad = max(0, last - len(base))
    return tuple(np.concatenate((a, np.full(pad, x, dtype=np.int64)))[:last].astype(np.int32)
                 for a, x in ((base, 0), (check, -1), (value, -1)))


@dataclass
class Pieces:
    """What tasks need of a tokenizer: small arrays, about 3 MB."""
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    ids: np.ndarray        # piece id of each trie key
    cost: np.ndarray       # cost of each trie key
    unknown_cost: int
    byte_ids: np.ndarray   # piece id of each byte
    raw: list[bytes]       # decoded bytes of each piece id
    is_byte: np.ndarray
    longest: int
    cut: str               # pattern of the stretches

    @functools.cached_property
    def raw_size(self) -> np.ndarray:
        return np.array([len(r) for r in self.raw], dtype=np.int64)

    def segment(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each stretch, all ids) by Viterbi, all stretches (none empty) at once."""
        raw = [s.encode() for s in stretches]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        owner = np.repeat(np.arange(len(raw)), size)
        stop = (begin + size)[owner]
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        follow = np.concatenate((lead[1:], [len(b)]))  # the next code point
        # pieces that start at each code point: walk the trie from all of them
        state, at, start = np.zeros(len(lead), dtype=np.int64), lead.copy(), np.arange(len(lead))
        m_start, m_end, m_key = [], [], []
        for _ in range(self.longest):
            live = at < stop[lead[start]]
            state, at, start = state[live], at[live], start[live]
            if not len(at):
                break
            t = self.base[state].astype(np.int64) + b[at] + 1
            ok = self.check[t] == state
            state, at, start = t[ok], at[ok] + 1, start[ok]
            hit = self.value[state] >= 0
            m_start.append(start[hit])
            m_end.append(at[hit])
            m_key.append(self.value[state[hit]])
        m_start, m_end, m_key = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
                                 for x in (m_start, m_end, m_key))
        single = np.zeros(len(lead), dtype=bool)
        single[m_start[m_end == follow[m_start]]] = True
        lone = np.flatnonzero(~single)
        m_start = np.concatenate((m_start, lone))
        m_end = np.concatenate((m_end, follow[lone]))
        m_cost = np.concatenate((self.cost[m_key], np.full(len(lone), self.unknown_cost)))
        m_key = np.concatenate((m_key, np.full(len(lone), -1)))
        # forward: positions in step over all stretches, no two matches of a step share an end
        m_at = lead[m_start]
        step = m_at - begin[owner[m_at]]
        order = np.argsort(step, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(step[order]) > 0, [True])))
        # ends are positions counted per stretch with one more slot each
        slot = np.arange(len(b)) + owner
        best = np.full(len(b) + len(raw), _FAR, dtype=np.int64)
        best[begin + np.arange(len(raw))] = 0
        came = np.full(len(best), -1, dtype=np.int64)
        s_from, s_to = slot[m_at], m_end + owner[m_at]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            m = order[lo:hi]
            total = best[s_from[m]] + m_cost[m]
            better = total < best[s_to[m]]
            m = m[better]
            best[s_to[m]] = total[better]
            came[s_to[m]] = m
        # backward: one match of every stretch a round
        live = np.arange(len(raw))
        here, floor = begin + size + live, begin + live
        of, match = [], []
        while len(live):
            m = came[here]
            of.append(live)
            match.append(m)
            back = s_from[m]
            on = back > floor
            live, here, floor = live[on], back[on], floor[on]
        rounds = np.repeat(np.arange(len(of)), [len(x) for x in of])
        of, match = np.concatenate(of), np.concatenate(match)
        order = np.lexsort((-rounds, of))
        of, match = of[order], match[order]
        spelled = m_key[match] < 0
        width = np.where(spelled, m_end[match] - m_at[match], 1)
        first = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), dtype=np.int32)
        ids[first[~spelled]] = self.ids[m_key[match[~spelled]]]
        at, step = np.repeat(m_at[match[spelled]], width[spelled]), width[spelled]
        inner = np.arange(len(at)) - np.repeat(np.cumsum(step) - step, step)
        ids[np.repeat(first[spelled], step) + inner] = self.byte_ids[b[at + inner]]
        return np.bincount(of, weights=width, minlength=len(raw)).astype(np.int64), ids

    def learn(self, stretches: set[str], known: "Known") -> None:
        """Segment the stretches not known yet. What is known is given up first if it has grown too large."""
        if known.bytes > KNOWN_BYTES:
            known.clear()
        new = list(stretches.difference(known.index))
        if not new:
            return
        size, ids = self.segment(new)
        # does each stretch decode to itself? One buffer against the other
        back = np.frombuffer(b"".join(map(self.raw.__getitem__, ids.tolist())), dtype=np.uint8)
        want = [s.replace(MARK, " ").encode() for s in new]
        width = np.array([len(w) for w in want])
        got = np.add.reduceat(self.raw_size[ids], np.cumsum(size) - size)
        if (got == width).all():
            differs = back != np.frombuffer(b"".join(want), dtype=np.uint8)
            same = ~np.logical_or.reduceat(differs, np.cumsum(width) - width)
        else:
            same = np.zeros(len(new), dtype=bool)  # these texts are decoded one by one
        known.add(new, size, ids, same)

    def pieces_of(self, marked: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters, cut between stretches."""
        lo = 0
        while lo < len(marked):
            m = re.compile(f"(?<=[^{MARK}]){MARK}").search(marked, lo + PIECE) if self.cut != WHOLE else None
            hi = m.start() if m else len(marked)
            yield marked[lo:hi]
            lo = hi

    def encode_flat(self, texts: list[str | None], known: "Known") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids, whether all stretches of the text decode to themselves)."""
        find = re.compile(self.cut).findall
        size, odd = (np.zeros(len(texts), dtype=np.int64) for _ in range(2))
        flat: list[np.ndarray] = []
        held: list[tuple[int, list[str]]] = []
        chars = 0

        def settle() -> None:
            self.learn(set().union(*(p for _, p in held)), known)
            count = [len(p) for _, p in held]
            at = np.fromiter(map(known.index.__getitem__, chain.from_iterable(p for _, p in held)), dtype=np.int64, count=sum(count))
            owner = np.repeat(np.array([i for i, _ in held], dtype=np.int64), count)
            width = known.size[at]
            flat.append(known.ids[np.repeat(known.begin[at] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))])
            np.add.at(size, owner, width)
            np.add.at(odd, owner, ~known.same[at])
            held.clear()

        for i, t in enumerate(texts):
            for piece in self.pieces_of(MARK + t.replace(" ", MARK)) if t else ():
                held.append((i, find(piece)))
                chars += len(piece)
                if chars >= PIECE:
                    settle()
                    chars = 0
        if held:
            settle()
        return size, np.concatenate([np.zeros(0, dtype=np.int32), *flat]), odd == 0

    def encode(self, texts: list[str | None], cache: dict[str, "Known"]) -> list[np.ndarray]:
        """Ids of each text; ``cache`` keeps what is known between calls."""
        size, flat, _ = self.encode_flat(texts, cache.setdefault("known", Known()))
        return np.split(flat, np.cumsum(size)[:-1]) if len(texts) else []

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Known:
    """Stretches met so far: their ids lie one after the other in a flat array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size, self.begin = (np.zeros(0, dtype=np.int64) for _ in range(2))
        self.ids, self.same = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
        self.bytes = 0

    def add(self, stretches: list[str], size: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        self.index.update(zip(stretches, range(len(self.index), len(self.index) + len(stretches))))
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
        self.size, self.ids, self.same = (np.concatenate(x) for x in ((self.size, size), (self.ids, ids), (self.same, same)))
        self.bytes += sum(map(len, stretches)) * 2 + len(stretches) * _ENTRY_BYTES + ids.nbytes


@functools.lru_cache(maxsize=4)
def load_pieces(path: str = MODEL) -> Pieces:
    """Read a SentencePiece file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    name = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    score = np.array([sp.get_score(i) for i in plain])
    merges = len(score) > 1 and bool((score == np.round(score)).all())
    cost = np.round(1000 * (np.log(2.0 - score) if merges else -score)).astype(np.int64)
    keys = [name[i].encode() for i in plain]
    base, check, value = build_double_array(keys)
    byte_ids = np.zeros(256, dtype=np.int64)
    raw, is_byte = [], np.zeros(n, dtype=bool)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(name[i][3:5], 16)] = i
            is_byte[i] = True
            raw.append(bytes([int(name[i][3:5], 16)]))
        else:
            raw.append(b"" if sp.is_control(i) else name[i].replace(MARK, " ").encode())
    inner = any(MARK in k.lstrip(MARK) for k in (name[i] for i in plain))
    if inner:
        cut = WHOLE
    elif any("\n" in name[i] for i in plain):
        cut = rf"{MARK}*[^{MARK}]+|{MARK}+"
    else:
        cut = rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+"
    return Pieces(base, check, value, np.array(plain), cost, int(cost.max()) + UNKNOWN_PENALTY, byte_ids, raw, is_byte,
                  max(map(len, keys)), cut)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text",
           extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra``, n_tokens, n_byte_tokens, round_trip and ids of every text."""
    pieces = docs.sparkSession.sparkContext.broadcast(pieces)  # about 3 MB, a property of the tokenizer
    known = Known()

    def run(texts):
        p = pieces.value
        size, flat, fine = p.encode_flat(texts, known)
        ends = np.cumsum(size)
        spelled = np.concatenate(([0], np.cumsum(p.is_byte[flat])))
        same = [None if t is None else MARK not in t if ok else p.decode(flat[e - n: e].tolist()) == t
                for t, n, e, ok in zip(texts, size, ends, fine)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
        return [size, spelled[ends] - spelled[ends - size], same, lists]

    return per_text(docs, "n_tokens long, n_byte_tokens long, round_trip boolean, ids array<int>", run,
                    id_col, text_col, extra)


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every list of ids (null for a null list)."""
    pieces = encoded.sparkSession.sparkContext.broadcast(pieces)
    return per_text(encoded, "text string",
                    lambda lists: [[None if x is None else pieces.value.decode(x) for x in lists]], id_col, ids_col)


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """Ids of every document, decoded again."""
    return encode(documents(spark, sf_dir), load_pieces())
