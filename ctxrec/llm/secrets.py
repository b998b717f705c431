"""Secret scans: fixed patterns plus the guess cost of credential values.

Base patterns find assignments, access keys and hex strings in every whole
text. Beside them, the value after a credential word (``pwd: ...``) is judged
by the least number of guesses an attacker needs: a dynamic program over the
value's positions takes the cheapest segmentation into common words, dates,
repeats and sequences, keyboard walks and brute-force characters. Values of
``MIN_BITS`` or more become spans of kind ``credential``.

Spans are (kind, start, end) in code points, end exclusive; they are sorted by
start, then kind in the order of ``KINDS``, then end. Null and empty texts
have no spans. Repeated rows each get their row; an empty table gives an empty
result; columns other than id and text are ignored. The dynamic program is
linear in the value's length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, per_text, query

KINDS = ["assign", "access", "hex", "credential"]
MIN_BITS = 36.0

# base patterns of the contract (fixed values)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy runs: the same matches as one or more, then 16 at least

CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|auth(?:orization)?|credentials?|"""
    r"""(?:api|access|private|client|signing)[_\x20-]?(?:key|secret)|conn(?:ection)?[_\x20-]?string)"""
    r"""["']?\x20*(?:=>|[:=])\x20*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)

COMMON = ("password passwd pass secret admin welcome login letmein monkey dragon qwerty master hello freedom whatever "
          "trustno shadow sunshine princess football baseball summer winter spring autumn monday friday test guest "
          "root user default changeme please love token key the and for with this that from your none null true false "
          "example sample dummy placeholder your here value string").split()
_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON))}
_LONGEST = max(map(len, _RANK))
_LEET = str.maketrans("4@301!5$7", "aaeoiisst")
_ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
_NEXT: dict[str, set[str]] = {}
for _r, _row in enumerate(_ROWS):
    for _c, _ch in enumerate(_row):
        near = {_row[j] for j in (_c - 1, _c + 1) if 0 <= j < len(_row)}
        for other in (_r - 1, _r + 1):
            if 0 <= other < len(_ROWS):
                near |= {_ROWS[other][j] for j in (_c - 1, _c, _c + 1) if 0 <= j < len(_ROWS[other])}
        _NEXT[_ch] = near
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?"
                   r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def _brute(c: str) -> float:
    """Bits of one guessed character, by its class."""
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(26) if c.isascii() else math.log2(100)
    return math.log2(33)


def _run_ends(low: str) -> tuple[list[int], list[int], list[int]]:
    """For each position, where its repeat, its sequence (abc, 321) and its
    keyboard walk end."""
    n = len(low)
    same, step, walk = list(range(1, n + 1)), list(range(1, n + 1)), list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if low[i] == low[i + 1]:
            same[i] = same[i + 1]
        delta = ord(low[i + 1]) - ord(low[i])
        if abs(delta) == 1:
            again = i + 2 < n and ord(low[i + 2]) - ord(low[i + 1]) == delta
            step[i] = step[i + 1] if again else i + 2
        if low[i + 1] in _NEXT.get(low[i], ()):
            walk[i] = walk[i + 1]
    return same, step, walk


def guess_bits(value: str) -> float:
    """log2 of the guesses for the cheapest segmentation of ``value``."""
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    same, step, walk = _run_ends(low)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]

        def offer(j: int, bits: float) -> None:
            if here + bits < best[j]:
                best[j] = here + bits

        offer(i + 1, _brute(value[i]) + (1.0 if value[i].isupper() else 0.0))
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            for word, extra in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                if word in _RANK:
                    changed = 1.0 if value[i:j] != low[i:j] else 0.0
                    offer(j, 1.0 + math.log2(_RANK[word] + 1) + extra + changed)
        if same[i] - i >= 3:
            offer(same[i], _brute(value[i]) + math.log2(same[i] - i))
        if step[i] - i >= 3:
            offer(step[i], 4.0 + math.log2(step[i] - i))
        if walk[i] - i >= 4:
            offer(walk[i], 5.0 + 1.5 * math.log2(walk[i] - i))
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            offer(m.end(), math.log2(150) + (math.log2(365) if m.end() - i > 4 else 0.0))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def credential_spans(text: str, min_bits: float = MIN_BITS) -> list[tuple[int, int, int]]:
    if ":" not in text and "=" not in text:
        return []
    return [(m.start(), 3, m.end()) for m in CONTEXT.finditer(text) if guess_bits(m.group(1)) >= min_bits]


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_bits: float = MIN_BITS) -> DataFrame:
    """One row per text: id, n_assign, n_access, n_hex, n_credential, base (joined base spans) and spans (all)."""
    def scan(texts):
        rows = []
        for text in texts:
            text = text or ""
            base, more = base_spans(text), credential_spans(text, min_bits)
            count = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*count, len(more), span_text(base), span_text(base + more)))
        return list(zip(*rows)) or [[]] * 6

    return per_text(docs, "n_assign long, n_access long, n_hex long, n_credential long, base string, spans string",
                    scan, id_col, text_col)


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    found = scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256)
                        .alias("base_sha256"), "spans", "n_credential")
