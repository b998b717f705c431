"""Personal data by weak supervision.

Candidate spans come from patterns of each kind. Five labelers vote on every
candidate (yes, no or abstain): the format's own check, a gazetteer (top-level
domains, issuer prefixes, country codes ...), a context labeler for words that
announce the kind, one for words that speak against it, and the shape of the
digits. Expectation-maximisation over the counts of all vote patterns of the
whole table estimates each labeler's reliability and how likely each pattern
is personal data; a logistic span classifier is trained on those estimates and
judges the candidates that the base rules do not already accept.

DataFrame functions only; all that reaches the driver is one row per vote
pattern (at most kinds x 3^5). Spans are (kind, start, end) in code points,
end exclusive, sorted by start, then kind as in ``KINDS``, then end. Base spans
always stay; accepted further candidates are added unless they overlap one.
Their kinds are ``weak_`` plus the kind for candidates that fail their base
check. Null and empty texts have no spans; repeated rows each get their row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, query

# patterns of the contract (fixed values). Runs are possessive and start where
# a run starts or the last match ended: the same matches in linear time
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # whole runs, of 14 digits or more
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"
LOCAL = r"(?<![0-9A-Za-z+.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
SPELLED = r"(?i)(?<![a-z0-9])[a-z0-9._-]{2,64}\x20?[(\[]at[)\]]\x20?[a-z0-9-]{2,63}\x20?[(\[]dot[)\]]\x20?[a-z]{2,10}"

#: kind, pattern, what a text must hold in lower case to have a match
PATTERNS = [("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+"),
            ("ssn", SSN, "-"), ("iban", IBAN, ""), ("local", LOCAL, ""), ("spelled", SPELLED, "dot")]
BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + ["ssn", "iban", "local", "spelled", "weak_ip", "weak_card", "weak_phone"]
_INDEX = {k: i for i, k in enumerate(KINDS)}

TLDS = ("com org net edu gov mil int info biz name pro io dev app ai co me tv de fr es it uk us ca mx br ar cl nl be ch "
        "at pt pl cz se no fi dk ie gr ru ua tr in cn jp kr au nz za eu").split()
IBAN_COUNTRIES = "DE FR ES IT NL BE CH AT PT PL CZ SE NO FI DK IE GR GB LU HU RO BG HR SI SK EE LV LT MT CY".split()
ANNOUNCE = {
    "email": "e-?mail|mail|contact|write|kontakt|courriel|correo|@", "ip": r"\bip\b|address|host|server|login|from",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment", "ssn": "ssn|social|security|taxpayer",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|ruf|handy|appel|llam", "iban": "iban|account|konto|compte|cuenta",
    "local": "phone|tel|call|mobile|cell|fax|ruf|handy|appel|llam", "spelled": "mail|contact|write|kontakt|correo"}
AGAINST = r"order|invoice|isbn|issn|version|release|serial|ticket|article|\bref\b|\bid\b|\bno\.|\bnr\.|build|section|doi|part"
LABELERS = 5
VOTES = 3  # 0 no, 1 yes, 2 abstain
PRIOR_STRENGTH = 0.5
#: labeler, truth (false, true), vote (no, yes, abstain)
PRIOR_VOTES = [[[0.90, 0.09, 0.01], [0.04, 0.95, 0.01]], [[0.59, 0.40, 0.01], [0.19, 0.80, 0.01]],
               [[0.01, 0.05, 0.94], [0.01, 0.39, 0.60]], [[0.20, 0.01, 0.79], [0.02, 0.01, 0.97]],
               [[0.15, 0.01, 0.84], [0.02, 0.01, 0.97]]]


def _luhn(digits: Column) -> Column:
    """Luhn check of up to 19 digits (zeros in front change nothing)."""
    padded, total = F.lpad(digits, 19, "0"), None
    for i in range(19):
        d = F.substring(padded, 19 - i, 1).cast("int")
        if i % 2:
            d = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        total = d if total is None else total + d
    return total % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, value: Column, digits: Column) -> Column:
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _known(kind: str, value: Column, digits: Column) -> Column:
    """Gazetteer: does the value start or end as real ones do?"""
    if kind in ("email", "spelled"):
        return F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(TLDS)
    if kind == "ip":
        return ~value.rlike(r"^(?:0|10|127|255|22[4-9]|23[0-9]|24[0-9])\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.")
    if kind == "card":
        return digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)")
    if kind == "phone":
        return digits.rlike(r"^(?:1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
    if kind == "iban":
        return F.substring(value, 1, 2).isin(IBAN_COUNTRIES)
    return ~digits.rlike("^(?:[01]|9[01])")


def _candidates(kind: str, found: Column, between: Column) -> Column:
    """Array of (start, kind, end, base, vote0..) of one kind: ``found`` holds
    the matches and ``between`` the stretches around them."""
    start = F.struct(F.lit(0).cast("long").alias("pos"),
                     F.array().cast("array<struct<s:bigint,e:bigint,v:string,b:string>>").alias("out"))

    def add(acc: Column, i: Column) -> Column:
        value, before = F.get(found, i), F.get(between, i)
        s = (acc["pos"] + F.length(before)).cast("long")
        e = (s + F.length(value)).cast("long")
        span = F.struct(s.alias("s"), e.alias("e"), value.alias("v"), F.lower(F.right(before, F.lit(40))).alias("b"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.when(F.size(found) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1), start, add, lambda acc: acc["out"]))

    def judge(c: Column) -> Column:
        digits = F.regexp_replace(c["v"], "[^0-9]", "")
        valid = _valid(kind, c["v"], digits)
        one = lambda x: F.when(x, 1).otherwise(0)
        plain = F.lit(2) if kind in ("email", "spelled") else F.when(
            (F.length(digits) >= 8) & (F.size(F.array_distinct(F.split(digits, ""))) < 4), 0).otherwise(2)
        index = F.lit(_INDEX[kind]) if kind in ("email",) or kind not in BASE else F.when(
            valid, _INDEX[kind]).otherwise(_INDEX[f"weak_{kind}"])
        return F.struct(
            c["s"].alias("s"), index.alias("k"), c["e"].alias("e"), (valid if kind in BASE else F.lit(False)).alias("base"),
            one(valid).alias("v0"), one(_known(kind, c["v"], digits)).alias("v1"),
            F.when(c["b"].rlike(ANNOUNCE[kind]), 1).otherwise(2).alias("v2"),
            F.when(c["b"].rlike(AGAINST), 0).otherwise(2).alias("v3"), plain.alias("v4"))

    # digit runs too long for a card are no candidates of anything
    if kind == "card":
        spans = F.filter(spans, lambda c: F.length(F.regexp_replace(c["v"], "[^0-9]", "")) <= 19)
    return F.coalesce(F.transform(spans, judge), F.array().cast(_CAND))


_CAND = ("array<struct<s:bigint,k:int,e:bigint,base:boolean," + ",".join(f"v{i}:int" for i in range(LABELERS)) + ">>")


def with_candidates(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns and ``cands``, all candidates of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = text.rlike("[0-9@\\[(]")
    lists = []
    for kind, pattern, need in PATTERNS:
        able = some & (F.lower(text) if need.isalpha() else text).contains(need) if need else some
        lists += [F.when(able, F.regexp_extract_all(text, F.lit(pattern), 0)).alias(f"_m_{kind}"),
                  F.when(able, F.split(text, pattern, -1)).alias(f"_p_{kind}")]
    src = docs.select(*keep, *lists)
    names = [c for c in src.columns if not c.startswith(("_m_", "_p_"))]
    cands = F.concat(*(_candidates(k, F.col(f"_m_{k}"), F.col(f"_p_{k}")) for k, _, _ in PATTERNS))
    return src.select(*names, cands.alias("cands"))


def pattern_counts(docs: DataFrame, text_col: str = "text") -> list[tuple]:
    """(kind, vote0.., count) over all candidates of the table."""
    votes = [f"v{i}" for i in range(LABELERS)]
    rows = (with_candidates(docs, text_col, []).select(F.explode("cands").alias("c"))
            .groupBy(F.col("c.k").alias("k"), *(F.col(f"c.{v}").alias(v) for v in votes)).count().collect())
    return sorted(tuple(r) for r in rows)


def reliabilities(counts: list[tuple], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (posterior of each pattern, P(vote | truth) as
    [labeler, truth, vote]). Each kind has its own share of true spans. Prior
    votes and shares count as PRIOR_STRENGTH of the data, which keeps the two
    classes from trading places."""
    kinds = np.array([c[0] for c in counts])
    votes = np.array([c[1:-1] for c in counts]).reshape(len(counts), LABELERS)
    weight = np.array([c[-1] for c in counts], dtype=float)
    total = weight.sum()
    trust = np.array(PRIOR_VOTES) * (PRIOR_STRENGTH * total + 1.0)
    mine = np.array([0.1 if KINDS[k].startswith("weak_") else 0.5 for k in kinds])
    table = np.array(PRIOR_VOTES)
    log = np.zeros((len(counts), 2))
    for j in range(LABELERS):
        log[:, 1] += np.log(table[j, 1, votes[:, j]])
        log[:, 0] += np.log(table[j, 0, votes[:, j]])
    post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)) * (1 - mine) / mine)
    for _ in range(rounds):
        for j in range(LABELERS):
            for v in range(VOTES):
                at = votes[:, j] == v
                table[j, 1, v] = (weight * post)[at].sum() + trust[j, 1, v]
                table[j, 0, v] = (weight * (1 - post))[at].sum() + trust[j, 0, v]
        table /= table.sum(axis=2, keepdims=True)
        log = np.zeros((len(counts), 2))
        for k in np.unique(kinds):
            at = kinds == k
            held = PRIOR_STRENGTH * weight[at].sum() + 1.0
            share = ((weight * post)[at].sum() + held * mine[at][0]) / (weight[at].sum() + held)
            log[at, 1], log[at, 0] = np.log(share), np.log(1 - share)
        for j in range(LABELERS):
            log[:, 1] += np.log(table[j, 1, votes[:, j]])
            log[:, 0] += np.log(table[j, 0, votes[:, j]])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        moved, post = np.abs(new - post).max(initial=0.0), new
        if moved < 1e-9:
            break
    return post, table


def train(counts: list[tuple]) -> list[list[float]]:
    """Logistic span classifier on the estimated labels: a weight for each
    kind, then for each vote of each labeler."""
    if not counts:
        return [[0.0] * len(KINDS)] + [[-1.0, 1.0, 0.0]] * LABELERS
    post, _ = reliabilities(counts)
    x = np.zeros((len(counts), len(KINDS) + LABELERS * VOTES))
    for r, c in enumerate(counts):
        x[r, c[0]] = 1
        for j in range(LABELERS):
            x[r, len(KINDS) + j * VOTES + c[1 + j]] = 1
    weight = np.array([c[-1] for c in counts], dtype=float)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - post)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    parts = [w[: len(KINDS)]] + [w[len(KINDS) + j * VOTES: len(KINDS) + (j + 1) * VOTES] for j in range(LABELERS)]
    return [[round(float(v), 9) for v in p] for p in parts]


def find_spans(docs: DataFrame, text_col: str, keep: list[Column], weights: list[list[float]]) -> DataFrame:
    """``keep``, ``base`` and ``spans``: sorted arrays of (start, kind index, end)."""
    arrays = [F.array(*map(F.lit, w)) for w in weights]

    def accepted(c: Column) -> Column:
        score = F.get(arrays[0], c["k"])
        for j in range(LABELERS):
            score = score + F.get(arrays[j + 1], c[f"v{j}"])
        return ~c["base"] & (score > 0)

    bare = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
    src = with_candidates(docs, text_col, keep)
    names = [c for c in src.columns if c != "cands"]
    src = src.select(*names, F.array_sort(F.transform(F.filter("cands", lambda c: c["base"]), bare)).alias("base"),
                     F.transform(F.filter("cands", accepted), bare).alias("_more"))
    free = F.filter("_more", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return src.select(*names, "base", F.array_sort(F.concat("base", free)).alias("spans"))


def span_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["k"]), c["s"], c["e"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with every found span of the text replaced by its kind in
    brackets (overlapping spans by that of the first); other columns as they
    are, null texts stay null."""
    found = find_spans(docs, text_col, [F.struct(*docs.columns).alias("__row")], train(pattern_counts(docs, text_col)))
    kinds = F.array(*(F.lit(f"[{k.removeprefix('weak_').upper()}]") for k in KINDS))
    text = F.col("__row")[text_col]
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, c: Column) -> Column:
        fresh = c["s"] >= acc["pos"]
        piece = F.concat(F.substring(text, (acc["pos"] + 1).cast("int"), (c["s"] - acc["pos"]).cast("int")),
                         F.get(kinds, c["k"]))
        return F.struct(F.greatest(acc["pos"], c["e"]).alias("pos"),
                        F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, cut)
    rest = F.concat(F.array_join(done["out"], ""), F.substring(text, (done["pos"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("spans") > 0, rest).otherwise(text)
    return found.select(*((clean if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns))


@query("op10_pii")
def op10_pii(spark, sf_dir):
    """Personal data of every document."""
    docs = documents(spark, sf_dir)
    found = find_spans(docs, "text", [F.col("doc_id")], train(pattern_counts(docs)))
    count = lambda k: F.size(F.filter("base", lambda c: c["k"] == _INDEX[k])).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
