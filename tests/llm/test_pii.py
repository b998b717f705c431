import hashlib
import re

from pyspark.sql import functions as F

from ctxrec.llm import pii as P

TEXTS = [(50, "a@b.c-d_e@f.g x"), (51, "1.2.3.4.5.6.7.8"), (52, "999.1.1.1 001.002.003.004"), (53, "+1 (((((((((("), (54, "+123456789012"),
         (55, "4111 1111 1111 1111-"), (56, "x" * 5000 + "@y.com"), (57, "1 " * 500), (58, "9" * 3000), (59, "a@b." * 60 + "c"),
         (60, "4111111111111111 4111111111111112"), (61, "iban DE89370400440532013000 my ssn 123-45-6789 call 212-555-1234"),
         (62, "foo (at) bar (dot) com"), (63, "+1-202-555-0143+44 20 7946 0958")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_spans_and_redaction(spark, make_docs, edge_rows, con):
    rows = edge_rows + TEXTS + con.sql("SELECT doc_id + 1000, text FROM documents WHERE doc_id % 4 = 0").fetchall()
    docs = make_docs(rows).checkpoint()
    weights = P.train(P.pattern_counts(docs))
    got = P.find_spans(docs, "text", [F.col("doc_id"), F.col("text")], weights).select(
        "doc_id", "text", P.span_text(F.col("base")).alias("base"), P.span_text(F.col("spans")).alias("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base == joined(brute(r.text))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[61] == "iban:5:27,ssn:35:46,local:52:64" and spans[62] == "spelled:0:22"

    clean = P.redact(docs)
    assert clean.columns == docs.columns
    out = {}
    for r in clean.collect():
        out.setdefault(r.doc_id, set()).add(r.text)
    assert out[10] == {"[EMAIL] [PHONE]"} and out[61] == {"iban [IBAN] my ssn [SSN] call [LOCAL]"}
    assert out[1] == {None} and out[2] == {""}
    for r in got:  # the same replacement, span by span
        want, at = "", 0
        for s in sorted((tuple(x.split(":")) for x in filter(None, r.spans.split(","))),
                        key=lambda s: (int(s[1]), P.KINDS.index(s[0]), int(s[2]))):
            a, b = int(s[1]), int(s[2])
            if a >= at:
                want += r.text[at:a] + f"[{s[0].removeprefix('weak_').upper()}]"
            at = max(at, b)
        assert (r.text is None and None in out[r.doc_id]) or want + r.text[at:] in out[r.doc_id]


def test_expectation_maximisation_finds_planted_reliabilities():
    import numpy as np
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    # chances of a yes of the first three labelers and of a no of the last two, by truth; yes-only and no-only ones abstain else
    yes, no = [(0.10, 0.97), (0.35, 0.85), (0.03, 0.5)], [(0.3, 0.02), (0.2, 0.02)]
    counts = {}
    for t in truth.astype(int):
        votes = tuple(int(rng.random() < p[t]) for p in yes[:2]) + (1 if rng.random() < yes[2][t] else 2,)
        votes += tuple(0 if rng.random() < p[t] else 2 for p in no)
        counts[(4, *votes)] = counts.get((4, *votes), 0) + 1
    rows = sorted((*k, n) for k, n in counts.items())
    post, table = P.reliabilities(rows)
    assert abs(table[0, 1, 1] - 0.97) < 0.06 and abs(table[1, 1, 1] - 0.85) < 0.08 and abs(table[3, 0, 0] - 0.3) < 0.12
    assert abs(sum(p * r[-1] for p, r in zip(post, rows)) / 4000 - 0.4) < 0.08
    weights = P.train(rows)
    assert weights[1][1] > weights[1][0] and weights[2][1] > weights[2][0] and weights[3][1] > weights[3][2]


def test_empty_table_and_query(spark, make_docs, con):
    empty = make_docs([(1, "x")]).where("false")
    assert P.pattern_counts(empty) == [] and P.redact(empty).count() == 0
    from .conftest import SMALL
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    got = P.op10_pii(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_spelled_addresses_in_any_case(make_docs):
    texts = ["write to john [at] mail [dot] com now", "WRITE TO JOHN [AT] MAIL [DOT] COM NOW", "Mail John (At) Mail (Dot) Com"]
    got = {r.doc_id: r.spans for r in P.with_candidates(make_docs(list(enumerate(texts))), "text", [F.col("doc_id")])
           .selectExpr("doc_id", "transform(cands, c -> c.k) AS spans").collect()}
    assert all(P.KINDS.index("spelled") in got[i] for i in range(3))
