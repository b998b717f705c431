import re
from collections import Counter

import numpy as np

from ctxrec.llm import quality as Q
from ctxrec.sources.tables import read_table

from .conftest import SMALL


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_statistics_against_brute_force(make_docs, edge_rows, con, spark):
    texts = [r[0] for r in con.sql("SELECT text FROM documents LIMIT 400").fetchall()]
    rows = edge_rows + [(1000 + i, t) for i, t in enumerate(texts)] + [(20, "a b c a b c\na b c a b c\n\na b c"), (21, "x\r\nx\r\n")]
    docs = make_docs(rows)
    got = Counter(tuple(r)[:6] + (r.base_failed,) for r in Q.quality_rules(docs, read_table(spark, SMALL, "labels")).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_held_out_verdicts(spark):
    docs, labels = read_table(spark, SMALL, "documents", "doc_id", "text"), read_table(spark, SMALL, "labels")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = Q.quality_rules(docs, train).where("not base_failed").join(test, "doc_id").toPandas()
    bad, good = rows[rows.quality == 0], rows[rows.quality == 1]
    assert len(bad) > 5 and (~bad.kept).mean() >= 0.8
    assert good.kept.mean() >= 0.98


def test_without_labels_and_empty(spark, make_docs, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.quality_rules(make_docs(edge_rows), none).collect()
    assert len(rows) == len(edge_rows) and all(r.kept == (not r.base_failed) for r in rows)
    assert Q.quality_rules(make_docs(edge_rows).where("false"), read_table(spark, SMALL, "labels")).count() == 0
    nulls = spark.createDataFrame([(None, 1), (4, None), (4, 1)], "doc_id long, quality int")
    assert Q.quality_rules(make_docs(edge_rows), nulls).count() == len(edge_rows)


def test_extreme_in_one_statistic(spark, make_docs):
    """Good texts with one statistic driven far out; the base rule passes them all."""
    docs, labels = read_table(spark, SMALL, "documents", "doc_id", "text"), read_table(spark, SMALL, "labels")
    forest = Q.fit(docs, labels)
    s = Q.labelled_sample(docs, labels, "doc_id", "text", "quality")
    x = Q.features(s[~Q.base_failed(s) & (s["_label"] == 1)])
    assert not Q.verdict(forest, x.mean(axis=0, keepdims=True))[1].any()
    varied = 0
    for f in np.flatnonzero(x.max(axis=0) > x.min(axis=0)):
        row = np.median(x, axis=0)[None].copy()
        row[0, f] = 0.5 if f == 1 else 1.0  # more repeats than half fail the base rule
        score, bad = Q.verdict(forest, row)
        assert bad.all(), (f, score)
        varied += 1
    assert varied >= 4
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(900001, " ".join(f"{i}{i * 7919 % 10007}" for i in range(1000, 1120))),  # digits
            (900002, " ".join(x * 12 for x in words)),  # word length
            (900003, " ".join(words).upper())]
    got = {r.doc_id: r for r in Q.quality_rules(docs.unionByName(make_docs(rows).select("doc_id", "text")), labels)
           .where("doc_id > 900000").collect()}
    assert len(got) == 3 and not any(r.base_failed or r.kept for r in got.values())


def test_every_labelled_row_counts(spark):
    """Shares and threshold equal those of plain sums over all rows, however many."""
    from ctxrec.session import checkpoint_dir, ship_package
    checkpoint_dir(spark), ship_package(spark)
    assert not hasattr(Q, "SAMPLE")
    rng = np.random.default_rng(4)
    n = 9000
    x = np.round(rng.random((n, 7)), 3)
    x[:, 1] = 0.0
    good = rng.random(n) < 0.8
    x[~good, 0] = np.minimum(x[~good, 0] + 0.3, 1.0)
    rows = spark.createDataFrame([(int(k), bool(g), *map(float, r)) for k, (g, r) in enumerate(zip(good, x))],
                                 "key long, good boolean, " + ", ".join(f"{c} double" for c in Q.RATIOS)).repartition(5)
    auc = [((x[~good, f][:, None] > x[good, f]).sum() + (x[~good, f][:, None] == x[good, f]).sum() / 2) / good.sum() / (~good).sum()
           for f in range(7)]
    share = (2 * np.array(auc) - 1) ** 8
    assert np.allclose(Q.separation(rows, int(good.sum()), int((~good).sum())), share / share.sum())
    parts = Q.draws(rows, 256, 7, int(good.sum()), int((~good).sum()))
    assert len(parts) == Q.TREES and {p.shape for p in parts} == {(256, 7)}
    assert len({tuple(r) for p in parts for r in p}) > 6500  # far more rows than one draw holds
    scores = rows.selectExpr("good", "x0 score")
    g = np.sort(x[good, 0])[::-1][int(Q.MAX_GOOD_LOSS * good.sum())]
    beyond = x[~good, 0][x[~good, 0] > g]
    assert Q.calibrate(scores, int(good.sum())) == (np.inf if not len(beyond) else (g + beyond.min()) / 2)
