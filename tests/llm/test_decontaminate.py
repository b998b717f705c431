import random
import re

from ctxrec.llm import decontaminate as D


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(t, items):
    w, hit, found = words(t), set(), set()
    for i, text in items:
        v = words(text)
        k = min(len(v), 10)
        grams = {tuple(v[j:j + k]) for j in range(len(v) - k + 1)} if k else set()
        for j in range(len(w) - k + 1):
            if k and tuple(w[j:j + k]) in grams:
                hit |= set(range(j, j + k))
                found.add(i)
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark, make_docs, edge_rows):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["the", "É", "日本"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 11, 25, 40])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "one two"), (103, "the the the the the the the the the the the the"), (None, "alpha beta"),
              (5, items[6][1]), (6, items[6][1])]
    rows = list(edge_rows) + [(20, "the " * 500), (21, "THE, the; the! " * 3)]
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            v = words(items[rng.randrange(40)][1])
            a = rng.randrange(len(v))
            at = rng.randrange(len(w) + 1)
            w[at:at] = v[a: a + rng.choice([5, 9, 10, 12, 40])]
        rows.append((1000 + d, rng.choice([" ", ", ", "-\n"]).join(w).upper() if d % 5 == 0 else " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(make_docs(rows), bench).collect()
    known = [(i, t) for i, t in items if i is not None]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute(t, known))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"] or []) in want[r.doc_id]
    assert sum(r.n_hit > 0 for r in got) > 10  # the fixture plants shared spans


def test_winnowing_guarantee(spark):
    """Any shared span of WINDOW words gives a shared fingerprint."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        span = [f"s{rng.randrange(50)}" for _ in range(D.WINDOW)]
        rows.append((i, [f"a{rng.randrange(9)}" for _ in range(rng.randrange(20))] + span + [f"b{rng.randrange(9)}" for _ in range(5)],
                     [f"c{rng.randrange(9)}" for _ in range(rng.randrange(20))] + span))
    df = spark.createDataFrame(rows, "i int, x array<string>, y array<string>")
    a = D._fingerprints(df.selectExpr("i", "x AS words"), D.WINDOW).selectExpr("i", "mark AS p")
    b = D._fingerprints(df.selectExpr("i", "y AS words"), D.WINDOW).selectExpr("i", "mark AS q")
    assert a.join(b, "i").where("arrays_overlap(p, q)").count() == 60


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = make_docs([(1, "a b c")])
    assert D.contamination(docs.where("false"), bench).count() == 0
    assert [r.n_hit for r in D.contamination(docs, bench.where("false")).collect()] == [0]


def test_a_window_of_all_items(spark, make_docs):
    """Items that share a passage: its windows are one set of items."""
    common = " ".join(f"w{i}" for i in range(14))
    items = [(i, f"{common} own{i} " + " ".join(f"x{i}y{j}" for j in range(12))) for i in range(40)] + [(99, "w3 w4 w5")]
    rows = [(i, f"a b {common} c") for i in range(25)] + [(100, "x7y0 " + " ".join(f"x7y{j}" for j in range(12))), (101, "w3 w4 w5"), (102, "w3 w4")]
    got = {r.doc_id: r for r in D.contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"] or []) == brute(t, items)
    assert len(got[0]["items"]) == 41
