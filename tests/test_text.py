"""Text operators at their edges, and trees of any depth."""

import math

from ctxrec.operators.text import fit_idf, lda_topics, term_counts, tfidf
from ctxrec.operators.views import tab_tree
from ctxrec.session import checkpoint_dir


def _weights(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.term): r.weight for r in
            tfidf(term_counts(docs, ["doc_id"], "text"), fit_idf(docs, "doc_id"), ["doc_id"]).collect()}


def test_equal_documents_have_weight_zero(spark):
    assert _weights(spark, ["same words", "same words"]) == {(i, w): 0.0 for i in (0, 1) for w in ("same", "words")}
    assert set(_weights(spark, ["one document"]).values()) == {0.0}


def test_weights_have_unit_norm(spark):
    got = _weights(spark, ["aa bb bb", "bb cc", "cc dd aa"])
    for d in range(3):
        assert math.isclose(sum(w * w for (i, _), w in got.items() if i == d), 1.0)


def test_user_text_holds_viewed_and_own_documents(spark):
    from ctxrec.operators import text
    docs = spark.createDataFrame([("p1", "aa bb aa"), ("p2", "bb"), ("p2", "cc"), ("p3", None)], "url string, content string")
    pairs = spark.createDataFrame([("u", "p1"), ("u", "p2"), ("v", "p2"), ("v", "p3"), ("w", "p4")], "username string, url string")
    by_pages = text.group_term_counts(term_counts(docs, ["url"]), pairs, ["url"], ["username"])
    got = text.grouped_text_terms(docs, pairs, ["url"], ["username"])
    rows = lambda df: {(r.username, r.term, r.tf) for r in df.collect()}
    assert rows(got) == rows(by_pages) == {("u", "aa", 2), ("u", "bb", 2), ("u", "cc", 1), ("v", "bb", 1), ("v", "cc", 1)}


def test_user_keys_hold_viewed_and_own_documents(spark):
    import __spark_entry__ as E
    for key in ("user_documents", "user_text"):
        names = {r.username[0] for r in E.queries()[key](spark, "/root/testdata/sf0.001").select("username").distinct().collect()}
        assert names == {"u", "s"}  # users of the events, sources of the documents


def test_lda_uses_every_term(spark):
    checkpoint_dir(spark)
    docs = spark.createDataFrame([(i, f"common word{i} rare{i} " + "left right " * (1 + i % 2)) for i in range(30)],
                                 "doc_id long, text string")
    topics = lda_topics(docs, "text", 2, 70, max_iter=3)
    rows = topics.collect()
    assert {r.topic for r in rows} == {0, 1} and len({r.term for r in rows}) == 63
    assert lda_topics(docs.where("false"), "text").count() == 0


def test_deep_tab_tree(spark):
    edges = [(f"t{i}", f"t{i - 1}") for i in range(1, 1000)] + [("x", "y"), ("y", "x"), ("z", "x"), ("lost", "nowhere")]
    tabs = spark.createDataFrame([(f"t{i}",) for i in range(1000)] + [("x",), ("y",), ("z",), ("lost",), ("alone",)], "tab_id string")
    got = {r.tab_id: (r.root, r.depth) for r in
           tab_tree(spark, tabs, spark.createDataFrame(edges, "tab_id string, parent_id string")).collect()}
    assert got["t999"] == ("t0", 999) and got["t0"] == ("t0", 0) and got["alone"] == ("alone", 0)
    assert not {"x", "y", "z", "lost"} & set(got) and len(got) == 1001
