import pytest

from ctxrec.llm import toxicity as T
from ctxrec.sources.tables import read_table

from .conftest import SMALL


def flags(text):
    return {s // 8: s % 8 for s in T.written(text, T.Lexicon([]))}


@pytest.mark.parametrize("text,want", [
    ("you are an idiot", {T.INSULT: T.ADDRESSED}), ("an idiot", {T.INSULT: 0}), ("they are not stupid", {T.INSULT: T.ADDRESSED | T.NEGATED}),
    ("he said the plan was stupid", {T.INSULT: T.REPORTED}), ("I will kill you", {T.THREAT: 0}), ("you will hurt", {T.THREAT: T.ADDRESSED}),
    ("not a single word of it was in the least stupid", {T.INSULT: 0}), ("she said no. stupid", {T.INSULT: 0}), ("idiotic", {}), ("", {}), (None, {})])
def test_composed_machine(text, want):
    assert flags(text) == want


def test_composition_equals_the_machines_in_turn():
    machines = [T.marker(T.TARGET, T.ADDRESSED, 4), T.marker(T.NEGATION, T.NEGATED, 3), T.marker(T.REPORT, T.REPORTED, None)]
    to, out = T.compose(machines)
    import random
    rng = random.Random(1)
    for _ in range(200):
        state, states = 0, [0, 0, 0]
        for _ in range(12):
            base = rng.randrange(6)
            symbol = base * 8
            for i, m in enumerate(machines):
                states[i], symbol = m.step(states[i], symbol)
            assert out[state][base] == symbol
            state = to[state][base]


def test_negated_and_reported_weigh_less():
    m = T.prior_model()
    s = m.score(["you idiot", "an idiot", "not an idiot", "she called him an idiot", "a nice day", "", None])
    assert s[0] > s[1] > s[2] and s[1] > s[3] and s[2] > s[4] == s[5] == s[6]


def test_held_out_rows(spark):
    docs = read_table(spark, SMALL, "documents", "doc_id", "text")
    rows = (T.op4_toxicity(spark, SMALL).join(read_table(spark, SMALL, "labels"), "doc_id")).toPandas()
    test = rows[rows.held_out]
    assert len(rows) > 300 and docs.count() == 1000
    assert (test.predicted == test.toxic).mean() >= 0.95
    assert test[test.toxic == 1].score.mean() > 0.7 > 0.2 > test[test.toxic == 0].score.mean()
    assert (rows.predicted == (rows.score >= 0.5)).all()


def test_edges(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    m = T.fit(docs, spark.createDataFrame([(None, 1), (4, None), (1, 0), (1, 1)], "doc_id long, toxic int"))
    rows = T.score_toxicity(docs, m).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    assert T.score_toxicity(docs.where("false"), m).count() == 0
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.stems == []
