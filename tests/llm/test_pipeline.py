"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline as P
from ctxrec.llm import sentencepiece, toxicity
from ctxrec.llm.common import stored
from ctxrec.sources.tables import read_table

from . import test_decontaminate, test_ngram_join, test_pii
from .conftest import SMALL


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def key(r):
    return tuple(str(x) for x in r)


def test_stages(spark):
    docs = read_table(spark, SMALL, "documents").where("doc_id % 3 = 0").cache()
    columns = docs.columns
    before = rows_of(docs)

    toxic = stored(P.drop_toxic(spark, docs, SMALL), "t")
    model = toxicity.trained(spark, docs, SMALL)
    assert toxic.columns == columns
    assert sorted(rows_of(toxic), key=key) == sorted((r for r in before if model.score([r[1]])[0] < 0.5), key=key)
    labels = {r.doc_id: r.toxic for r in read_table(spark, SMALL, "labels").collect()}
    kept = {r[0] for r in rows_of(toxic)}
    clean = [r[0] for r in before if labels.get(r[0]) == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)

    single = stored(P.drop_near_duplicates(spark, toxic, SMALL), "d")
    want = {c for _, _, c in test_ngram_join.brute([r[:2] for r in rows_of(toxic)])}
    assert single.columns == columns
    assert sorted(rows_of(single), key=key) == sorted((r for r in rows_of(toxic) if r[0] in want), key=key)

    fresh = stored(P.drop_contaminated(spark, single, SMALL), "c")
    items = [tuple(r) for r in read_table(spark, SMALL, "benchmark", "item_id", "text").collect()]
    assert fresh.columns == columns
    assert sorted(rows_of(fresh), key=key) == sorted(
        (r for r in rows_of(single) if not test_decontaminate.brute(r[1], items)[1]), key=key)

    safe = stored(P.redact_personal_data(spark, fresh, SMALL), "p")
    assert safe.columns == columns and safe.count() == fresh.count()
    for r in rows_of(safe):
        assert not test_pii.brute(re.sub(r"\[[A-Z]+\]", "|", r[1])) and r[4] == len(r[1])

    last = P.encode_text(spark, safe, SMALL).collect()
    pieces = sentencepiece.load_pieces()
    texts = {r[0]: r[1] for r in rows_of(safe)}
    assert len(last) == len(texts)
    assert all(pieces.decode(r.ids) == texts[r.doc_id] for r in last)


def test_run_and_edges(spark, tmp_path, edge_rows, make_docs):
    docs = make_docs(edge_rows + [(30, "you idiot, you stupid idiot"), (31, "item words one two three four five six seven eight nine")])
    docs.drop("score", "ids", "key").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "item words one two three four five six seven eight nine ten")], "item_id long, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.doc_id for r in P.run(spark, str(tmp_path)).collect()]
    # 4, 4 and 5 are one text; 6 and 7 nearly; 30 is toxic, 31 holds an item's words; texts without words stay
    assert sorted(map(str, got)) == sorted(map(str, [1, 2, 3, 4, None, None, 6, 8, 9, 10]))

    clash = make_docs([(1, "a plain text"), (1, "a plain text"), (2, None)])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns and {r.score for r in out.collect()} == {1.0}
        assert stage(spark, clash.where("false"), str(tmp_path)).count() == 0
