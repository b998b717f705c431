import random

import pytest

from ctxrec.llm import sentencepiece as S

TEXTS = ["", " ", "  ", "a  b\n\n c\t", "日本語 🎉 x", "éé ñandú", "a" * 5000, "   lead", "trail   ", "\n", "line\r\nx", "\x00\x01",
         "The quick brown fox; print('hi')  # done", "ÀÉÎ" * 50]


@pytest.fixture(scope="module")
def pieces():
    return S.load_pieces()


@pytest.fixture(scope="module")
def library(pieces):
    """The public library over the same pieces and costs, as a Unigram model."""
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(S.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, cost in zip(pieces.ids, pieces.cost):
        proto.pieces[int(i)].score = -float(cost)
    return spm.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_equals_library(pieces, library, con):
    texts = TEXTS + [r[0] for r in con.sql("SELECT text FROM documents WHERE length(text) < 5000 LIMIT 300").fetchall()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("the in▁ aeé\n\t日x") for _ in range(80)) for _ in range(100)]
    for t, ids in zip(texts, pieces.encode(texts, {})):
        assert ids.tolist() == library.encode(t)


def test_double_array_holds_every_piece():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    base, check, value = S.build_double_array(keys)
    for i, key in enumerate(keys):
        s = 0
        for c in key:
            t = base[s] + c + 1
            assert check[t] == s
            s = t
        assert value[s] == i


def test_round_trip_and_edges(spark, make_docs, edge_rows, pieces):
    docs = make_docs(edge_rows + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(99, "a▁b")])
    enc = S.encode(docs, pieces)
    got = enc.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.n_tokens == len(r.ids)
    assert {r.round_trip for r in got if r.doc_id == 99} == {False}
    assert {r.round_trip for r in got if r.doc_id not in (99, 1, None)} == {True}
    assert [(r.n_tokens, r.round_trip) for r in got if r.doc_id == 1] == [(0, None)]
    back = {r.doc_id: r.text for r in S.decode(enc, pieces).collect() if r.doc_id is not None}
    assert all(back[i] == t for i, t in edge_rows if i not in (None, 1))
    assert S.encode(docs.where("false"), pieces).count() == 0


def test_cache_changes_nothing(pieces):
    texts = TEXTS[:8] * 2
    cache = {}
    first = [x.tolist() for x in pieces.encode(texts, cache)]
    assert first == [x.tolist() for x in pieces.encode(texts, cache)] == [x.tolist() for x in pieces.encode(texts, {})]
