import random

import pytest

from ctxrec.llm import token_count as T

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return T.load_counter(PATH)


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tok.encode_batch(list(texts), add_special_tokens=False)]


def test_whole_tokens_are_those_the_library_leaves_whole(counter, library):
    tok = tokenizers.Tokenizer.from_file(PATH)
    names = T.byte_names()
    strings = []
    for name in tok.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(names[c] for c in name).decode())
        except (KeyError, UnicodeDecodeError):
            pass
    single = [s for s, n in zip(strings, library(strings)) if n == 1]
    # a string of several pre-tokens is never looked up; all that is one token to the library is proved
    assert set(single) <= counter.whole
    assert len(counter.whole) > 45_000


def test_equals_library_on_odd_texts(counter, library):
    rng = random.Random(1)
    texts = ["x" * 5000, "xx", "xxx", " " * 77, "\n\n a  b\t\t c", "<|endoftext|>a<|endoftext|><|endoftext|> b", "<|endof", "ab" * 3000,
             "it's 'tis we'll I'D I'd", "日本語🎉 é \u0085x", "퟿\U0010ffff", "aaaabaaaab" * 99, "\x00\x1c\x1d a\x1fb", "ſ'ſ K"]
    alphabet = "aab  \n\t'sre1２é日🎉%!<|՘\U00012550 \xa0x"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(5000)]
    assert counter.count(texts).tolist() == library(texts)


def test_every_code_point(counter, library):
    texts = [f"a{c}1{c}!{c} {c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    assert counter.count(texts).tolist() == library(texts)


def test_stretches_and_cache_change_nothing(counter, library, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é  \n1.") for _ in range(3000)) for _ in range(20)]
    monkeypatch.setattr(T, "STRETCH", 50)
    monkeypatch.setattr(T, "CACHE_BYTES", 2000)
    monkeypatch.setattr(T, "KEPT_CHARS", 3)
    for t in texts:
        assert "".join(counter.stretches(t)) == t
    assert counter.count(texts).tolist() == library(texts)


def test_edges(spark, make_docs, edge_rows, counter, library):
    docs = make_docs(edge_rows)
    got = T.count_tokens(docs, counter, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = sorted(map(tuple, got.collect()), key=str)
    tokens = library([t or "" for _, t in edge_rows])
    assert rows == sorted(((i, len((t or "").encode()), n, n > 3) for (i, t), n in zip(edge_rows, tokens)), key=str)
    assert T.count_tokens(docs.where("false"), counter).count() == 0


def test_query_equals_library(spark, con, library):
    rows = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    want = dict(zip(rows, library(rows.values())))
    got = {r.doc_id: r for r in T.op13_token_count(spark, "/root/testdata/sf0.01").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len(rows[i].encode()) for i, r in got.items())


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        T.load_counter(public_tokenizers.path("word_bpe_49k.json"))
