"""Training corpora from resources and from folders of texts."""

import pytest

from ctxrec.sources.corpus import read_folder, training_corpus


def test_folder_of_whole_texts(spark, tmp_path):
    texts = {"a.txt": "one\ntwo\n", "sub/b c.txt": "", "sub/deep/é+.txt": "x\r\n\r\n", "sub/d%20.txt": "no line end é🎉"}
    root = tmp_path / "corpus.v1"
    for name, t in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(t.encode())
    want = {"a.txt": "one\ntwo", "sub/deep/é+.txt": "x\r\n", "sub/d%20.txt": "no line end é🎉"}
    got = {r.doc: r.text for r in read_folder(spark, str(root)).collect()}
    assert got.pop("sub/b c.txt", "") == ""  # an empty file may give no row
    assert got == want
    assert {r.doc: r.text for r in training_corpus(spark, "folder", folder=f"{root}/").collect() if r.text} == want


def test_docs(spark):
    res = spark.createDataFrame([("u1", "t", True, False), ("u2", "t", False, False), ("u3", "t", True, True)],
                                "url string, content string, processed boolean, blacklisted boolean")
    assert [tuple(r) for r in training_corpus(spark, "docs", resources=res).collect()] == [("u1", "t")]
    with pytest.raises(ValueError):
        training_corpus(spark, "other")
