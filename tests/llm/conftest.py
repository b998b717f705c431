import os
import random

import duckdb
import pytest

from ctxrec.llm.common import prepare
from ctxrec.sources.tables import TABLES, table_path

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, key long"


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, 1.0, "x", 7) for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := table_path(SMALL, t)):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, very long, tied and repeated rows, null ids."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(900))
                    for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "no id here at all you see"),
            (None, None), (6, long), (7, long + " more"), (8, "x" * 50_000), (9, "é🎉 ß\u2028 tail\n\nline"), (10, "a.b@c.de +1 (988) 555-2485")]
