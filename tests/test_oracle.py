"""Every registered query against its DuckDB oracle SQL, at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ctxrec.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = table_path(SF, t)
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    got = E.queries()[key](spark, SF).toPandas()
    exp = con.sql(E.oracle_sql()[key]).df()
    assert _rows(got) == _rows(exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"username", "url", "score", "position"}
    assert df.count() >= 0
