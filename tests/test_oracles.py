"""Every registered query against its DuckDB oracle on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, norm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    exp = collections.Counter(tuple(norm(r[dcols.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == exp
