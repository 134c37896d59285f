import duckdb
import pytest

from casegrid.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(columns).collect()) == want
