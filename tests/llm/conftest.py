import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) rows, with columns whose names clash."""

    def make(rows):
        wide = [(i, t, "x", "y", 1, 2.0) for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, key string, node string, part int, score double")

    return make
