import duckdb
import pytest


@pytest.fixture
def oracle(sf):
    """Rows of a DuckDB query over the test tables."""

    def run(sql: str):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        return con.execute(sql).fetchdf()

    return run
