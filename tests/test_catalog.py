"""Every query with SQL gives what DuckDB gives; the others give rows."""

import math

import duckdb
import pytest

from sparkloom.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float) and not math.isnan(v):
        return float(f"{v:.4f}") + 0.0
    return str(v.replace(tzinfo=None)) if hasattr(v, "isoformat") and hasattr(v, "hour") else v


def same(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert same(got, df.columns) == same(want, names)
