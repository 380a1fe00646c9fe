"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from carelocus.plans.oracle import ORACLE
from carelocus.plans.registry import QUERIES

from conftest import SF001

TABLES = ["customer", "orders", "events", "nation", "region", "part"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF001)
    cols = sorted(df.columns)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = Counter(tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall())
    assert srows == drows


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "search_id" in df.columns
