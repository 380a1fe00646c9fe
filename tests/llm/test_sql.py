"""The registered SQL of this subpackage against its queries."""

import duckdb
import pytest

from carelocus.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[key](spark, SF)
    found = con.execute(ORACLE[key])
    assert [d[0] for d in found.description] == got.columns
    want = sorted(found.fetchall())
    assert want and sorted(map(tuple, got.collect())) == want
