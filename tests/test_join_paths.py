"""The shuffle-join path beyond the broadcast bound gives the same answers."""

import contextlib

from carelocus.operators import nearest as nn
from carelocus.operators import pincode as pc
from carelocus.plans.registry import facility_index, plans
from carelocus.operators import search as sr
from carelocus.sources import fixtures as fx

from conftest import SF001, SF01


@contextlib.contextmanager
def no_broadcast(spark):
    keys = {"carelocus.broadcast.maxBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_without_broadcast(spark):
    facs = fx.facilities(spark, SF01)
    lookup = pc.build_pincode_lookup(fx.postal_directory(spark, SF01)).cache()
    want = sorted(nn.nearest_pin_complete(facs, lookup).collect())
    with no_broadcast(spark):
        df = nn.nearest_pin_complete(facs, lookup)
        got = sorted(df.collect())
        assert "BroadcastHashJoin" not in _plan_text(df)
    assert got == want


def test_search_without_broadcast(spark):
    p, idx = plans(spark, SF001).cache(), facility_index(spark, SF001).cache()
    cols = ["search_id", "rank", "unique_id", "relevance_score"]
    want = sorted(sr.search_top(p, idx).select(cols).collect())
    with no_broadcast(spark):
        got = sorted(sr.search_top(p, idx).select(cols).collect())
    assert got == want and len(got) > 0
