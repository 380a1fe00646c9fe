"""All pairs of neighbouring cells: the driver never gets a side that was measured as too large, and distances are as before."""

import random

import pytest
from pyspark.sql import functions as F

from carelocus.functions.geo import haversine_km, rounded
from carelocus.operators import nearest as nn
from carelocus.plans import registry

from conftest import SF001
from test_nearest_exact import tables


@pytest.fixture
def bound(spark):
    """Sets the byte bound of checked broadcasts; Spark's own threshold stays at its default."""
    key = "carelocus.broadcast.maxBytes"
    old = spark.conf.get(key, None)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def places(seed, n):
    r = random.Random(seed)
    return [(20 + r.random(), 70 + r.random()) for _ in range(n)]


def pairs(spark, how="inner", **options):
    fac, lookup = tables(spark, places(1, 150) + [(28.0, 77.0), ("NA", 70.0)], places(2, 90) + [(20.5, 70.5)] * 3)
    found = nn.grid_candidates(nn.facility_points(fac), nn.pin_points(lookup), how=how, **options)
    return found, sorted(map(tuple, found.collect()), key=repr)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {x for x in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if x in plan}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_side_over_the_bound_is_not_broadcast(spark, bound, how):
    small, want = pairs(spark, how)
    assert joins(small) == {"BroadcastHashJoin"} and len(want) > 150
    bound(1)
    large, got = pairs(spark, how)
    assert joins(large) == {"SortMergeJoin"} and got == want and large.columns == small.columns
    unmeasured, got = pairs(spark, how, check_broadcast=False)
    assert joins(unmeasured) == {"SortMergeJoin"} and got == want


def test_the_query_does_not_broadcast_its_pins_over_the_bound(spark, bound):
    want = sorted(registry.QUERIES["grid_candidates"](spark, SF001).collect())
    bound(1)
    got = registry.QUERIES["grid_candidates"](spark, SF001)
    assert sorted(got.collect()) == want and len(want) == 125
    assert "BroadcastHashJoin [cell_lat" not in got._jdf.queryExecution().executedPlan().toString()


def test_distances_are_the_plain_formula(spark):
    found, _ = pairs(spark, "left")
    plain = haversine_km("latitude", "longitude", "pin_latitude", "pin_longitude")
    assert found.filter(~F.col("distance_km").eqNullSafe(plain)).count() == 0
    assert found.filter("distance_km IS NULL AND pincode IS NULL").count() == 1 and found.filter("distance_km > 0").count() > 150


def test_rounded_is_round(spark):
    r = random.Random(3)
    values = [r.random() * 10 ** r.randint(-9, 14) * r.choice([1, -1]) for _ in range(3000)]
    values += [(k + 0.5) / 1e6 + e for k in (0, 1, 2, 7, 1234567, 20015086795) for e in (0.0, 1e-9, -1e-9, 1e-12, -1e-12)]
    values += [1.0000005, 2.5e-6, 0.1234565, 20015.0867965, 0.0, -0.0, -1e-9, 1e300, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places_ in (2, 6):
        rows = df.select(F.hex(F.format_string("%s", rounded("x", places_))).alias("a"), F.hex(F.format_string("%s", F.round("x", places_))).alias("b")).collect()
        assert len(rows) == len(values) and all(x.a == x.b for x in rows)
