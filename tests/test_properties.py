"""Invariants from SURVEY section 5: results do not depend on partitioning; one
nearest-PIN row per facility; matched + unmatched = facilities with coordinates."""

from pyspark.sql import functions as F

from carelocus.operators import nearest as nn
from carelocus.operators import pincode as pc
from carelocus.operators import search as sr
from carelocus.plans.registry import facility_index, plans
from carelocus.sources import fixtures as fx

from conftest import SF001, SF01


def test_top5_invariant_under_repartitioning(spark):
    p, idx = plans(spark, SF001).cache(), facility_index(spark, SF001).cache()
    cols = ["search_id", "rank", "unique_id"]
    base = sorted(sr.search_top(p, idx).select(cols).collect())
    for n in (1, 7):
        again = sorted(sr.search_top(p.repartition(n), idx.repartition(n, "unique_id")).select(cols).collect())
        assert again == base
    assert len(base) > 0


def test_nearest_one_row_per_facility(spark):
    facs = fx.facilities(spark, SF01)
    lookup = pc.build_pincode_lookup(fx.postal_directory(spark, SF01))
    complete = nn.nearest_pin_complete(facs, lookup)
    pts = nn.facility_points(facs)
    agg = complete.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("facility_id").alias("ids"),
                       F.count("coord_nearest_pincode").alias("matched")).first()
    unmatched = nn.unmatched_facilities(facs, lookup).count()
    assert agg.n == agg.ids == pts.count()
    assert agg.matched + unmatched == agg.n
