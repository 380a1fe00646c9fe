"""Exact nearest PIN against brute force: dense and empty regions, both poles, the date line, ties, repeated points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from carelocus.operators import nearest_exact as nx
from carelocus.operators import pincode as pc
from carelocus.operators.handoff import Handoff
from carelocus.operators.nearest import facility_points, nearest_pin_complete, pin_points
from carelocus.sources import fixtures as fx

from conftest import SF001, SF01
from test_join_paths import no_broadcast

LOOKUP = "pincode string, district string, statename string, latitude double, longitude double, has_coordinates boolean"


def km(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def tables(spark, facilities, pins):
    fac = spark.createDataFrame([(f"F{i}", str(a), str(b)) for i, (a, b) in enumerate(facilities)], "unique_id string, latitude string, longitude string")
    return fac, spark.createDataFrame([(f"{i:06d}", f"D{i}", "S", a, b, True) for i, (a, b) in enumerate(pins)], LOOKUP)


@pytest.mark.parametrize(("leaf", "seed"), [(1, 1), (4, 2), (16, 3)])
def test_exact_equals_brute_force(spark, leaf, seed):
    r = random.Random(seed)
    city = [(28.6 + r.gauss(0, 0.02), 77.2 + r.gauss(0, 0.02)) for _ in range(150)]
    far = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]
    edges = [(0.0, 180.0), (0.1, -180.0), (90.0, 5.0), (-90.0, 7.0), (89.9, 170.0), (12.0, -179.99)]
    pins = city + far + edges + city[:5]
    points = [(28.6 + r.gauss(0, 0.1), 77.2 + r.gauss(0, 0.1)) for _ in range(80)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(80)]
    points += edges + [(11.9, 179.99), (-89.99, -100.0), (90.0, -120.0), (0.05, 179.999)] + pins[:10] + points[:10]
    fac, lookup = tables(spark, points, pins)
    got = {x.facility_id: (x.coord_nearest_pincode, x.coord_nearest_pin_distance_km) for x in nx.nearest_pin_exact(fac, lookup, leaf).collect()}
    assert len(got) == len(points)
    for i, (a, b) in enumerate(points):
        distances = [km(a, b, *p) for p in pins]
        pin, distance = got[f"F{i}"]
        assert distances[int(pin)] <= min(distances) + 1e-6 and abs(distance - min(distances)) <= 0.006
        # Of PINs at the very same point the smallest pincode.
        assert int(pin) == min(j for j, p in enumerate(pins) if p == pins[int(pin)])


def test_exact_without_broadcast_and_within_reach_of_the_grid(spark):
    facs, lookup = fx.facilities(spark, SF01), pc.build_pincode_lookup(fx.postal_directory(spark, SF01)).cache()
    want = sorted(nx.nearest_pin_exact(facs, lookup).collect())
    with no_broadcast(spark):
        assert sorted(nx.nearest_pin_exact(facs, lookup).collect()) == want
    grid = {r.facility_id: r for r in nearest_pin_complete(facs, lookup).collect()}
    assert {r.facility_id for r in want} == set(grid) and all(r.coord_nearest_pincode is not None for r in want)
    for r in want:
        there = grid[r.facility_id].coord_nearest_pin_distance_km
        assert there is None or r.coord_nearest_pin_distance_km <= there
        assert there is None or there > 9.0 or r == grid[r.facility_id]


def test_pairs_grow_with_the_points(spark):
    """Ten times the facilities and PINs in the same area: about ten times the pairs, not a hundred."""
    def pairs(sf):
        lookup = pc.build_pincode_lookup(fx.postal_directory(spark, sf))
        points = facility_points(fx.facilities(spark, sf)).select("latitude", "longitude").distinct()
        with Handoff(spark) as handoff:
            return nx.exact_candidates(points, pin_points(lookup), handoff).count(), points.count()

    (few, n), (many, m) = pairs(SF001), pairs(SF01)
    assert many / m <= 2 * max(few / n, 8)


def test_no_pins_and_no_facilities(spark):
    fac, lookup = tables(spark, [(1.0, 2.0), ("NA", "NA")], [(1.0, 2.0)])
    none = nx.nearest_pin_exact(fac, lookup.filter("false")).collect()
    assert [(r.facility_id, r.coord_nearest_pincode) for r in none] == [("F0", None)]
    assert nx.nearest_pin_exact(fac.filter("false"), lookup).count() == 0
    hot = fac.filter("unique_id = 'F0'").crossJoin(spark.range(500)).select(F.concat("unique_id", F.lit("-"), "id").alias("unique_id"), "latitude", "longitude")
    assert {r.coord_nearest_pincode for r in nx.nearest_pin_exact(hot, lookup).collect()} == {"000000"}
