"""The nearest PIN of the grid cells around a facility against brute force over the same cells, and its work in dense cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from carelocus.operators import nearest as nn
from carelocus.operators.handoff import Handoff
from carelocus.operators.quadtree import Squares

from test_join_paths import no_broadcast
from test_nearest_exact import km, tables


def brute_force(points, pins, d, rings):
    out = []
    for a, b in points:
        near = [(km(a, b, *p), i) for i, p in enumerate(pins)
                if abs(math.floor(p[0] / d) - math.floor(a / d)) <= rings and abs(math.floor(p[1] / d) - math.floor(b / d)) <= rings]
        out.append(sorted(near))
    return out


def places(seed):
    r = random.Random(seed)
    city = [(28.6 + r.gauss(0, 0.08), 77.2 + r.gauss(0, 0.08)) for _ in range(400)]
    south = [(-0.02 + r.gauss(0, 0.1), -0.03 + r.gauss(0, 0.1)) for _ in range(60)]
    edges = [(0.0, 180.0), (0.1, -180.0), (90.0, 5.0), (-90.0, 7.0), (89.95, 170.0), (12.0, -179.99), (28.6, 77.2)]
    pins = city + south + edges + city[:5]
    points = [(28.6 + r.gauss(0, 0.2), 77.2 + r.gauss(0, 0.2)) for _ in range(120)] + [(r.gauss(0, 0.2), r.gauss(0, 0.2)) for _ in range(60)]
    return points + edges + [(11.9, 179.99), (0.05, 179.999), (0.01, -179.95)] + pins[:10] + points[:10], pins


@pytest.mark.parametrize(("cell", "rings", "leaf"), [(0.1, 1, 16), (0.1, 1, 1), (0.25, 0, 2), (0.05, 2, 1), (100.0, 1, 1)])
def test_equals_brute_force_over_the_cells(spark, monkeypatch, cell, rings, leaf):
    points, pins = places(leaf)
    fac, lookup = tables(spark, points, pins)
    monkeypatch.setattr(nn.nearest_of_points, "__defaults__", (cell, rings, leaf))
    got = {x.facility_id: x for x in nn.nearest_pin_complete(fac, lookup, cell, rings).collect()}
    assert len(got) == len(points)
    want = brute_force(points, pins, cell, rings)
    for i, near in enumerate(want):
        row = got[f"F{i}"]
        if not near:
            assert row.coord_nearest_pincode is None and row.coord_nearest_pin_distance_km is None
            continue
        found = dict((pin, distance) for distance, pin in near)[int(row.coord_nearest_pincode)]
        assert found <= near[0][0] + 1e-6 and abs(row.coord_nearest_pin_distance_km - near[0][0]) <= 0.006
        # Of PINs at the very same point the smallest pincode.
        assert int(row.coord_nearest_pincode) == min(j for j, p in enumerate(pins) if p == pins[int(row.coord_nearest_pincode)])
    matched = {x.facility_id for x in nn.nearest_pin(fac, lookup, cell, rings).collect()}
    assert matched == {f"F{i}" for i, near in enumerate(want) if near}
    assert {x.facility_id for x in nn.unmatched_facilities(fac, lookup, cell, rings).collect()} == set(got) - matched


def test_equal_without_broadcast(spark):
    fac, lookup = tables(spark, *places(3))
    want = sorted(nn.nearest_pin(fac, lookup).collect())
    with no_broadcast(spark):
        assert sorted(nn.nearest_pin(fac, lookup).collect()) == want


def test_a_dense_cell_is_not_compared_pair_by_pair(spark):
    r = random.Random(5)
    points, pins = ([(20 + r.random() / 10, 70 + r.random() / 10) for _ in range(1500)] for _ in range(2))
    fac, lookup = tables(spark, points, pins)
    with Handoff(spark) as handoff:
        assert nn.nearest_pin_complete(fac, lookup, handoff=handoff).count() == len(points)
        wanted, placed = (spark.read.parquet(f"{handoff.root}/{x}") for x in ("frontier", "leaf-pins"))
        assert wanted.join(placed, ["level", "cell"]).count() <= 60 * len(points)
    assert nn.grid_candidates(nn.facility_points(fac), nn.pin_points(lookup)).count() == len(points) * len(pins)


def test_no_pins_and_no_facilities(spark):
    fac, lookup = tables(spark, [(1.0, 2.0), ("NA", "NA")], [(1.0, 2.0)])
    none = nn.nearest_pin_complete(fac, lookup.filter("false")).collect()
    assert [(x.facility_id, x.coord_nearest_pincode) for x in none] == [("F0", None)]
    assert nn.nearest_pin(fac, lookup.filter("false")).count() == 0 and nn.nearest_pin(fac.filter("false"), lookup).count() == 0


def test_cells_nest_and_bound_their_points(spark):
    points, _ = places(9)
    rows = spark.createDataFrame(points, "lat double, lon double")
    s = Squares(0.1)
    cells = [s.cell_of("lat", "lon", k) for k in (0, 3, s.last_level)]
    row = lambda c: F.shiftright(c, 32)
    column = lambda c: F.shiftright(F.shiftleft(c, 32), 32)
    for r in rows.select(*(f(c).alias(f"{n}{i}") for i, c in enumerate(cells) for n, f in (("r", row), ("c", column))),
                         *(s.gap_km("lat", "lon", F.lit(k), c).alias(f"g{k}") for k, c in zip((0, 3), cells))).collect():
        assert r.r1 >> 6 == r.r0 and r.c1 >> 6 == r.c0 and r.r2 >> 2 * s.last_level == r.r0 and r.c2 >> 2 * s.last_level == r.c0
        assert r.g0 < 1e-6 and r.g3 < 1e-6
