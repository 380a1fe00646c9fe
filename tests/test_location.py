"""Confidence classes (three-valued logic), coordinate parsing and the grid nearest-PIN join."""

import itertools
import math

from pyspark.sql import functions as F

from carelocus.functions.geo import haversine_km
from carelocus.functions.geo import box_half_widths, parse_latitude
from carelocus.operators import location as loc
from carelocus.operators import nearest as nn
from carelocus.operators import pincode as pc
from carelocus.sources import fixtures as fx

from conftest import SF01


def reference_class(postcode, pin_district, count, coord_district, dist, max_km=50.0):
    """The classification rules written out in plain three-valued logic (None = unknown)."""
    def AND(*xs):
        if any(x is False for x in xs):
            return False
        return None if any(x is None for x in xs) else True

    def OR(*xs):
        if any(x is True for x in xs):
            return True
        return None if any(x is None for x in xs) else False

    def NOT(x):
        return None if x is None else not x

    def eq(a, b):
        return None if a is None or b is None else a == b

    has_postcode = postcode is not None
    has_pin = pin_district is not None
    unambiguous = eq(count, 1)
    coord = AND(coord_district is not None, None if dist is None else dist <= max_km)
    agree = eq(None if pin_district is None else pin_district.strip().upper(),
               None if coord_district is None else coord_district.strip().upper())
    if AND(has_postcode, has_pin, unambiguous, coord, agree) is True:
        return "confirmed"
    if AND(coord, OR(NOT(has_postcode), NOT(has_pin), NOT(unambiguous), NOT(agree))) is True:
        return "coordinate_based"
    if AND(has_postcode, has_pin, NOT(unambiguous)) is True:
        return "ambiguous_pin"
    return "unresolved"


def test_confidence_truth_table(spark):
    postcodes = [None, "110001"]
    pins = [(None, None), ("D1", 1), ("D1", 2), ("D1", 0), (None, 0)]
    coords = [(None, None), ("D1", 3.0), ("d1 ", 3.0), ("D2", 3.0), ("D1", 80.0), ("D1", None)]
    rows = []
    for i, (p, (pd_, n), (cd, d)) in enumerate(itertools.product(postcodes, pins, coords)):
        rows.append((f"F{i}", p, pd_, "S", n, cd, "S", d))
    df = spark.createDataFrame(rows, "facility_id string, postcode string, pin_district string, pin_state string, "
                                     "pin_district_match_count long, coord_nearest_pin_district string, "
                                     "coord_nearest_pin_state string, coord_nearest_pin_distance_km double")
    df = df.withColumn("latitude", F.lit(None).cast("double")).withColumn("longitude", F.lit(None).cast("double"))
    got = {r["facility_id"]: r for r in loc.classify(df).collect()}
    for i, (p, (pd_, n), (cd, d)) in enumerate(itertools.product(postcodes, pins, coords)):
        r = got[f"F{i}"]
        assert r["location_confidence"] == reference_class(p, pd_, n, cd, d), (p, pd_, n, cd, d)
        if r["location_confidence"] in ("confirmed", "coordinate_based"):
            assert r["district"] == cd
        elif r["location_confidence"] == "ambiguous_pin":
            assert r["district"] == pd_
        else:
            assert r["district"] is None
        # invariant from the survey: coordinate_based <=> plausible coord match and not confirmed
        coord_ok = cd is not None and d is not None and d <= 50
        assert (r["location_confidence"] == "coordinate_based") == (coord_ok and r["location_confidence"] != "confirmed")


def test_messy_coordinates(spark):
    vals = ["NA", "NaN", "Infinity", "17.5d", " 17.5 ", "95.0", "26°57'17.7", "-12.25", "1e1", "", None, ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(parse_latitude("v")).collect()]
    assert got == [None, None, None, None, 17.5, None, None, -12.25, 10.0, None, None, 0.5]


def test_haversine_matches_python(spark):
    pts = [(28.6139, 77.2090, 26.9124, 75.7873), (0.0, 0.0, 0.0, 180.0), (10.0, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    for (a, b, c, d), g in zip(pts, got):
        p1, p2 = math.radians(a), math.radians(c)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
        assert abs(g - 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))) < 1e-6


def test_box_contains_circle(spark):
    # For |lat| < 50 the box built with 111 km per degree contains the radius circle.
    rows = [(lat, r) for lat in (-45.0, -10.0, 0.0, 20.0, 35.0, 49.0) for r in (5, 50, 500)]
    df = spark.createDataFrame(rows, "lat double, r int")
    dlat, dlon = box_half_widths(F.col("lat"), F.col("r"))
    for lat, r, a, b in df.select("lat", "r", dlat, dlon).collect():
        # the circle's extent along each axis
        assert a >= r / 6371.0 * 180 / math.pi
        assert b >= math.degrees(math.asin(min(1.0, math.sin(r / 6371.0) / math.cos(math.radians(lat))))) - 1e-9


def test_grid_nearest_equals_brute_force(spark):
    """Whenever the grid answer is within the guaranteed radius it is the true nearest PIN."""
    facs = fx.facilities(spark, SF01)
    lookup = pc.build_pincode_lookup(fx.postal_directory(spark, SF01))
    grid = {r["facility_id"]: r for r in nn.nearest_pin(facs, lookup).collect()}
    pts = [(r["facility_id"], r["latitude"], r["longitude"]) for r in nn.facility_points(facs).collect()]
    pins = [(r["pincode"], r["pin_latitude"], r["pin_longitude"]) for r in nn.pin_points(lookup).collect()]
    limit = nn.guaranteed_radius_km(0.1, 1)

    def dist(a, b, c, d):
        p1, p2 = math.radians(a), math.radians(c)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    checked = 0
    for fid, la, lo in pts:
        best = min(pins, key=lambda p: (dist(la, lo, p[1], p[2]), p[0]))
        bd = dist(la, lo, best[1], best[2])
        if bd <= limit:
            assert fid in grid and grid[fid]["coord_nearest_pincode"] == best[0]
            checked += 1
        elif fid in grid:
            assert grid[fid]["coord_nearest_pin_distance_km"] >= round(bd, 2)
    assert checked > 1000
