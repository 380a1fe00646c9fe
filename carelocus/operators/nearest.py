"""J2 — nearest PIN point of every facility in the grid cells around its own.

Both sides are bucketed into square cells. The PIN side is copied into the
(2*rings+1)^2 cells around its own cell; a facility then equi-joins on its own
cell. Copying the PIN side (bounded by the number of postal codes) instead of
the facility side keeps the large side un-multiplied.

`grid_candidates` copies the PIN points and gives all pairs. The nearest PIN
needs only a few of them: here the occupied cells are copied, distinct points
join them, and from there the search goes down into finer cells and drops those
that cannot hold the nearest PIN. So a dense cell costs no more than its points.

The nearest PIN per facility is a min_by aggregate (partial aggregation before
the shuffle), not a window, so no reducer ever holds all candidates of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelocus.functions.geo import DEFAULT_GRID_DEGREES, grid_cell, haversine_km, haversine_term, parse_latitude, parse_longitude, term_km
from carelocus.operators.handoff import Handoff
from carelocus.operators.quadtree import LEAF_PINS, POINT, Squares, best_at_point, dealt_by_point, distinct_points, frontier, leaf_places, narrowed, tree
from carelocus.operators.sizing import broadcast_below, broadcast_or_merge

NEAREST_COLUMNS = [
    "facility_id", "coord_nearest_pin_district", "coord_nearest_pin_state",
    "coord_nearest_pincode", "coord_nearest_pin_distance_km",
]


def facility_points(facilities: DataFrame, cell_degrees: float = DEFAULT_GRID_DEGREES) -> DataFrame:
    """Facilities with usable coordinates and their grid cell."""
    return (
        facilities.select(
            F.col("unique_id").alias("facility_id"),
            parse_latitude("latitude").alias("latitude"),
            parse_longitude("longitude").alias("longitude"),
        )
        .filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .withColumn("cell_lat", grid_cell("latitude", cell_degrees))
        .withColumn("cell_lon", grid_cell("longitude", cell_degrees))
    )


def pin_points(lookup: DataFrame, cell_degrees: float = DEFAULT_GRID_DEGREES) -> DataFrame:
    """PINs that have a mean point, with their grid cell."""
    return (
        lookup.filter(F.col("has_coordinates") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(
            "pincode", "district", "statename",
            F.col("latitude").alias("pin_latitude"),
            F.col("longitude").alias("pin_longitude"),
        )
        .withColumn("pin_cell_lat", grid_cell("pin_latitude", cell_degrees))
        .withColumn("pin_cell_lon", grid_cell("pin_longitude", cell_degrees))
    )


def neighborhood_expand(points: DataFrame, rings: int = 1) -> DataFrame:
    """Copy every PIN point into the cells of its (2*rings+1)^2 neighbourhood.

    The offsets are a literal array exploded in place (no join, no shuffle).
    """
    offsets = F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
        for dy in range(-rings, rings + 1) for dx in range(-rings, rings + 1)
    ])
    return (
        points.withColumn("off", F.explode(offsets))
        .withColumn("cell_lat", F.col("pin_cell_lat") + F.col("off.dy"))
        .withColumn("cell_lon", F.col("pin_cell_lon") + F.col("off.dx"))
        .drop("off")
    )


def grid_candidates(fac_points: DataFrame, pins: DataFrame, rings: int = 1, how: str = "inner",
                    check_broadcast: bool = True) -> DataFrame:
    """Facility x PIN pairs whose cells are at most `rings` apart, with distance.

    The expanded PIN side is measured and broadcast when it fits the byte bound
    (postal codes are a bounded set), so the facility side is never shuffled
    for the join; beyond the bound, or unmeasured, it is a shuffle join on the
    cell, as Spark takes the expanded side for one copy of it and would
    broadcast it at a ninth of its size.
    """
    cells = neighborhood_expand(pins, rings).select(
        "cell_lat", "cell_lon", "pincode", "district", "statename", "pin_latitude", "pin_longitude")
    cells = broadcast_or_merge(cells) if check_broadcast else cells.hint("merge")
    lat = F.radians("latitude")  # what depends on the facility alone is worked out before there are pairs
    own = fac_points.withColumns({"_lat": lat, "_cos_lat": F.cos(lat), "_lon": F.radians("longitude")})
    joined = own.join(cells, ["cell_lat", "cell_lon"], how).withColumn("_term", haversine_term(
        "_lat", "_cos_lat", "_lon", F.radians("pin_latitude"), F.radians("pin_longitude")))
    return joined.withColumn("distance_km", term_km("_term")).drop("_lat", "_cos_lat", "_lon", "_term")


def best_pin(candidates: DataFrame) -> DataFrame:
    """One row per facility_id: the nearest of its candidates."""
    best = F.min_by(
        F.struct("district", "statename", "pincode", "distance_km"),
        # Rows without a PIN come last: a repeated id keeps its match. D8: ties -> smallest pincode
        F.struct(F.col("distance_km").isNull(), "distance_km", "pincode"),
    )
    return (
        candidates.groupBy("facility_id")
        .agg(best.alias("b"))
        .select(
            "facility_id",
            F.col("b.district").alias("coord_nearest_pin_district"),
            F.col("b.statename").alias("coord_nearest_pin_state"),
            F.col("b.pincode").alias("coord_nearest_pincode"),
            F.round("b.distance_km", 2).alias("coord_nearest_pin_distance_km"),
        )
    )


def nearest_of_points(points: DataFrame, pins: DataFrame, handoff: Handoff, cell_degrees: float = DEFAULT_GRID_DEGREES,
                      rings: int = 1, leaf_pins: int = LEAF_PINS) -> DataFrame:
    """(latitude, longitude, pincode, district, statename, distance_km): of each distinct point the nearest PIN of the
    grid cells around its own, if there is one.

    The grid cells that hold PINs are copied into their neighbourhoods and meet the points there; from them the search
    goes down (``quadtree.py``), so pairs grow with the points and not with the density of the cells. The pins and levels
    stored on the way go before the last join.
    """
    squares = Squares(cell_degrees)
    with Handoff(points.sparkSession) as steps:
        pins = steps.store(distinct_points(pins), "pin-points")
        levels = tree(pins, leaf_pins, steps, squares, first=0)
        placed = handoff.store(leaf_places(pins, levels, squares, first=0), "leaf-pins")
        (cells, n), below = levels[0], levels[1:]
        around = neighborhood_expand(
            cells.withColumn("pin_cell_lat", grid_cell("rep_lat", cell_degrees)).withColumn("pin_cell_lon", grid_cell("rep_lon", cell_degrees)), rings)
        around = broadcast_below(around.select("cell_lat", "cell_lon", "level", "cell", "leaf", "rep_lat", "rep_lon"), n * (2 * rings + 1) ** 2 * 8 * 9)
        start = dealt_by_point(points.select("latitude", "longitude", "cell_lat", "cell_lon").distinct()).join(around, ["cell_lat", "cell_lon"])
        start = narrowed(start.select(
            POINT, "latitude", "longitude", "level", "cell", "leaf",
            squares.gap_km("latitude", "longitude", F.col("level"), F.col("cell")).alias("gap"),
            haversine_km("latitude", "longitude", "rep_lat", "rep_lon").alias("bound")))
        wanted = handoff.store(frontier(start, below, squares), "frontier")
    pairs = wanted.join(placed, ["level", "cell"])
    best = best_at_point(pairs.withColumn("distance_km", haversine_km("latitude", "longitude", "pin_latitude", "pin_longitude")))
    return handoff.store(best, "nearest-of-points")


def _nearest(facilities: DataFrame, lookup: DataFrame, cell_degrees: float, rings: int, how: str, handoff: Handoff | None) -> DataFrame:
    handoff = handoff or Handoff(facilities.sparkSession)
    points = handoff.store(facility_points(facilities, cell_degrees), "points")
    found = nearest_of_points(points, pin_points(lookup, cell_degrees), handoff, cell_degrees, rings)
    return best_pin(points.select("facility_id", "latitude", "longitude").join(found, ["latitude", "longitude"], how))


def nearest_pin(facilities: DataFrame, lookup: DataFrame, cell_degrees: float = DEFAULT_GRID_DEGREES,
                rings: int = 1, handoff: Handoff | None = None) -> DataFrame:
    """matched facilities only, one row per facility_id. The caller drops `handoff` when the result is written."""
    return _nearest(facilities, lookup, cell_degrees, rings, "inner", handoff)


def unmatched_facilities(facilities: DataFrame, lookup: DataFrame, cell_degrees: float = DEFAULT_GRID_DEGREES,
                         rings: int = 1) -> DataFrame:
    """Ids with coordinates none of whose rows has a PIN point in its neighbourhood, each once."""
    cells = neighborhood_expand(pin_points(lookup, cell_degrees), rings).select("cell_lat", "cell_lon").distinct()
    points = facility_points(facilities, cell_degrees)
    matched = points.join(cells, ["cell_lat", "cell_lon"], "left_semi").select("facility_id")
    return points.select("facility_id").distinct().join(matched, "facility_id", "left_anti")


def nearest_pin_complete(facilities: DataFrame, lookup: DataFrame, cell_degrees: float = DEFAULT_GRID_DEGREES,
                         rings: int = 1, handoff: Handoff | None = None) -> DataFrame:
    """Every facility with coordinates; PIN columns NULL when none is in reach.

    One LEFT join + one aggregate: a facility with no candidate keeps one row
    whose PIN columns are typed NULLs (the union of matched and unmatched rows
    in a single pass, no driver-side branching). The caller drops `handoff` when the result is written.
    """
    return _nearest(facilities, lookup, cell_degrees, rings, "left", handoff)


def guaranteed_radius_km(cell_degrees: float, rings: int, max_abs_lat: float = 60.0) -> float:
    """Distance within which a (2r+1)^2 neighbourhood is sure to contain every point.

    Any point closer than `rings` cells along both axes lies inside; one cell of
    longitude is shortest at the highest latitude considered.
    """
    import math
    deg_km = 2 * math.pi * 6371.0 / 360.0
    return rings * cell_degrees * deg_km * math.cos(math.radians(max_abs_lat))
