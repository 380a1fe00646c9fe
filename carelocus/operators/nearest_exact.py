"""J2 with a proof (D9): the nearest PIN point of every facility at any distance, by branch and bound on a quadtree.

The search of ``nearest.py`` looks at a fixed neighbourhood of grid cells; beyond it, it knows nothing. Here it goes over
the whole globe (``quadtree.py``):

1. Distinct coordinates alone are searched; rows at one point share its answer.
2. The PIN points are counted in cells of a quadtree over the globe that is four times finer in each axis from level to
   level. A cell with at most `leaf_pins` points is a leaf. Each cell holds one of its points as a representative.
3. A frontier of (point, cell) rows starts at the root and goes down level by level: a cell that is no leaf is replaced
   by its children. The nearest representative bounds the distance from above, the gap between point and cell bounds it
   from below, and cells that are farther than the bound are dropped. So a point keeps the few cells that could still
   hold its nearest PIN, wherever they lie.
4. The PINs of the leaves that are left are compared. A leaf holds few of them, so pairs grow with the points and not
   with the density of either side.

The frontier is dealt by point once. The cells of a level are measured and broadcast under the byte bound, which keeps
that partitioning, so that bounds need no further shuffle; beyond it they are joined by a shuffle on the cell. The only
loop on the driver is over levels, at most `MAX_LEVEL`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelocus.functions.geo import haversine_km
from carelocus.operators.handoff import Handoff
from carelocus.operators.nearest import best_pin, facility_points, pin_points
from carelocus.operators.quadtree import GLOBE, LEAF_PINS, POINT, best_at_point, dealt_by_point, distinct_points, frontier, leaf_places, tree


def exact_candidates(points: DataFrame, pins: DataFrame, handoff: Handoff, leaf_pins: int = LEAF_PINS) -> DataFrame:
    """(latitude, longitude, pincode, district, statename, distance_km): each distinct point with the PINs of its leaves.

    A point's nearest PIN is among them, and of several at the same distance all.
    """
    pins = handoff.store(distinct_points(pins), "pin-points")
    levels = tree(pins, leaf_pins, handoff, GLOBE, first=1)
    placed = handoff.store(leaf_places(pins, levels, GLOBE, first=1), "leaf-pins")
    root = dealt_by_point(points).select(
        POINT, "latitude", "longitude", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell"), F.lit(False).alias("leaf"),
        F.lit(0.0).alias("gap"), F.lit(float("inf")).alias("bound"))
    wanted = handoff.store(frontier(root, levels, GLOBE), "frontier")
    pairs = wanted.join(placed, ["level", "cell"])
    return pairs.select("latitude", "longitude", "pincode", "district", "statename", haversine_km("latitude", "longitude", "pin_latitude", "pin_longitude").alias("distance_km"))


def nearest_pin_exact(facilities: DataFrame, lookup: DataFrame, leaf_pins: int = LEAF_PINS, handoff: Handoff | None = None) -> DataFrame:
    """J2 with the truly nearest PIN of every facility with coordinates; NULL columns only if there are no PIN points.

    The caller drops `handoff` when the result is written.
    """
    handoff = handoff or Handoff(facilities.sparkSession)
    rows = facility_points(facilities).select("facility_id", "latitude", "longitude")
    found = exact_candidates(rows.select("latitude", "longitude").distinct(), pin_points(lookup), handoff, leaf_pins)
    points = best_at_point(found)
    return best_pin(rows.join(points, ["latitude", "longitude"], "left"))
