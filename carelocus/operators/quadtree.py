"""Branch and bound on squares that are four times finer in each axis from level to level.

Points are searched for their nearest PIN by a frontier of (point, cell) rows. A cell holds one of its PINs as a
representative: the nearest representative bounds the distance from above, the gap between point and cell bounds it from
below, and cells that are farther than the bound are dropped. A cell that is no leaf is replaced by its children, level
by level. What the frontier starts with says where is searched: the whole globe (``nearest_exact.py``) or the grid cells
around a point (``nearest.py``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelocus.functions.geo import EARTH_RADIUS_KM, haversine_km
from carelocus.operators.handoff import Handoff
from carelocus.operators.sizing import broadcast_below

LEAF_PINS = 16
#: Bounds are compared with this much room for rounding, so that no cell with an equal distance is dropped.
ROOM_KM = 1e-6
POINT = "_point"


@dataclass(frozen=True)
class Squares:
    """The cells: squares of `degrees` at level 0, counted from (south, west). With `one`, level 0 is a single square
    and its last meridian belongs to its last column."""
    degrees: float
    south: float = 0.0
    west: float = 0.0
    one: bool = False

    @property
    def last_level(self) -> int:
        """Cells are numbered by two 32-bit halves. At 12 levels below the globe they are about a metre wide; distinct
        points do not share them in practice, and may."""
        return 12 if self.one else max(0, min(12, int(math.log(2**31 / (180.0 / self.degrees + 2), 4))))

    def cell_of(self, lat: str, lon: str, level: int | Column) -> Column:
        """The cell of a point, as one number; the cells of a level lie inside those of the level before."""
        scale = F.lit(float(4.0**level)) if isinstance(level, int) else F.pow(F.lit(4.0), level)

        def place(c: str, first: float) -> Column:
            at = F.col(c) - first if first else F.col(c)
            at = F.floor(at / F.lit(float(self.degrees)) * scale)
            return (F.least(at, scale - 1) if self.one else at).cast("long")

        return F.shiftleft(place(lat, self.south), 32).bitwiseOR(place(lon, self.west).bitwiseAND(F.lit(0xFFFFFFFF)))

    def gap_km(self, lat: str, lon: str, level: Column, cell: Column) -> Column:
        """No point of the cell is nearer to (lat, lon) than this.

        Latitude and longitude differ at least by the gaps on both axes (the shorter way round for longitude), and the
        cosine of a latitude in the cell is at least the smaller one of its edges.
        """
        size = F.lit(float(self.degrees)) / F.pow(F.lit(4.0), level)
        row, column = F.shiftright(cell, 32), F.shiftright(F.shiftleft(cell, 32), 32)

        def edges(at: Column, first: float, limit: float) -> tuple[Column, Column]:
            low = at * size + first
            return F.greatest(low, F.lit(-limit)), F.least(low + size, F.lit(limit))

        (south, north), (west, east) = edges(row, self.south, 90.0), edges(column, self.west, 180.0)
        y, x = F.col(lat), F.col(lon)
        dlat = F.greatest(south - y, y - north, F.lit(0.0))

        def round_the_globe(edge: Column) -> Column:
            way = F.abs(x - edge)
            return F.least(way, F.lit(360.0) - way)

        dlon = F.when(x.between(west, east), 0.0).otherwise(F.least(round_the_globe(west), round_the_globe(east)))
        narrow = F.greatest(F.least(F.cos(F.radians(south)), F.cos(F.radians(north))), F.lit(0.0))
        h = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(y)) * narrow * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


GLOBE = Squares(360.0, -90.0, -180.0, one=True)


def level_cells(pins: DataFrame, level: int, leaf_pins: int, squares: Squares) -> DataFrame:
    """(parent, level, cell, leaf, rep_lat, rep_lon): the cells of a level with their parents. `pins` holds each point once."""
    cells = pins.groupBy(squares.cell_of("pin_latitude", "pin_longitude", level - 1).alias("parent"), squares.cell_of("pin_latitude", "pin_longitude", level).alias("cell"))
    cells = cells.agg(F.count("*").alias("_n"), F.min(F.struct("pin_latitude", "pin_longitude")).alias("_rep"))
    leaf = (F.col("_n") <= leaf_pins) | F.lit(level >= squares.last_level)
    return cells.select("parent", F.lit(level).alias("level"), "cell", leaf.alias("leaf"), F.col("_rep.pin_latitude").alias("rep_lat"), F.col("_rep.pin_longitude").alias("rep_lon"))


def tree(pins: DataFrame, leaf_pins: int, handoff: Handoff, squares: Squares, first: int) -> list[tuple[DataFrame, int]]:
    """The levels from `first` on with their numbers of cells, until all cells of a level are leaves.

    A level holds the children of the cells before it that are no leaves.
    """
    levels, left = [], pins
    for level in range(first, squares.last_level + 1):
        cells = handoff.store(level_cells(left, level, leaf_pins, squares), f"level-{level}")
        facts = cells.agg(F.count("*").alias("cells"), F.count_if(~F.col("leaf")).alias("open")).first()
        levels.append((cells, facts["cells"]))
        if not facts["open"]:
            break
        here = squares.cell_of("pin_latitude", "pin_longitude", level)
        opened = cells.filter(~F.col("leaf")).select(F.col("cell").alias("_open"))
        left = left.join(broadcast_below(opened, facts["open"] * 8 * 3), here == F.col("_open"), "left_semi")
    return levels


def leaf_places(pins: DataFrame, levels: list[tuple[DataFrame, int]], squares: Squares, first: int) -> DataFrame:
    """Each pin with its leaf: of its cells on all levels the one that is a leaf."""
    leaves = None
    for cells, _ in levels:
        own = cells.filter("leaf").select("level", "cell")
        leaves = own if leaves is None else leaves.unionByName(own)
    leaves = broadcast_below(leaves, sum(n for _, n in levels) * 8 * 4)
    placed = pins.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(first + len(levels) - 1))))
    return placed.withColumn("cell", squares.cell_of("pin_latitude", "pin_longitude", F.col("level"))).join(leaves, ["level", "cell"], "left_semi")


def dealt_by_point(points: DataFrame) -> DataFrame:
    """Distinct points dealt by a hash of theirs in a column of its own, POINT. Spark normalises floating-point keys, so
    rows dealt by the coordinates themselves are dealt once more, with all their cells, when the bounds of a point meet."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.withColumn(POINT, F.xxhash64("latitude", "longitude")).repartition(n, POINT)


def narrowed(rows: DataFrame) -> DataFrame:
    """Rows of a frontier whose cell may hold the nearest PIN of their point. What a row itself and the levels before
    rule out leaves before the bounds of a point's rows meet."""
    near = F.col("gap") <= F.col("bound") + ROOM_KM
    of_point = Window.partitionBy(POINT, "latitude", "longitude")
    return rows.filter(near).withColumn("bound", F.min("bound").over(of_point)).filter(near)


def frontier(rows: DataFrame, levels: list[tuple[DataFrame, int]], squares: Squares) -> DataFrame:
    """(latitude, longitude, level, cell): for each point the leaves that may hold its nearest PIN.

    `rows` is what the search starts with, `dealt_by_point`: POINT, latitude, longitude, level, cell, leaf, gap, bound.
    """
    for cells, n in levels:
        below = cells.select(F.col("parent").alias("cell"), F.lit(False).alias("leaf"), (F.col("level") - 1).alias("level"),
                             F.struct("cell", "leaf", "level", "rep_lat", "rep_lon").alias("child"))
        rows = rows.join(broadcast_below(below, n * 8 * 10), ["level", "cell", "leaf"], "left")
        child, open_cell = F.col("child"), F.col("child").isNotNull()
        gap = squares.gap_km("latitude", "longitude", child["level"], child["cell"])
        rows = narrowed(rows.select(
            POINT, "latitude", "longitude",
            *(F.when(open_cell, child[c]).otherwise(F.col(c)).alias(c) for c in ("level", "cell", "leaf")),
            F.when(open_cell, gap).otherwise(F.col("gap")).alias("gap"),
            F.least("bound", haversine_km("latitude", "longitude", child["rep_lat"], child["rep_lon"])).alias("bound"),
        ))
    return rows.select("latitude", "longitude", "level", "cell")


def distinct_points(pins: DataFrame) -> DataFrame:
    """Each PIN point once: PINs at one point differ only in what they are called, the smallest pincode wins there."""
    at_point = pins.groupBy("pin_latitude", "pin_longitude").agg(F.min(F.struct("pincode", "district", "statename")).alias("_pin"))
    return at_point.select("pin_latitude", "pin_longitude", "_pin.*")


def best_at_point(pairs: DataFrame) -> DataFrame:
    """(latitude, longitude, pincode, district, statename, distance_km): the nearest PIN of each point, ties to the smallest pincode."""
    nearest = F.min_by(F.struct("pincode", "district", "statename", "distance_km"), F.struct("distance_km", "pincode")).alias("_best")
    return pairs.groupBy("latitude", "longitude").agg(nearest).select("latitude", "longitude", "_best.*")
