"""Geographic Column builders: coordinate parsing, grid cells, distance, boxes.

All are plain Column expressions (JVM-side, whole-stage codegen), never UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
DEFAULT_GRID_DEGREES = 0.1

# A plain decimal number, optionally signed / exponent, optional blanks around.
# Anything else ("NA", DMS fragments, "NaN", "Infinity", "17.5d") is not a coordinate.
_DECIMAL_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_coordinate(c, limit: float) -> Column:
    """Text -> double, NULL unless it is a finite decimal within [-limit, limit]."""
    text = _as_col(c).cast("string")
    value = F.when(text.rlike(_DECIMAL_TEXT), text.try_cast("double"))
    return F.when(value.between(-limit, limit), value)


def parse_latitude(c) -> Column:
    return parse_coordinate(c, 90.0)


def parse_longitude(c) -> Column:
    return parse_coordinate(c, 180.0)


def grid_cell(c, cell_degrees: float = DEFAULT_GRID_DEGREES) -> Column:
    """Integer grid index of a coordinate: floor(x / cell)."""
    return F.floor(_as_col(c) / F.lit(float(cell_degrees)))


def haversine_term(p1, cos1, l1, p2, l2) -> Column:
    """The haversine of the angle between two points in radians; `cos1` is the cosine of the latitude `p1`."""
    p1, cos1, l1, p2, l2 = (_as_col(c) for c in (p1, cos1, l1, p2, l2))
    half_dlat = (p2 - p1) / 2
    half_dlon = (l2 - l1) / 2
    return F.pow(F.sin(half_dlat), 2) + cos1 * F.cos(p2) * F.pow(F.sin(half_dlon), 2)


def term_km(h) -> Column:
    """Distance in km of a haversine term; a column is worked out once, an expression twice."""
    h = _as_col(h)
    clamped = F.when(h > 1.0, F.lit(1.0)).otherwise(h)  # NULL stays NULL (least() would skip it)
    return F.asin(F.sqrt(clamped)) * (2 * EARTH_RADIUS_KM)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km on a sphere of radius 6371 km.

    The haversine term is clamped to 1 so rounding can never push asin out of
    its domain (which would yield NaN); NULL inputs give NULL.
    """
    p1 = F.radians(_as_col(lat1))
    return term_km(haversine_term(
        p1, F.cos(p1), F.radians(_as_col(lon1)), F.radians(_as_col(lat2)), F.radians(_as_col(lon2))))


def rounded(c, places: int) -> Column:
    """`F.round(c, places)` of a double column, bit for bit, without decimal arithmetic for most values.

    Only beside a tie (and beyond 1e12 units, and for NaN) the decimal digits decide, as `F.round` reads them; elsewhere
    the nearest whole number of units is the same, and its quotient the same double.
    """
    c, scale = _as_col(c), F.lit(10.0**places)
    units = F.rint(c * scale)
    clear = (F.abs(c * scale) < 1e12) & (F.abs(c * scale - units) < 0.499)
    return F.when(clear, (units + 0.0) / scale).otherwise(F.round(c, places))  # + 0.0: no negative zero


def box_half_widths(lat, radius_km, km_per_degree: float = 111.0) -> tuple[Column, Column]:
    """Half-height and half-width (degrees) of a box around a point and radius.

    Longitude degrees shrink with cos(latitude); the divisor is kept >= 1 km so
    the box stays finite near the poles.
    """
    r = _as_col(radius_km).cast("double")
    dlat = r / km_per_degree
    dlon = r / F.greatest(F.cos(F.radians(_as_col(lat))) * km_per_degree, F.lit(1.0))
    return dlat, dlon
