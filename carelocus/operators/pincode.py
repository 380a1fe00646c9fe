"""J1 — collapse a postal directory (one row per office) to one row per PIN code.

Plan: one partial+final aggregate per (pincode, district, state) variant, then
one aggregate per pincode over those (much smaller) variant rows. The modal
district, the number of distinct districts, the coordinate means, the
coordinate flag and the office count all come out of that second aggregate.
The directory is scanned once; office-level rows cross the network only after
map-side combine, and the later exchanges (the distinct-district phase and the
per-PIN merge) move pre-aggregated variant rows, so a PIN holding a large share
of all offices never reaches one reducer as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelocus.functions.geo import parse_latitude, parse_longitude

# Coordinate means are rounded so the result does not depend on the order in
# which partial sums are combined (about 0.1 m at 6 places).
COORD_DECIMALS = 6

LOOKUP_COLUMNS = [
    "pincode", "district", "statename", "district_match_count",
    "latitude", "longitude", "has_coordinates", "office_count",
]


def normalize_directory(directory: DataFrame) -> DataFrame:
    """B1: PIN as text, upper-cased trimmed names, coordinates parsed (NULL when unusable)."""
    return directory.select(
        F.col("pincode").cast("string").alias("pincode"),
        F.trim(F.upper("district")).alias("district_norm"),
        F.trim(F.upper("statename")).alias("statename_norm"),
        parse_latitude("latitude").alias("latitude"),
        parse_longitude("longitude").alias("longitude"),
    )


def district_counts(normalized: DataFrame, paired_only: bool = False) -> DataFrame:
    """Offices per (pincode, district, state), with coordinate partial sums.

    Latitude and longitude are averaged independently by default (an office
    with only one of them still counts for that axis); ``paired_only=True``
    averages only offices that have both (D7 option).
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    pair = lat.isNotNull() & lon.isNotNull()
    if paired_only:
        lat, lon = F.when(pair, lat), F.when(pair, lon)
    return normalized.groupBy("pincode", "district_norm", "statename_norm").agg(
        F.count(F.lit(1)).alias("office_count_for_district"),
        F.sum(lat).alias("lat_sum"),
        F.count(lat).alias("lat_n"),
        F.sum(lon).alias("lon_sum"),
        F.count(lon).alias("lon_n"),
        F.bool_or(pair).alias("any_pair"),
    )


def _modal_pick() -> F.Column:
    # Most offices first; ties -> district ascending with NULL first, then state.
    # min over a struct compares field by field, NULL fields first.
    return F.min_by(
        F.struct(F.col("district_norm").alias("district"), F.col("statename_norm").alias("statename")),
        F.struct(-F.col("office_count_for_district"), F.col("district_norm"), F.col("statename_norm")),
    )


def modal_district(counts: DataFrame) -> DataFrame:
    """The most frequent (district, state) of each PIN."""
    return (
        counts.groupBy("pincode")
        .agg(_modal_pick().alias("m"))
        .select("pincode", F.col("m.district").alias("district"), F.col("m.statename").alias("statename"))
    )


def district_ambiguity(normalized: DataFrame) -> DataFrame:
    """Number of distinct non-NULL districts per PIN."""
    return normalized.groupBy("pincode").agg(F.count_distinct("district_norm").alias("district_match_count"))


def _mean(sum_col: str, n_col: str) -> F.Column:
    n = F.sum(n_col)
    return F.round(F.when(n > 0, F.sum(sum_col) / n), COORD_DECIMALS)


def coordinate_means(counts: DataFrame) -> DataFrame:
    """Mean latitude / longitude of offices that have them, flag and office count."""
    return counts.groupBy("pincode").agg(
        _mean("lat_sum", "lat_n").alias("latitude"),
        _mean("lon_sum", "lon_n").alias("longitude"),
        F.bool_or("any_pair").alias("has_coordinates"),
        F.sum("office_count_for_district").alias("office_count"),
    )


def build_pincode_lookup(directory: DataFrame, paired_only: bool = False) -> DataFrame:
    """One row per PIN: modal district/state, ambiguity, mean point, flags."""
    counts = district_counts(normalize_directory(directory), paired_only)
    per_pin = counts.groupBy("pincode").agg(
        _modal_pick().alias("m"),
        F.count_distinct("district_norm").alias("district_match_count"),
        _mean("lat_sum", "lat_n").alias("latitude"),
        _mean("lon_sum", "lon_n").alias("longitude"),
        F.bool_or("any_pair").alias("has_coordinates"),
        F.sum("office_count_for_district").alias("office_count"),
    )
    return per_pin.select(
        "pincode",
        F.col("m.district").alias("district"),
        F.col("m.statename").alias("statename"),
        "district_match_count", "latitude", "longitude", "has_coordinates", "office_count",
    )
