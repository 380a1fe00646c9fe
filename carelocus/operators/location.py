"""J3 — grade each facility's location by comparing two independent signals.

Signal 1: the stated postcode looked up in the PIN table (LEFT equi-join).
Signal 2: the nearest PIN point of the facility's own coordinates (J2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelocus.functions.geo import parse_latitude, parse_longitude
from carelocus.operators.sizing import broadcast_if_small

MAX_PLAUSIBLE_KM = 50.0

LOCATION_COLUMNS = [
    "facility_id", "latitude", "longitude", "postcode",
    "pin_district", "pin_state", "pin_district_match_count",
    "coord_nearest_pin_district", "coord_nearest_pin_state", "coord_nearest_pin_distance_km",
    "district", "state", "location_confidence",
]


def facility_base(facilities: DataFrame, normalize_postcode: bool = False) -> DataFrame:
    postcode = F.col("address_zipOrPostcode")
    if normalize_postcode:  # D15 option; default keeps exact string equality
        postcode = F.trim(postcode)
    return facilities.select(
        F.col("unique_id").alias("facility_id"),
        parse_latitude("latitude").alias("latitude"),
        parse_longitude("longitude").alias("longitude"),
        postcode.alias("postcode"),
    )


def postcode_join(facilities: DataFrame, lookup: DataFrame, normalize_postcode: bool = False,
                  check_broadcast: bool = True) -> DataFrame:
    """Facilities LEFT JOIN the PIN table on postcode = pincode."""
    pins = lookup.select(
        F.col("pincode"),
        F.col("district").alias("pin_district"),
        F.col("statename").alias("pin_state"),
        F.col("district_match_count").alias("pin_district_match_count"),
    )
    base = facility_base(facilities, normalize_postcode)
    # Postal codes are a bounded set: broadcast after a size check, else a shuffle join
    # (AQE splits a postcode shared by a large share of facilities).
    pins = broadcast_if_small(pins) if check_broadcast else pins
    return base.join(pins, base.postcode == pins.pincode, "left").drop("pincode")


def confidence_class(max_km: float = MAX_PLAUSIBLE_KM) -> Column:
    """The four-way class.

    confirmed        both signals present, PIN unambiguous, districts equal
    coordinate_based a plausible coordinate match that was not confirmed
    ambiguous_pin    stated PIN spans several districts, no plausible coordinate match
    unresolved       everything else
    """
    stated = F.col("postcode").isNotNull() & F.col("pin_district").isNotNull()
    coord_ok = F.coalesce(
        F.col("coord_nearest_pin_district").isNotNull() & (F.col("coord_nearest_pin_distance_km") <= max_km),
        F.lit(False),
    )
    same_district = F.upper(F.trim("pin_district")) == F.upper(F.trim("coord_nearest_pin_district"))
    confirmed = F.coalesce(
        stated & (F.col("pin_district_match_count") == 1) & coord_ok & same_district, F.lit(False))
    return (
        F.when(confirmed, F.lit("confirmed"))
        .when(coord_ok, F.lit("coordinate_based"))
        .when(F.coalesce(stated & (F.col("pin_district_match_count") != 1), F.lit(False)), F.lit("ambiguous_pin"))
        .otherwise(F.lit("unresolved"))
    )


def _resolved(coord_col: str, pin_col: str) -> Column:
    """Coordinate answer when confirmed/coordinate_based, PIN answer when ambiguous."""
    conf = F.col("location_confidence")
    return (
        F.when(conf.isin("confirmed", "coordinate_based"), F.col(coord_col))
        .when(conf == "ambiguous_pin", F.col(pin_col))
        .otherwise(F.lit(None).cast("string"))
    )


def classify(with_signals: DataFrame, max_km: float = MAX_PLAUSIBLE_KM) -> DataFrame:
    return (
        with_signals.withColumn("location_confidence", confidence_class(max_km))
        .withColumn("district", _resolved("coord_nearest_pin_district", "pin_district"))
        .withColumn("state", _resolved("coord_nearest_pin_state", "pin_state"))
        .select(*LOCATION_COLUMNS)
    )


def locate_facilities(facilities: DataFrame, lookup: DataFrame, nearest: DataFrame,
                      max_km: float = MAX_PLAUSIBLE_KM, normalize_postcode: bool = False) -> DataFrame:
    """One row per facility with both signals, the class and the resolved place."""
    with_pin = postcode_join(facilities, lookup, normalize_postcode)
    near = nearest.select(
        "facility_id", "coord_nearest_pin_district", "coord_nearest_pin_state", "coord_nearest_pin_distance_km")
    return classify(with_pin.join(near, "facility_id", "left"), max_km)
