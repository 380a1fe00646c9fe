"""E5/E6 — quality reports, each a single aggregate job (no repeated counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pincode_report(lookup: DataFrame) -> DataFrame:
    return lookup.agg(
        F.count(F.lit(1)).alias("total_pincodes"),
        F.count_if(F.col("district_match_count") > 1).alias("ambiguous_pincodes"),
        F.count_if(~F.col("has_coordinates")).alias("pincodes_without_coordinates"),
        F.count_if(F.col("district").isNull()).alias("pincodes_null_district"),
    )


def nearest_report(nearest_complete: DataFrame) -> DataFrame:
    """Facilities with coordinates, matched, unmatched and duplicate ids (D11): partial sums by id, then of these."""
    by_id = nearest_complete.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("coord_nearest_pincode").alias("n_matched"),
        F.max("coord_nearest_pin_distance_km").alias("farthest"),
    )
    return by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("facilities_with_coordinates"),
        F.coalesce(F.sum("n_matched"), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.col("n") - F.col("n_matched")), F.lit(0)).alias("unmatched"),
        F.round(F.max("farthest"), 2).alias("max_distance_km"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
    )


def confidence_distribution(location: DataFrame) -> DataFrame:
    """Count per class with its share of all rows, largest first."""
    total = F.sum("n").over(Window.partitionBy())  # one row per class: tiny
    return (
        location.groupBy("location_confidence").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "location_confidence",
            F.col("n").alias("facility_count"),
            F.round(F.col("n") * 100.0 / total, 1).alias("pct"),
        )
        .orderBy(F.col("facility_count").desc(), "location_confidence")
    )


def index_report(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("unique_id").alias("distinct_ids"),
        F.count_if(F.col("district").isNull()).alias("null_district"),
        F.count_if(F.col("standardized_services").isNull()).alias("null_services"),
    )
