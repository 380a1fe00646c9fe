"""Sinks (A3/A4): full overwrite of a Parquet folder or a catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def overwrite_parquet(df: DataFrame, path: str) -> None:
    """A3: replace the folder's content and schema with `df` (idempotent on retry)."""
    df.write.mode("overwrite").parquet(path)


def overwrite_table(df: DataFrame, name: str) -> None:
    """A3: replace a catalog table, schema included."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def create_or_replace(df: DataFrame, name: str) -> None:
    """A4: CTAS. In a v2 catalog (a configured `spark.sql.catalog.<name>`) this is CREATE OR REPLACE TABLE ... AS;
    the built-in session catalog has no such statement, there it is a schema-replacing overwrite."""
    spark = df.sparkSession
    parts = name.split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    if spark.conf.get(f"spark.sql.catalog.{catalog}", None):
        df.writeTo(name).createOrReplace()
    else:
        overwrite_table(df, name)
