"""Checked broadcasts: broadcast a side only after measuring it.

Static size estimates can be far off after aggregations and explodes, and a
runtime (AQE) switch to a broadcast join happens only after both sides have
already been shuffled. So where one side is expected to be small but is
data-dependent (PIN cells, search boxes, winners), we measure its bytes on a
stored input, or count the rows an explode will make before it is made, and
broadcast only under a byte bound. Beyond it the plain join stays, with AQE's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT_BYTES = 64 * 1024 * 1024


def broadcast_limit(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("carelocus.broadcast.maxBytes", None)
    return int(conf) if conf else DEFAULT_LIMIT_BYTES


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows: a word a column, texts at their real length, and other values of varying size written out."""
    sizes = F.lit(8 * (len(df.columns) + 2)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes = sizes + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes = sizes + F.octet_length(F.to_json(F.struct(f.name)))
    return df.select(sizes.alias("b")).agg(F.sum("b")).first()[0] or 0


def broadcast_below(df: DataFrame, size: int, limit_bytes: int | None = None) -> DataFrame:
    """`broadcast(df)` when a size known beforehand fits the limit, else `df` unchanged."""
    return F.broadcast(df) if size <= (broadcast_limit(df) if limit_bytes is None else limit_bytes) else df


def broadcast_if_small(df: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """`broadcast(df)` when its measured bytes fit the limit, else `df` unchanged."""
    return broadcast_below(df, measured_bytes(df), limit_bytes)


def broadcast_or_merge(df: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """`broadcast(df)` when its measured bytes fit the limit, else `df` for a shuffle join by all means.

    For sides made by an explode: Spark's own estimate does not count the copies, so it may take a side of any size
    for a small one and broadcast what the measure has just refused.
    """
    limit = broadcast_limit(df) if limit_bytes is None else limit_bytes
    return F.broadcast(df) if measured_bytes(df) <= limit else df.hint("merge")
