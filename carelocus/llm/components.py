"""Connected components by alternating star contractions, with joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelocus.llm.common import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (u, v) edges, u > v: the large star links every greater neighbour of a node to the least of
    its neighbourhood, the small star the node and its smaller neighbours. A node's least neighbour comes from an
    aggregate with partial sums, so a hub's edges never meet in one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter(F.col("u") != F.col("v")).distinct()


def starred(edges: DataFrame) -> bool:
    """Whether distinct (u, v) edges, u > v, are stars already: each u has one edge, and no v is a u."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of an edge table (a, b); a component's name is its least node."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    while not starred(now):
        now = stored(star(star(now, large=True), large=False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
