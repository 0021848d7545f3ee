"""Graphs: adjacency, start state and single-source shortest distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import INF
from ..streaming import bsp


def edges_of(adjacency: DataFrame) -> DataFrame:
    """(src, dst, w) from (node_id, edges)."""
    return adjacency.select(F.col("node_id").alias("src"), F.explode("edges").alias("e")).select("src", "e.dst", "e.w")


def adjacency(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, edges): every vertex, its edges ascending; each target must be a vertex."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("edges"))
    none = F.array().cast("array<struct<dst:bigint,w:bigint>>")
    return vertices.select("node_id").join(out, "node_id", "left").withColumn("edges", F.coalesce("edges", none))


def start(vertices: DataFrame, source: int) -> DataFrame:
    """0 for the source, unreachable for all others."""
    return vertices.select("node_id", F.when(F.col("node_id") == source, 0).otherwise(INF).cast("bigint").alias("state"))


def checked(node_id: str = "node_id", edges: str = "edges", weights: str = "weights"):
    """The edge and weight lists of a vertex zipped; lists of different size are an error."""
    same = F.size(edges) == F.size(weights)
    pairs = F.zip_with(edges, weights, lambda d, w: F.struct(d.alias("dst"), w.alias("w")))
    return F.when(same, pairs).otherwise(F.raise_error(F.concat(F.lit("edges and weights differ at "), F.col(node_id).cast("string"))))


def shortest_distances(vertices: DataFrame, edges: DataFrame, source: int, max_supersteps: int = 10_000, frontier: bool = True, hub: int = bsp.HUB) -> tuple[DataFrame, int]:
    """(node_id, state) with 2147483647 for unreachable vertices, and the supersteps taken."""
    return bsp.run(start(vertices, source), edges.select("src", "dst", "w"), bsp.shortest(), max_supersteps, frontier, hub)
