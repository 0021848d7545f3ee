"""Random vectors and graphs; the same seed gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _below(n, *key):
    return F.pmod(F.xxhash64(*key), F.lit(n) if isinstance(n, int) else n)


def vectors(spark: SparkSession, rows: int, least: int, most: int, seed: int = 1, top: int = 128) -> DataFrame:
    """(row_id, terms): lengths least .. most, terms 1 .. top, uniform."""
    ids = spark.range(rows).withColumnRenamed("id", "row_id")
    size = (_below(most - least + 1, F.lit(seed), F.col("row_id")) + least).cast("int")
    term = lambda i: _below(top, F.lit(seed + 1), F.col("row_id"), i) + 1
    return ids.select("row_id", F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), term).alias("terms"))


def graph(spark: SparkSession, nodes: int, edges: int, seed: int = 1, top: int = 128) -> DataFrame:
    """(src, dst, w): exactly ``edges`` distinct directed edges without loops, weights 1 .. top.

    The nodes * (nodes - 1) possible edges are numbered. More numbers than wanted are drawn (of a dense graph, all), and
    of the distinct ones those of smallest hash are left out.
    """
    every = nodes * (nodes - 1)
    if edges > every:
        raise ValueError(f"{nodes} nodes have {every} edges at most")
    if edges == 0:
        found, many = spark.range(0).select(F.col("id").alias("e")), 0
    elif 2 * edges > every:
        found, many = spark.range(every).select(F.col("id").alias("e")), every
    else:
        draws, many = edges, 0
        while many < edges:
            draws = int(1.6 * draws) + 64
            found = spark.range(draws).select(_below(every, F.lit(seed), F.col("id")).alias("e")).distinct()
            many = found.count()
    order = F.xxhash64(F.lit(seed + 1), "e")
    if many > edges:
        left = found.orderBy(order, "e").limit(many - edges)
        found = found.join(left, "e", "left_anti")
    src, rest = F.floor(F.col("e") / (nodes - 1)).cast("bigint"), F.col("e") % (nodes - 1)
    ends = found.select(src.alias("src"), F.when(rest >= src, rest + 1).otherwise(rest).alias("dst"))  # no loop
    return ends.select("src", "dst", (_below(top, F.lit(seed + 2), F.col("src"), F.col("dst")) + 1).alias("w"))
