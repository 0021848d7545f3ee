"""Connected components by alternating large-star and small-star steps.

Every step is a group-by minimum, combined before the shuffle, and a join of the edges with
the minima; where a hub has many edges, adaptive execution splits its side of the join. Each
round is written to the shared folder: no growing lineage, and nothing is gathered on the
driver but one count. Tasks that find edges hand on a spanning forest of theirs (``spanning``),
so a node has about one edge for each task that saw it, whatever its group's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node of its component, node) that connect just what the edges a[i] - b[i] connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    of = np.arange(len(nodes))
    while True:
        low = np.minimum(of[x], of[y])
        new = of.copy()
        np.minimum.at(new, of[x], low)  # the roots first, then what hangs on them
        np.minimum.at(new, of[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, of):
            other = np.flatnonzero(of != np.arange(len(nodes)))
            return nodes[of[other]], nodes[other]
        of = new


def connected(spark: SparkSession, edges: DataFrame, name: str, most_rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Repeated edges, either direction and loops are allowed; no edge, no row. rows: how many edges there are at most, where known.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = common.durable(spark, now, f"edges-{name}", rows)
    known, rows = None, now.count()
    for _ in range(most_rounds):
        stars = _small_star(_large_star(now))
        done = common.durable(spark, stars, f"edges-{name}", rows)
        # a star forest is reached when no step changes the edges
        mark = tuple(done.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        common.dropped(spark, now)
        now = done
        if mark == known:
            break
        known = mark
    else:
        raise RuntimeError(f"components of {name} did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them (edges point from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
