"""Bulk-synchronous supersteps over a graph: emit, combine by receiver, apply, vote.

State and edges are bucketed tables of one number of buckets, by vertex and by source, so a
superstep exchanges nothing but messages. A source with very many edges, a hub, is mirrored: its edges
are dealt over parts of about ``hub`` edges each, and its state is sent to each part.

The driver loop decides only on whether a vertex changed, which is counted as the new state is
written. State is written each superstep, so the plan doesn't grow and a lost executor costs one superstep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import INF
from ..operators.partition import with_default
from ..profile import section
from ..session import drop_scratch, scratch_table

#: Edges of a part of a hub; hubs up to which their table is broadcast (16 bytes a row).
HUB, FEW_HUBS = 1_000_000, 1 << 18
#: Vertices that send up to which they are broadcast to the edges (16 bytes a row), which then needn't be sorted.
FEW_SENDERS = 1 << 16


@dataclass(frozen=True)
class Program:
    """message: of state and edge columns; combine: aggregate of ``message``; apply: of ``state`` and ``message``."""

    message: Callable[[], Column]
    combine: Callable[[], Column]
    apply: Callable[[], Column]
    none: Column


def shortest() -> Program:
    return Program(lambda: F.col("state") + F.col("w"), lambda: F.min("message"), lambda: F.least("state", "message"), F.lit(INF).cast("bigint"))


@dataclass(frozen=True)
class Edges:
    """plain: (src, dst, w) of all sources but hubs, bucketed by src; hubs: (src, parts); spread: (src, part, dst, w) of hubs, bucketed by (src, part)."""

    plain: DataFrame
    hubs: DataFrame | None = None
    spread: DataFrame | None = None
    tables: tuple[str, ...] = ()
    few: bool = True

    def seen_by(self, spark: SparkSession) -> Edges:
        """The same tables, read in another session."""
        return Edges(*(spark.table(t) for t in self.tables), tables=self.tables, few=self.few)


def bucketed(df: DataFrame, buckets: int, *keys: str) -> str:
    """df written as a bucketed, sorted table, a file a bucket; its name."""
    name = scratch_table(df.sparkSession)
    df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(edges: DataFrame, hub: int = HUB) -> Edges:
    """Edges written so that no superstep moves them again. Sources of more than ``hub`` edges are hubs: a bucket holds whole
    sources, and parts of hubs, of at most about ``hub`` edges each."""
    spark, n = edges.sparkSession, _buckets(edges.sparkSession)
    whole = bucketed(edges, n, "src")
    plain = spark.table(whole)
    degrees = plain.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > hub)
    heads = bucketed(degrees.select("src", F.ceil(F.col("degree") / hub).cast("int").alias("parts")), 1, "src")  # a row for each ``hub`` edges at most
    hubs = spark.table(heads)
    many = hubs.count()
    if not many:
        drop_scratch(spark, heads)
        return Edges(plain, tables=(whole,))
    near = F.broadcast(hubs) if many <= FEW_HUBS else hubs
    parts = plain.join(near, "src").withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")).drop("parts")
    spread = bucketed(parts.select("src", "part", *[c for c in edges.columns if c != "src"]), n, "src", "part")
    rest = bucketed(plain.join(near, "src", "left_anti"), n, "src")
    drop_scratch(spark, whole)
    return Edges(spark.table(rest), hubs, spark.table(spread), (rest, heads, spread), many <= FEW_HUBS)


def messages(state: DataFrame, edges: DataFrame | Edges, program: Program, few: bool = False) -> DataFrame:
    """(node_id, message): one for each edge whose source has a state. few: these are FEW_SENDERS at most."""
    near = F.broadcast if few else lambda df: df
    senders = state.select(F.col("node_id").alias("src"), "state")
    sent = lambda met: met.select(F.col("dst").alias("node_id"), program.message().alias("message"))
    if not isinstance(edges, Edges):
        return sent(senders.join(edges, "src"))
    out = sent(near(senders).join(edges.plain, "src"))
    if edges.hubs is None:
        return out
    mirrors = senders.join(F.broadcast(edges.hubs) if edges.few else edges.hubs, "src")
    mirrors = mirrors.select("src", "state", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return out.unionByName(sent(near(mirrors).join(edges.spread, ["src", "part"])))


def combine(sent: DataFrame, program: Program) -> DataFrame:
    return sent.groupBy("node_id").agg(program.combine().alias("message"))


def update(state: DataFrame, combined: DataFrame, program: Program) -> DataFrame:
    """(node_id, state, changed)."""
    met = with_default(state.select("node_id", "state"), combined, "node_id", "message", program.none)
    new = program.apply()
    return met.select("node_id", new.alias("state"), (new != F.col("state")).alias("changed"))


def votes(updated: DataFrame, slices: DataFrame) -> DataFrame:
    """(clique_idx, halt): a slice votes to halt if none of its states changed."""
    return updated.join(slices, "node_id").groupBy("clique_idx").agg(F.every(~F.col("changed")).alias("halt"))


def superstep(state: DataFrame, edges: DataFrame | Edges, program: Program) -> DataFrame:
    return update(state, combine(messages(state, edges, program), program), program)


def _planned_once(spark: SparkSession) -> SparkSession:
    """A session of the same tables and settings whose plans are made before they run: a superstep reads tables of known sizes and fixed
    buckets, so there is nothing to put together or split on the way, and planning stage by stage costs more than small steps do."""
    made = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            made.conf.set(key, value)
    made.conf.set("spark.sql.adaptive.enabled", "false")
    return made


def run(state: DataFrame, edges: DataFrame, program: Program, max_supersteps: int = 10_000, frontier: bool = True, hub: int = HUB) -> tuple[DataFrame, int]:
    """The final (node_id, state) and the number of supersteps (the first only emits, the last changes nothing).

    frontier: only vertices that changed send, which gives the same result for programs whose
    combine and apply are monotone and idempotent (minimum). hub: edges above which a source is mirrored.
    """
    spark = state.sparkSession
    once, known, n = _planned_once(spark), dealt(edges, hub), _buckets(spark)
    known = known.seen_by(once)
    table = bucketed(state.select("node_id", "state", (F.col("state") < INF).alias("changed")), n, "node_id")
    try:
        sending = once.table(table).where("changed").count()
        for step in range(2, max_supersteps + 1):
            with section("superstep", step) as timed:
                now = once.table(table)
                seen, new = Observation(f"changed-{table}-{step}"), scratch_table(spark)
                made = update(now, combine(messages(now.where("changed") if frontier else now, known, program, frontier and sending <= FEW_SENDERS), program), program)
                made = made.observe(seen, F.count_if("changed").alias("changed"))
                timed.seen(made).write.bucketBy(n, "node_id").sortBy("node_id").saveAsTable(new)
                drop_scratch(spark, table)
                table = new
            sending = seen.get["changed"]
            if not sending:
                return spark.table(table).select("node_id", "state"), step
    finally:
        drop_scratch(spark, *known.tables)
    raise RuntimeError(f"no halt within {max_supersteps} supersteps")
