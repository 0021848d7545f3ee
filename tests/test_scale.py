"""What must hold at any size: hubs, hot rows, exchanges of supersteps, sections that ran."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ravelin import profile
from ravelin import session as S
from ravelin.plans import cooc, graph, mapreduce
from ravelin.sources import text
from ravelin.streaming import bsp


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def hub_edges(spark):
    """Vertex 0 has half of all edges."""
    rng = random.Random(3)
    rows = {(0, k): rng.randrange(1, 90) for k in range(1, 3001)}
    while len(rows) < 6000:
        a, b = rng.randrange(1, 3001), rng.randrange(3001)
        if a != b:
            rows[a, b] = rng.randrange(1, 9)
    return spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src bigint, dst bigint, w bigint").repartition(3)


def test_hubs_are_mirrored(spark, hub_edges):
    edges = bsp.dealt(hub_edges, hub=150)
    assert rows_of(edges.hubs.select("src")) == [(0,)] and edges.plain.where("src = 0").isEmpty()
    parts = edges.spread.groupBy("src", "part").count().collect()
    assert sum(r["count"] for r in parts) == 3000 and max(r["count"] for r in parts) < 2 * 150
    per_task = edges.spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 3000 * 0.5
    state = spark.range(3001).select(F.col("id").alias("node_id"), F.col("id").alias("state"))
    program = bsp.shortest()
    want = rows_of(bsp.messages(state, hub_edges, program))
    assert rows_of(bsp.messages(state, edges, program)) == want and len(want) == 6000
    nodes = state.select("node_id")
    plain, steps = graph.shortest_distances(nodes, hub_edges, 5)
    mirrored, same = graph.shortest_distances(nodes, hub_edges, 5, hub=40)
    assert rows_of(plain) == rows_of(mirrored) and steps == same


def test_supersteps_exchange_messages_only(spark, hub_edges):
    edges = bsp.dealt(hub_edges)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = spark.table(bsp.bucketed(graph.start(spark.range(3001).withColumnRenamed("id", "node_id"), 0), n, "node_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no side were small
    try:
        plan = bsp.superstep(state, edges, bsp.shortest())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = re.findall(r"Exchange (\S+)", plan)
    assert len(exchanges) == 1 and "partial_min" in plan.split("Exchange")[1] and plan.count("Bucketed: true") == 3


def test_few_senders_leave_edges_unsorted(spark, hub_edges):
    """A small frontier is sent to the edges, hubs' too; the same messages without a sort or an exchange of edges."""
    for edges in (bsp.dealt(hub_edges), bsp.dealt(hub_edges, hub=150)):
        state = graph.start(spark.range(3001).withColumnRenamed("id", "node_id"), 0)
        few = bsp.messages(state, edges, bsp.shortest(), few=True)
        assert rows_of(few) == rows_of(bsp.messages(state, edges, bsp.shortest()))
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 1


def test_scratch_tables_go(spark):
    name = bsp.bucketed(spark.range(5), 2, "id")
    folder = S.scratch_folder(spark)
    spark.range(3).write.parquet(folder)
    assert spark.catalog.tableExists(name)
    S.clean_scratch(spark)
    assert not spark.catalog.tableExists(name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def terms_of(spark, rows):
    return spark.createDataFrame([(i, t) for i, v in enumerate(rows) for t in v], "row_id bigint, term bigint").repartition(4)


@pytest.mark.parametrize("length", [None, 3])
def test_tiles_give_the_same_stripes(spark, length):
    rng = random.Random(2)
    counts = cooc.term_counts(terms_of(spark, [[rng.randrange(1, 60) for _ in range(n)] for n in (1, 2, 5, 30, 200, 55)]))
    flat = lambda made: rows_of(made.select("row_id", "key", F.explode("stripe").alias("s")).select("row_id", "key", "s.term", "s.cnt"))
    want = flat(cooc.stripes(counts, length))
    for tile in (1, 4, 1000):
        assert flat(cooc.tiled(counts, length, tile)) == want


def test_hot_rows_are_dealt(spark):
    """A row of 200,000 terms: cut stripes in time that grows with the terms; whole ones with the pairs of its tiles over many tasks."""
    hot = spark.range(200_000).select(F.lit(7).cast("bigint").alias("row_id"), (F.col("id") + 1).alias("term"))
    terms = hot.unionByName(terms_of(spark, [[3, 5, 5], [9]]))
    found, few = cooc.hot_rows(terms)
    assert rows_of(found) == [(7,)] and few
    cut = cooc.by_stripes(terms, 4)
    assert cut.count() == 200_000 * 4 and rows_of(cut.where("left = 5 and right <> 4")) == [(5, 1, 1), (5, 2, 1), (5, 3, 2)]
    spread = cooc.tiled(cooc.term_counts(hot.where("term <= 3000")), None, 250).select(F.spark_partition_id().alias("p"), F.size("stripe").alias("n"))
    per_task = [r["n"] for r in spread.groupBy("p").agg(F.sum("n").alias("n")).collect()]
    assert sum(per_task) == 3000 * 2999 and max(per_task) < 0.6 * sum(per_task)
    assert cooc.hot_rows(terms_of(spark, [[1, 2, 3]] * 50))[0] is None


@pytest.mark.parametrize("make", [cooc.by_stripes, cooc.by_pairs, lambda t: cooc.by_stripes(t, tile=2), lambda t: cooc.by_stripes(t, 4, pad=True, tile=2), lambda t: cooc.by_stripes(t, 4, wrap=True, partitions=2)])
def test_tasks_grow_with_the_pairs(spark, monkeypatch, make):
    """Few bytes of terms make many pairs: the sums are dealt over as many tasks as these ask for, whatever the session's number is."""
    monkeypatch.setattr(cooc, "PAIRS", 1 << 10)
    monkeypatch.setattr(mapreduce, "ROWS", 1 << 9)
    rng = random.Random(4)
    made = make(terms_of(spark, [rng.sample(range(1, 3000), 6) for _ in range(1500)]))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 0.2 * sum(sizes)


def _csv_of(terms, folder):
    text.write_csv(cooc.by_stripes(terms), str(folder))
    return terms.sparkSession.read.option("header", True).csv(str(folder)).select(F.col("_metadata.file_path").alias("task"))


@pytest.mark.parametrize(
    "make",
    [
        lambda t, _: cooc.by_stripes(t, 4, pad=True),
        lambda t, _: cooc.without_padding(cooc.by_stripes(t, 4, pad=True)),
        lambda t, _: cooc.by_stripes(t, 4, partitions=2, phases=True),
        _csv_of,
    ],
    ids=["padded", "filtered", "phases", "csv"],
)
def test_padded_and_written_sums_are_dealt_too(spark, monkeypatch, tmp_path, make):
    """Filled up stripes, their filter, runs in phases and files: sums over as many tasks as the pairs ask for."""
    monkeypatch.setattr(cooc, "PAIRS", 1 << 10, raising=False)
    monkeypatch.setattr(mapreduce, "ROWS", 1 << 9, raising=False)
    rng = random.Random(4)
    made = make(terms_of(spark, [rng.sample(range(1, 3000), 6) for _ in range(1500)]), tmp_path / "csv")
    task = F.col("task") if "task" in made.columns else F.spark_partition_id()
    sizes = [r["count"] for r in made.groupBy(task.alias("task")).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 0.2 * sum(sizes)


def test_sections_tell_what_ran(spark):
    with profile.section("lazy") as made:
        df = made.seen(spark.range(100).repartition(3))
    assert profile.SECTIONS[-1].jobs == profile.SECTIONS[-1].tasks == 0 and profile.SECTIONS[-1].rows is None
    with profile.section("run", 4) as made:
        assert made.kept(df.groupBy((F.col("id") % 9).alias("k")).count()).count() == 9
    ran = profile.SECTIONS[-1]
    assert ran[:2] == ("run", 4) and ran.rows == 9 and ran.jobs >= 2 and ran.tasks >= 4 and ran.shuffle_written > 0 and ran.shuffle_read > 0
    with pytest.raises(ZeroDivisionError), profile.section("broken"):
        raise ZeroDivisionError
    assert profile.SECTIONS[-1].name == "broken"
