"""Scans in levels, slices that rows are dealt to, ownership by table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ravelin.operators import partition as P


@pytest.mark.parametrize(("most", "ranges"), [(P.ROWS, 1), (100, 25), (9, 5 * 64)])
def test_scans_of_any_depth(spark, most, ranges):
    """The same totals in none, one or two levels of ranges; with 9 rows to a task the totals of the ranges take levels of their own."""
    rng = random.Random(1)
    rows = [(k if rng.random() < 0.5 else k**3, rng.randrange(-5, 9)) for k in range(1, 2500)]
    rows = list(dict(rows).items()) + [(None, 2)] * 7
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(3)
    ranged, n, made = P._ranged(df, "k", most)
    assert n == len(rows) and ranges <= made <= ranges + 2
    if ranges > 1:
        assert max(r["count"] for r in ranged.where("__range >= 0").groupBy("__range").count().collect()) <= 1.6 * most + 1
    got = [(r["k"], r["t"]) for r in P.running_total(df, "k", "v", "t", most).collect()]
    total, want = 14, []
    for k, v in sorted(r for r in rows if r[0] is not None):
        total += v
        want.append((k, total))
    assert sorted(r for r in got if r[0] is not None) == want
    assert sorted(t for k, t in got if k is None) == list(range(2, 15, 2))
    assert sorted(r["row_number"] for r in P.row_numbers(df, "k", most=most).collect()) == list(range(1, n + 1))


def test_no_task_of_a_scan_sees_many_rows(spark):
    """Windows stand on ranges; the one over ranges' totals is the only one that isn't dealt, and has at most as many rows."""
    plan = P.running_total(spark.range(5000).withColumn("v", F.lit(1)), "id", "v", "t", most=50)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange SinglePartition", plan)) <= 2 and "rangepartitioning" not in plan


def test_every_pass_sees_the_same_ranges(spark):
    """Approximate quantiles differ with the order of arrival: a plan that works them out again for its totals and for its rows adds what doesn't belong together."""
    ranged, _, ranges = P._ranged(spark.range(20_000).repartition(5), "id", 50)
    assert ranges > 64 and "percentile" not in ranged._jdf.queryExecution().optimizedPlan().toString()


def test_scans_are_dealt_over_tasks_that_grow(spark):
    """A task of a scan holds a few ranges, however many there are: the session's number of tasks is no bound."""
    df = spark.range(5000).withColumn("v", F.lit(1))
    for made in (P.running_total(df, "id", "v", "t", most=100), P.contiguous(df, "id", 6, most=100)):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 5000 and len(sizes) > 20 and max(sizes) < 5 * 100


def test_many_owners(spark):
    """Over 200,000 slices: nothing is collected, the keys go down a tree of three levels."""
    n = 210_000
    last = spark.range(n).select((F.col("id") * 10 + 9).alias("last_node"), F.col("id").cast("int").alias("clique_idx"))
    last = last.unionByName(last.where("clique_idx % 1000 = 0").withColumn("clique_idx", F.col("clique_idx") + n)).unionByName(spark.createDataFrame([(None, 5)], "last_node bigint, clique_idx int"))
    ids = spark.range(0, 10 * n + 30, 7).select(F.col("id").alias("node_id")).unionByName(spark.createDataFrame([(None,), (-5,)], "node_id bigint"))
    routed = P.route(ids, last)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000  # no key of an owner is in it
    want = F.when(F.col("node_id") < 0, 0).when(F.col("node_id") < 10 * n, F.floor(F.col("node_id") / 10))
    assert routed.where(~F.col("clique_idx").eqNullSafe(want.cast("int"))).count() == 0 and routed.count() == ids.count()


@pytest.mark.parametrize("slices", [1, 3, 6, 40])
def test_rows_lie_in_exact_slices(spark, slices):
    rng = random.Random(slices)
    keys = [rng.randrange(30) ** 2 for _ in range(700)] + [81] * 400
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key bigint, row int").repartition(5)
    dealt = P.by_slices(df, "key", slices)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.rdd.getNumPartitions() == slices and "rangepartitioning" not in plan
    assert len(re.findall(r"Exchange ", plan.split("BroadcastExchange")[0])) == 1
    lies = dealt.select("key", "slice", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n")).collect()
    assert all(r["slice"] == r["p"] for r in lies)
    by_place = [r["key"] for r in sorted(lies, key=lambda r: r["n"])]
    assert by_place == sorted(keys)
    ordered, step = sorted(keys), len(keys) // slices
    starts = [0] + [next((p for p in range(1, len(keys)) if p >= step * i and ordered[p] != ordered[p - 1]), len(keys)) for i in range(1, slices)]
    assert [r["start"] for r in P.range_starts(df.groupBy("key").count(), "key", "count", slices).orderBy("i").collect()] == starts
    for i, start in enumerate(starts):
        end = starts[i + 1] if i + 1 < slices else len(keys)
        assert sorted(r["key"] for r in lies if r["p"] == i) == ordered[start:end]


def test_null_keys_are_dealt(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (7, 3), (None, 4)], "key bigint, row int")
    assert sorted((r["row"], r["slice"]) for r in P.by_slices(df, "key", 2).collect()) == [(1, 0), (2, 0), (3, 1), (4, 0)]
    assert P.by_slices(df.limit(0), "key", 2).count() == 0


def test_slices_of_many_rows_are_several_tasks(spark):
    """The same slices, cut further where keys begin; partitions follow each other as keys do, and none has many rows."""
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randrange(200), i) for i in range(4000)] + [(None, -1)], "key bigint, row bigint").repartition(3)
    want = {r["key"]: r["slice"] for r in P.by_slices(df, "key", 3).collect()}
    got = P.by_slices(df, "key", 3, most=100).withColumn("at", F.spark_partition_id()).collect()
    assert len(got) == 4001 and all(r["slice"] == want[r["key"]] and r[P.PART] == r["at"] for r in got)
    in_order = sorted({(r["at"], r["key"]) for r in got if r["key"] is not None})
    assert [k for _, k in in_order] == sorted(want.keys() - {None})
    sizes = [sum(r["at"] == i for r in got) for i in range(max(r["at"] for r in got) + 1)]
    assert len(sizes) >= 36 and max(sizes) < 200
    assert P.by_slices(df.limit(0), "key", 3, most=100).count() == 0
