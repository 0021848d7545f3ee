"""Keyed permutations, exactly-once upload, flat graphs of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions import vectors as V
from ravelin.operators import partition as P
from ravelin.sources import text
from ravelin.streaming import ingest


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_permutations_are_bijections(spark):
    sizes = [*range(1, 40), 64, 99, 100, 101, 1000, 4097]
    places = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    moved = places.select("n", "i", V.permuted(F.col("i"), F.col("n"), F.lit(5)).alias("a"), V.permuted(F.col("i"), F.col("n"), F.lit(6)).alias("b"))
    of = {}
    for r in moved.collect():
        of.setdefault(r["n"], []).append((r["i"], r["a"], r["b"]))
    for n, rows in of.items():
        rows.sort()
        for k in (1, 2):
            assert sorted(r[k] for r in rows) == list(range(n))
        if n >= 100:  # scattered: few stay, neighbours part, keys differ
            assert sum(r[0] == r[1] for r in rows) < 8 and sum(r[1] == r[2] for r in rows) < 8
            assert sum(abs(x[1] - y[1]) == 1 for x, y in zip(rows, rows[1:], strict=False)) < 0.1 * n
            rising = sum(x[1] < y[1] for x, y in zip(rows, rows[1:], strict=False))
            assert 0.35 * n < rising < 0.65 * n
    big = spark.range(2000).select((F.col("id") * 10**14 + 7).alias("i")).select(V.permuted(F.col("i"), F.lit(3 * 10**17), F.lit(1)).alias("p"))
    assert big.where("p < 0 or p >= 300000000000000000").isEmpty() and big.distinct().count() == 2000


def test_rows_move_by_place_alone(spark):
    a = spark.createDataFrame([(k * k, f"a{k}") for k in range(500)], "id bigint, x string").repartition(3)
    b = spark.createDataFrame([(k - 90, f"b{k}") for k in range(500)], "id bigint, x string").repartition(5)
    one, other = ({r["position"]: r["x"] for r in P.shuffled(df, "id", 3, most=64).collect()} for df in (a, b))
    assert sorted(one) == list(range(500)) and all(one[p][1:] == other[p][1:] for p in one)
    assert [one[p] for p in range(500)] != [f"a{k}" for k in range(500)]
    dealt = P.shuffled(a, "id", 3, slices=4)
    assert dealt.rdd.getNumPartitions() == 4
    lies = [r["position"] for r in sorted(dealt.withColumn("n", F.monotonically_increasing_id()).collect(), key=lambda r: r["n"])]
    assert lies == list(range(500)) and P.shuffled(a.limit(0), "id", 3, slices=4).count() == 0


def test_batches_are_applied_once(spark, tmp_path):
    at = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), ingest.CHUNK)
    assert ingest.table(spark, at).count() == 0
    assert ingest.apply_batch(rows((1, [1], 0), (2, [2, 2], 1)), 0, at)
    assert not ingest.apply_batch(rows((9, [9], 0)), 0, at)
    assert ingest.apply_batch(rows((2, [3], 1), (None, [7], 1)), 1, at)  # an upsert
    assert rows_of(ingest.table(spark, at).select("row_id", "terms").where("row_id is not null")) == [(1, [1]), (2, [3])]
    # a batch that failed between its rows and its line is not there, and is written anew
    rows((5, [5], 2)).write.parquet(f"{at}/data/2")
    assert ingest.table(spark, at).count() == 3
    assert ingest.apply_batch(rows((6, [6], 2)), 2, at)
    assert sorted(r["row_id"] or 0 for r in ingest.table(spark, at).collect()) == [0, 1, 2, 6]
    assert ingest.apply_batch(rows(), 3, at) and ingest.table(spark, at).count() == 4
    assert ingest.apply_batch(rows((8, [8], 0), (9, [9], 3)), 4, at)  # anew
    assert rows_of(ingest.table(spark, at)) == [(8, [8], 0), (9, [9], 3)]


def test_streams_of_chunks(spark, tmp_path):
    source, at, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    send = lambda *r: spark.createDataFrame(list(r), ingest.CHUNK).write.mode("append").json(source)
    send((1, [1, 2], 0), (2, [3], 1))
    for _ in range(2):  # nothing new the second time
        ingest.upsert_chunks(spark, source, at, mark).awaitTermination()
        assert ingest.table(spark, at).count() == 2
    send((3, [4], 0))
    ingest.upsert_chunks(spark, source, at, mark).awaitTermination()
    assert rows_of(ingest.table(spark, at)) == [(3, [4], 0)]


def test_flat_graphs_in_splits(spark, tmp_path):
    """Numbers on lines of their own, in splits far smaller than a list: each belongs to the key before it, whatever split that is in."""
    rng = random.Random(5)
    want = []
    for part in range(2):
        flat = {}
        for i in range(40):
            n = 700 if i == 7 else rng.randrange(4)
            edges, weights = [rng.randrange(10**6) for _ in range(n)], [rng.randrange(1, 99) for _ in range(n)]
            flat |= {f"nid_{i}": 100 * part + i, f"nid_{i}_edges": edges, f"nid_{i}_weights": weights, f"nid_{i}_state": rng.choice([0, 2147483647])}
            want.append((100 * part + i, list(zip(edges, weights, strict=True)), flat[f"nid_{i}_state"]))
        (tmp_path / f"{part}.json").write_text(json.dumps(flat, indent=[2, None][0]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = text.read_flat_graph(spark, str(tmp_path))
        got = sorted((r["node_id"], [tuple(e) for e in r["edges"]], r["state"]) for r in read.collect())
        args = sorted(r["num_nodes"] for r in text.flat_graph_args(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(want) and args == [40, 40]
    assert rows_of(text.read_flat_graph(spark, str(tmp_path), pretty=False).select("node_id", "state")) == rows_of(read.select("node_id", "state"))


def test_compact_flat_graphs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nid_0": 4, "nid_0_edges": [1, 2], "nid_0_weights": [3, 4], "nid_0_state": 0}))
    assert [(r["node_id"], [tuple(e) for e in r["edges"]], r["state"]) for r in text.read_flat_graph(spark, str(tmp_path), pretty=False).collect()] == [(4, [(1, 3), (2, 4)], 0)]
    with pytest.raises(Exception, match="pretty=False"):
        text.read_flat_graph(spark, str(tmp_path)).collect()


def test_orders_of_short_vectors_are_worked_out_once(spark):
    """A table of them, by size; longer vectors, empty and null ones move as keyed_shuffle moves them."""
    rows = [(i, list(range(100, 100 + n))) for i, n in enumerate((0, 1, 2, 5, P.SHORT, P.SHORT + 1, 150))] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<int>")
    made = P.vector_orders(df, "v", 7).select("id", "v", V.permute(F.col("v"), F.col("order")).alias("a"), V.keyed_shuffle(F.col("v"), F.lit(7)).alias("b")).collect()
    assert len(made) == len(rows) and all(r["a"] == r["b"] and (r["v"] is None) == (r["a"] is None) and sorted(r["a"] or []) == (r["v"] or []) for r in made)
