"""Sources, sinks, vectors, jobs, privacy marks and the graph loop."""

import heapq
import json

import pytest
from pyspark.sql import functions as F

from ravelin import model, profile, shares
from ravelin.functions import vectors as V
from ravelin.operators import partition as P
from ravelin.plans import cooc, graph, jobs
from ravelin.sources import generators, tables, text
from ravelin.streaming import bsp, ingest


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def vector_rows(spark, vectors):
    return spark.createDataFrame([(i, t) for i, v in enumerate(vectors) for t in v], "row_id bigint, term bigint")


def test_cooccurrence_by_hand(spark):
    t = vector_rows(spark, [[1, 2, 2], [1, 3], [2]])
    want = [(1, 2, 2), (1, 3, 1), (2, 1, 1), (3, 1, 1)]
    assert rows_of(cooc.by_stripes(t)) == want == rows_of(cooc.by_pairs(t))
    assert rows_of(cooc.by_stripes(t, 2, pad=True)) == sorted(want + [(1, 0, 0), (2, 0, 0), (3, 0, 0)])
    cut = vector_rows(spark, [[5, 1, 9, 9]])
    assert rows_of(cooc.by_stripes(cut, 1, pad=True)) == [(1, 5, 1), (5, 1, 1), (9, 1, 1)]
    assert rows_of(cooc.by_stripes(vector_rows(spark, [[7, 7, 7], [0]]), 2, pad=True)) == [(7, 0, 0)]
    assert rows_of(cooc.by_stripes(vector_rows(spark, []))) == []


def test_wrapped_sums(spark):
    s = spark.createDataFrame([(1, [(2, 2**32 - 1)]), (1, [(2, 3)])], "key bigint, stripe array<struct<term:bigint,cnt:bigint>>")
    assert rows_of(cooc.reduce_stripes(s)) == [(1, 2, 2**32 + 2)]
    assert rows_of(cooc.reduce_stripes(s, wrap=True)) == [(1, 2, 2)]


def test_contiguous_slices(spark):
    sizes = lambda n, k: [sum(r["s"] == i for r in P.contiguous(spark.range(n), "id", k, "s").collect()) for i in range(k)]
    assert sizes(10, 4) == [2, 2, 2, 4]
    assert sizes(3, 4) == [0, 0, 0, 3]
    assert sizes(0, 2) == [0, 0]


def test_range_starts(spark):
    counts = spark.createDataFrame([(1, 4), (2, 1), (3, 1)], "key bigint, n bigint")
    assert rows_of(P.range_starts(counts, "key", "n", 3)) == [(0, 0), (1, 4), (2, 4)]
    one = spark.createDataFrame([(5, 9)], "key bigint, n bigint")
    assert rows_of(P.range_starts(one, "key", "n", 3)) == [(0, 0), (1, 9), (2, 9)]
    few = spark.createDataFrame([(1, 1), (2, 1)], "key bigint, n bigint")
    assert rows_of(P.range_starts(few, "key", "n", 6)) == [(0, 0)] + [(i, 1) for i in range(1, 6)]


def test_routing(spark):
    last = spark.createDataFrame([(0, 1), (1, 2)], "clique_idx int, last_node bigint")
    ids = spark.createDataFrame([(0,), (0,), (1,), (2,), (2,)], "node_id bigint")
    assert rows_of(P.route(ids, last).select("node_id", "clique_idx")) == [(0, 0), (0, 0), (1, 0), (2, 1), (2, 1)]


def test_vector_primitives(spark):
    one = spark.createDataFrame([([3, 1, 3, 2],)], "v array<bigint>")
    get = lambda c: one.select(c.alias("x")).first()["x"]
    v = F.col("v")
    order = V.argsort(v)
    assert get(order) == [1, 3, 0, 2]
    assert get(V.permute(v, order)) == [1, 2, 3, 3]
    assert get(V.iota(F.lit(0))) == [] and get(V.gather(v, F.array(F.lit(9)))) == [None]
    assert get(V.scatter(v, F.array(*[F.lit(0).cast("bigint")] * 4), F.array(F.lit(0), F.lit(1)), F.array(F.lit(3), F.lit(0)))) == [1, 0, 0, 3]
    assert get(V.cut(v, F.lit(1), F.lit(3))) == [1, 3] and get(V.cut(v, F.lit(3), F.lit(1))) == []
    assert get(V.run_starts(F.array().cast("array<bigint>"))) == [] and get(V.run_ends(F.array().cast("array<bigint>"))) == []
    assert [tuple(r) for r in get(V.run_lengths(F.array_sort(v)))] == [(1, 1), (2, 1), (3, 2)]
    assert sorted(get(V.keyed_shuffle(v, F.lit(5)))) == [1, 2, 3, 3] and get(V.keyed_shuffle(v, F.lit(5))) == get(V.keyed_shuffle(v, F.lit(5)))
    with pytest.raises(Exception, match="differ in size"):
        get(V.scatter(v, v, F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))))
    with pytest.raises(Exception, match="named twice"):
        get(V.scatter(v, v, F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(0))))


def dijkstra(nodes, edges, source):
    out, heap = dict.fromkeys(nodes, model.INF), [(0, source)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    out[source] = 0
    while heap:
        d, v = heapq.heappop(heap)
        if d > out[v]:
            continue
        for b, w in near.get(v, []):
            if d + w < out[b]:
                out[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return out


def test_shortest_distances(spark):
    nodes = spark.range(5).withColumnRenamed("id", "node_id")
    e = spark.createDataFrame([(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5)], "src bigint, dst bigint, w bigint")
    for frontier in (True, False):
        state, steps = graph.shortest_distances(nodes, e, 0, frontier=frontier)
        assert rows_of(state) == [(0, 0), (1, 3), (2, 1), (3, 8), (4, model.INF)] and steps == 5
    none, steps = graph.shortest_distances(nodes, e.limit(0), 0)
    assert rows_of(none)[1:] == [(i, model.INF) for i in range(1, 5)] and steps == 2
    with pytest.raises(RuntimeError):
        graph.shortest_distances(nodes, e, 0, max_supersteps=2)


def test_random_graph_against_dijkstra(spark):
    e = generators.graph(spark, 60, 200, seed=4)
    state, _ = graph.shortest_distances(spark.range(60).withColumnRenamed("id", "node_id"), e, 7)
    assert dict(rows_of(state)) == dijkstra(range(60), rows_of(e), 7)


def test_votes_need_every_state(spark):
    updated = spark.createDataFrame([(0, 0, False), (1, 5, True), (2, 5, False)], "node_id bigint, state bigint, changed boolean")
    slices = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node_id bigint, clique_idx int")
    assert rows_of(bsp.votes(updated, slices)) == [(0, False), (1, True)]


def test_text_and_json_forms(spark, tmp_path):
    (tmp_path / "v.txt").write_text("7,3,7,12\n1\n")
    assert [r["terms"] for r in text.read_vectors(spark, str(tmp_path / "v.txt")).collect()] == [[7, 3, 7, 12], [1]]
    (tmp_path / "bad.txt").write_text("7,3\n\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_vectors(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "g.txt").write_text("0:1|4,2|1\n1:\n2:1|2\n")
    g = text.read_graph(spark, str(tmp_path / "g.txt"))
    assert rows_of(graph.edges_of(g)) == [(0, 1, 4), (0, 2, 1), (2, 1, 2)] and g.count() == 3
    text.write_chunks(text.with_state(g, 0), "node_id", 2, str(tmp_path / "chunks"))
    back = text.read_graph_chunks(spark, str(tmp_path / "chunks"))
    assert rows_of(back.select("node_id", "state", "part")) == [(0, 0, 0), (1, model.INF, 1), (2, model.INF, 1)]
    flat = {"nid_0": 4, "nid_0_edges": [5], "nid_0_weights": [7], "nid_0_state": 0, "nid_1": 5, "nid_1_edges": [], "nid_1_weights": [], "nid_1_state": model.INF}
    (tmp_path / "flat.json").write_text(json.dumps(flat, indent=2))
    read = text.read_flat_graph(spark, str(tmp_path / "flat.json"))
    assert rows_of(read.select("node_id", "state")) == [(4, 0), (5, model.INF)] and rows_of(graph.edges_of(read)) == [(4, 5, 7)]
    text.write_csv(back.select("node_id", "state"), str(tmp_path / "csv"))
    assert rows_of(text.read_csv(spark, str(tmp_path / "csv"), "node_id bigint, state bigint")) == [(0, 0), (1, model.INF), (2, model.INF)]
    zeros = spark.createDataFrame([([0, 1, 0],)], "terms array<bigint>")
    assert text.without_padding(zeros).first()["terms"] == [1]


def test_tables(spark):
    rows = spark.createDataFrame([(1, [1, 2])], "row_id bigint, terms array<bigint>")
    tables.upload_vectors(rows, "vec", overwrite=True)
    tables.upload_vectors(rows, "vec", overwrite=False)
    assert tables.counts(spark, "vec") == (2, 2) and tables.column(spark, "vec", 1).columns == ["terms"]
    tables.upload_vectors(rows, "vec", overwrite=True)
    assert tables.counts(spark, "vec") == (1, 2)
    tables.create_graph(spark, "st", "gr")
    bad = spark.createDataFrame([(1, [1, 2], [3], 0)], "node_id bigint, edges array<bigint>, weights array<bigint>, state bigint")
    with pytest.raises(Exception, match="differ in size"):
        tables.upload_graph(bad, "st", "gr")
    for t in ("vec", "st", "gr"):
        tables.delete(spark, t)
        assert not tables.exists(spark, t)


def test_generators(spark):
    v = generators.vectors(spark, 50, 2, 5, seed=3).collect()
    assert all(2 <= len(r["terms"]) <= 5 and all(1 <= t <= 128 for t in r["terms"]) for r in v)
    assert generators.vectors(spark, 50, 2, 5, seed=3).collect() == v


def test_jobs(spark):
    engine = jobs.Engine(spark, max_parallelism=3)
    engine.register("part", lambda s, base, i: {f"r{i}": s.range(base + i).count(), "last": i}, "multi")
    engine.register("one", lambda s: None)
    assert engine.run("part", {"base": 5}, 3, ("i", [0, 1, 2])) == {"r0": 5, "r1": 6, "r2": 7, "last": 2}
    assert engine.run("one") == {}
    with pytest.raises(jobs.AdmissionError):
        engine.run("part", {"base": 1}, 4, ("i", [0, 1, 2, 3]))
    with pytest.raises(ValueError):
        engine.run("one", parallelism=2)
    engine.load({"loaded": {"function": "builtins:dict", "kind": "single"}})
    assert engine.programs["loaded"].run is dict


def test_privacy_marks(spark):
    df = model.classify(spark.range(3).withColumn("x", F.col("id") + 1), ["x"])
    assert model.private_columns(df.select("x")) == ["x"]
    total = model.carry(df, df.agg(F.sum("x").alias("total")), {"total": ["x"]})
    with pytest.raises(ValueError):
        model.publish(total, "total")
    audit = model.Audit()
    open_ = model.declassify(total, ["total"], "result", audit)
    assert model.publish(open_, "total") == {"total": 6} and audit.entries == [(("total",), "result")]
    with pytest.raises(ValueError):
        model.declassify(open_, ["total"], "again", audit)


def test_shares(spark):
    df = spark.createDataFrame([(i, i * 77, 2**32 - 1 - i) for i in range(20)], "id bigint, a bigint, b bigint")
    both = shares.share(shares.share(df, "a", ["id"]), "b", ["id"], seed=5)
    got = both.select("id", *shares.add("a", "b", "c")).select("id", shares.reconstruct("c").alias("c"))
    assert rows_of(got) == [(i, (i * 77 + 2**32 - 1 - i) % 2**32) for i in range(20)]


def test_profile(spark):
    with profile.section("count", 3):
        df, seen = profile.counted(spark.range(7), "rows-seen")
        df.collect()
    assert seen.get["rows"] == 7 and profile.SECTIONS[-1][:2] == ("count", 3)


def test_incremental_upload(spark, tmp_path):
    source, to, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([(1, [1, 2])], "row_id bigint, terms array<bigint>")
    for n in (1, 2):
        rows.write.mode("append").json(source)
        ingest.append_chunks(spark, source, to, mark).awaitTermination()
        assert spark.read.parquet(to).count() == n


def test_ranges_follow_the_keys(spark):
    """One outlier, null keys and keys that span all 64 bits: every row comes back, numbered in order, and no range holds most of them."""
    keys = [*range(1000), 2**62, -(2**63), 2**63 - 1, None, None]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint").repartition(3)
    got = rows_of_numbers(P.row_numbers(df, "id"))
    assert sorted(n for _, n in got) == list(range(1, len(keys) + 1))
    assert [k for k, _ in got if k is not None] == sorted(k for k in keys if k is not None)
    ranged, rows, _ = P._ranged(df, "id", 30)
    assert rows == len(keys) and max(r["count"] for r in ranged.groupBy("__range").count().collect()) <= 40
    assert P.row_numbers(df.limit(0), "id").count() == 0
    assert sum(r["s"] == 3 for r in P.contiguous(df, "id", 4, "s").collect()) == 1005 - 3 * 251


def rows_of_numbers(df):
    return sorted(((r["id"], r["row_number"]) for r in df.collect()), key=lambda r: r[1])


def test_routing_without_owner(spark):
    last = spark.createDataFrame([(i, 10 * i + 9) for i in range(200)], "clique_idx int, last_node bigint")
    ids = spark.createDataFrame([(0,), (9,), (10,), (1999,), (2000,), (None,)], "node_id bigint")
    got = {r["node_id"]: r["clique_idx"] for r in P.route(ids, last).collect()}
    assert got == {0: 0, 9: 0, 10: 1, 1999: 199, 2000: None, None: None}


def test_flat_graph_of_several_parts(spark, tmp_path):
    """Every part numbers its vertices from 0 again."""
    for part, ids in enumerate(([10, 11], [20, 21])):
        flat = {}
        for i, n in enumerate(ids):
            flat |= {f"nid_{i}": n, f"nid_{i}_edges": [n + 1, n + 2][: i + 1], f"nid_{i}_weights": [5, 6][: i + 1], f"nid_{i}_state": part}
        (tmp_path / f"{part}.json").write_text(json.dumps(flat, indent=2))
    read = text.read_flat_graph(spark, str(tmp_path))
    assert rows_of(read.select("node_id", "state")) == [(10, 0), (11, 0), (20, 1), (21, 1)]
    assert rows_of(graph.edges_of(read)) == [(10, 11, 5), (11, 12, 5), (11, 13, 6), (20, 21, 5), (21, 22, 5), (21, 23, 6)]
    text.write_flat_graph(read, 2, str(tmp_path / "out"))
    found = [json.loads(p.read_text()) for p in sorted((tmp_path / "out").glob("part=*/part-*"))]
    assert [f["nid_1"] for f in found] == [11, 21] and found[1]["nid_1_edges"] == [22, 23] and len(found[0]) == 8


def test_numbered_lines(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i},{j}\n" for j in range(40 * i + 1)))
    got = rows_of(text.numbered_vectors(spark, str(tmp_path)).select("row_id", F.col("terms")[0].alias("a"), F.col("terms")[1].alias("b")))
    assert got == [(n, *t) for n, t in enumerate((i, j) for i in range(3) for j in range(40 * i + 1))]


def test_scatter_is_linear(spark):
    import time

    n = 20_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("bigint")).alias("v")).cache()
    turned = F.transform("v", lambda i: F.lit(n - 1) - i)
    began = time.time()
    out = df.select(V.scatter(F.col("v"), V.fill(F.lit(-1).cast("bigint"), F.lit(n)), F.col("v"), turned).alias("x")).first()["x"]
    assert out == list(range(n - 1, -1, -1)) and time.time() - began < 20


def test_exact_random_graphs(spark):
    for n, m in ((30, 0), (30, 100), (30, 500), (30, 870)):
        made = generators.graph(spark, n, m, seed=2).collect()
        assert len({(r["src"], r["dst"]) for r in made}) == len(made) == m and all(r["src"] != r["dst"] for r in made)
    with pytest.raises(ValueError):
        generators.graph(spark, 3, 7)


def test_registry_from_text_and_types(spark, monkeypatch):
    engine = jobs.Engine(spark, max_parallelism=2)
    engine.load("a:\n  function: builtins:dict\n  kind: single\n")
    assert engine.programs["a"].run is dict
    monkeypatch.setitem(__import__("sys").modules, "yaml", None)  # without the library
    assert jobs._parsed("# programs\na:\n  function: builtins:dict\n  arguments:\n    x: int\nb:\n  kind: 'multi'\n") == {"a": {"function": "builtins:dict", "arguments": {"x": "int"}}, "b": {"kind": "multi"}}
    engine.register("typed", lambda s, x: {"y": x}, "single", {"x": "int"}, {"y": "int"})
    assert engine.run("typed", {"x": 3}) == {"y": 3}
    for bad in ({"x": "3"}, {"x": True}, {}, {"x": 1, "z": 2}):
        with pytest.raises(TypeError):
            engine.run("typed", bad)
    engine.register("liar", lambda s: {"y": "no"}, "single", {}, {"y": "int"})
    with pytest.raises(TypeError):
        engine.run("liar")
    with pytest.raises(ValueError):
        engine.register("odd", dict, "single", {"x": "matrix"})


def test_bad_graph_rows_leave_the_tables_alone(spark):
    tables.create_graph(spark, "st2", "gr2")
    rows = spark.createDataFrame([(1, [1], [3], 0), (2, [1, 2], [3], 0)], "node_id bigint, edges array<bigint>, weights array<bigint>, state bigint")
    with pytest.raises(ValueError, match="differ in size at 2"):
        tables.upload_graph(rows, "st2", "gr2")
    assert tables.counts(spark, "st2")[0] == tables.counts(spark, "gr2")[0] == 0
    for t in ("st2", "gr2"):
        tables.delete(spark, t)


def test_entry_without_the_text_operators(tmp_path):
    """A missing library behind the text operators costs their queries only."""
    import subprocess
    import sys

    from conftest import ROOT

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'cooc' in q and set(q) == set(e.oracle_sql()), q"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
