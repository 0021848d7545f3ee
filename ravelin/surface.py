"""Queries that go through the sources, sinks, tables, jobs and marks of the engine, each with its SQL.

They write the supplied tables out in one of the engine's forms, into a folder of their own in
the shared one or a table of a name of their own, and read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model, profile
from . import queries as Q
from .functions import vectors as V
from .operators import partition as P
from .plans import cooc as C
from .plans import graph as G
from .plans import jobs
from .session import scratch_folder, scratch_table
from .sources import generators, tables, text
from .streaming import ingest

K = Q.K


def _folder(spark: SparkSession) -> str:
    return scratch_folder(spark, "surface")


def _vectors(spark, sf_dir) -> DataFrame:
    return Q.vectors(spark, sf_dir).withColumnRenamed("v", "terms")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.posexplode("terms").alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def _graph(spark, sf_dir) -> DataFrame:
    return G.adjacency(Q.vertices(spark, sf_dir), Q.edges(spark, sf_dir))


def _edges(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("node_id", F.explode_outer("edges").alias("e"), *more).select("node_id", "e.dst", "e.w", *more)


def source_vectors(spark, sf_dir):
    """Text lines, one a row, and back: rows are told by their line."""
    at = _folder(spark)
    text.write_vectors(_vectors(spark, sf_dir), at)
    return _flat(text.numbered_vectors(spark, at))


def source_graph(spark, sf_dir):
    at = _folder(spark)
    text.write_graph(_graph(spark, sf_dir), at)
    return _edges(text.read_graph(spark, at))


def _chunks(spark, sf_dir) -> DataFrame:
    at = _folder(spark)
    text.write_chunks(_vectors(spark, sf_dir), "row_id", K, at)
    return text.read_vector_chunks(spark, at)


def sink_vector_chunks(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    return rows.select("row_id", "part", F.posexplode("terms").alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def vector_chunk_args(spark, sf_dir):
    return text.chunk_args(_chunks(spark, sf_dir))


def sink_graph_chunks(spark, sf_dir):
    at = _folder(spark)
    text.write_chunks(text.with_state(_graph(spark, sf_dir), 0), "node_id", K, at)
    return _edges(text.read_graph_chunks(spark, at), "state", "part")


def _flat_folder(spark, sf_dir) -> str:
    at = _folder(spark)
    text.write_flat_graph(text.with_state(_graph(spark, sf_dir), 0), K, at)
    return at


def sink_flat_graph(spark, sf_dir):
    """Several objects, each with numbers from 0, and back."""
    return _edges(text.read_flat_graph(spark, _flat_folder(spark, sf_dir)), "state")


def flat_graph_args(spark, sf_dir):
    args = text.flat_graph_args(spark, _flat_folder(spark, sf_dir))
    return args.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), "num_nodes")


def upload_vectors(spark, sf_dir):
    """Text to chunks to a table: the first chunk starts it anew, the others are appended."""
    name, chunks = scratch_table(spark), P.once(_chunks(spark, sf_dir))
    tables.upload_vectors(spark.createDataFrame([(-1, [1])], model.VECTORS), name, overwrite=True)  # is gone after the first chunk
    for part, _, overwrite in sorted(tuple(r) for r in text.chunk_args(chunks).collect()):
        tables.upload_vectors(chunks.where(F.col("part") == part), name, overwrite)
    return _flat(spark.table(name))


def upload_cooc(spark, sf_dir):
    """Co-occurrence all the way: text, numbered lines, chunks, table, pairs."""
    at, name = _folder(spark), scratch_table(spark)
    text.write_vectors(_vectors(spark, sf_dir), at)
    text.write_chunks(text.without_padding(text.numbered_vectors(spark, at)), "row_id", K, f"{at}-chunks")
    tables.upload_vectors(text.read_vector_chunks(spark, f"{at}-chunks"), name, overwrite=True)
    return C.by_stripes(spark.table(name).select("row_id", F.explode("terms").alias("term")))


def upload_stream(spark, sf_dir):
    """Chunks that arrive one after the other, each appended once."""
    at = _folder(spark)
    for i, rows in enumerate(_halves(_vectors(spark, sf_dir))):
        rows.write.mode("append").json(f"{at}/in/{i}")
        ingest.append_chunks(spark, f"{at}/in/*", f"{at}/table", f"{at}/mark").awaitTermination()
    return _flat(spark.read.schema(model.VECTORS).parquet(f"{at}/table"))


def _halves(rows: DataFrame) -> list[DataFrame]:
    return [rows.where(F.col("row_id") % 2 == i) for i in (0, 1)]


def upload_replayed(spark, sf_dir):
    """Chunks as a stream: 0 and 1, 0 again, the others, the batch of these once more, and 3 once more. What is left has no chunk 1 and no row twice."""
    at, chunks = _folder(spark), P.once(_chunks(spark, sf_dir))
    for no, parts in enumerate(([0, 1], [0], list(range(2, K)), [3])):
        sent = chunks.where(F.col("part").isin(parts))
        sent.write.json(f"{at}/in/{no}")
        ingest.upsert_chunks(spark, f"{at}/in/*", f"{at}/table", f"{at}/mark").awaitTermination()
        ingest.apply_batch(chunks.withColumn("terms", F.array(F.lit(-1).cast("bigint"))), no, f"{at}/table")  # that batch has been
    rows = ingest.table(spark, f"{at}/table")
    return rows.select("row_id", "part", F.posexplode("terms").alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def create_tables(spark, sf_dir):
    state, graph = scratch_table(spark), scratch_table(spark)
    tables.create_graph(spark, state, graph)
    tables.upload_graph(spark.createDataFrame([(1, [2], [3], 0)], "node_id bigint, edges array<bigint>, weights array<bigint>, state bigint"), state, graph)
    tables.create_graph(spark, state, graph)  # anew: empty again
    found = [(n, *tables.counts(spark, t)) for n, t in (("graph", graph), ("state", state))]
    return spark.createDataFrame(found, "name string, n_rows bigint, n_columns bigint")


def preupload(spark, sf_dir):
    state, graph = scratch_table(spark), scratch_table(spark)
    tables.create_graph(spark, state, graph)
    rows = text.with_state(_graph(spark, sf_dir), 0).select("node_id", F.transform("edges", lambda e: e["dst"]).alias("edges"), F.transform("edges", lambda e: e["w"]).alias("weights"), "state")
    for half in (rows.where("node_id % 2 = 0"), rows.where("node_id % 2 = 1")):
        tables.upload_graph(half, state, graph)
    made = spark.table(graph).select("node_id", G.checked().alias("edges")).join(spark.table(state), "node_id")
    return _edges(made, "state")


def column_by_ordinal(spark, sf_dir):
    name = scratch_table(spark)
    tables.upload_vectors(_vectors(spark, sf_dir), name, overwrite=True)
    return tables.column(spark, name, 1).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def insert_rows(spark, sf_dir):
    """Batches of rows appended one after the other."""
    name, nodes = scratch_table(spark), Q.sssd_init(spark, sf_dir)
    tables.create(spark, name, model.STATE)
    for i in range(3):
        tables.append(nodes.where(F.col("node_id") % 3 == i), name)
    return spark.table(name)


def insert_columns(spark, sf_dir):
    """Whole columns put together by key."""
    name, nodes = scratch_table(spark), Q.sssd_init(spark, sf_dir)
    tables.create(spark, name, model.STATE)
    tables.append_columns(spark, name, {"node_id": nodes.select("node_id"), "state": nodes.select("node_id", "state")}, "node_id")
    return spark.table(name)


def catalog(spark, sf_dir):
    name = scratch_table(spark)
    seen = [("before", tables.exists(spark, name))]
    tables.create(spark, name, model.STATE)
    seen.append(("created", tables.exists(spark, name)))
    tables.delete(spark, name)
    seen.append(("deleted", tables.exists(spark, name)))
    return spark.createDataFrame(seen, "step string, there boolean")


def table_counts(spark, sf_dir):
    name = scratch_table(spark)
    tables.upload_vectors(_vectors(spark, sf_dir), name, overwrite=True)
    return spark.createDataFrame([tables.counts(spark, name)], "n_rows bigint, n_columns bigint")


def csv_round(spark, sf_dir):
    at = _folder(spark)
    text.write_csv(Q.cooc(spark, sf_dir), at)
    return text.read_csv(spark, at, "left bigint, right bigint, cnt bigint")


def random_vectors(spark, sf_dir):
    made = generators.vectors(spark, 500, 2, 9, seed=5)
    ok = F.size("terms").between(2, 9) & F.forall("terms", lambda t: t.between(1, 128))
    sizes = F.countDistinct(F.size("terms"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("bigint")).alias("n_sound"), sizes.alias("n_sizes"))


def random_graph(spark, sf_dir):
    """G(n, m): m edges, neither more nor fewer, sparse and dense."""
    out = None
    for n, m in ((50, 300), (20, 370), (2, 2), (9, 0)):
        made = generators.graph(spark, n, m, seed=3)
        ok = (F.col("src") != F.col("dst")) & F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1) & F.col("w").between(1, 128)
        found = made.agg(F.lit(n).alias("nodes"), F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src", "dst").alias("n_distinct"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("n_sound"))
        out = found if out is None else out.unionByName(found)
    return out


def padding_filter(spark, sf_dir):
    return C.without_padding(Q.cooc_padded(spark, sf_dir))


def asserted(spark, sf_dir):
    """Lists of the same size are zipped; of those that aren't, the error says so."""
    rows = _graph(spark, sf_dir).select("node_id", F.transform("edges", lambda e: e["dst"]).alias("edges"), F.transform("edges", lambda e: e["w"]).alias("weights"))
    try:
        rows.withColumn("weights", F.concat("weights", F.array(F.lit(1).cast("bigint")))).select(G.checked().alias("edges")).write.format("noop").mode("overwrite").save()
        raised = False
    except Exception as e:
        raised = "edges and weights differ" in str(e)
    return _edges(rows.select("node_id", G.checked().alias("edges"))).withColumn("raised", F.lit(raised))


def permutation(spark, sf_dir):
    """One order applied to two vectors: terms by descending value, and their places alike."""
    v = Q.vectors(spark, sf_dir).select("row_id", "v", V.argsort(F.transform("v", lambda x: -x)).alias("order"))
    both = v.select("row_id", V.permute(F.col("v"), F.col("order")).alias("a"), V.permute(V.iota(F.size("v")), F.col("order")).alias("b"))
    pairs = F.zip_with("a", "b", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return both.select("row_id", F.posexplode(pairs).alias("pos", "p")).select("row_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.x").alias("term"), F.col("p.i").cast("bigint").alias("came_from"))


def keyed_shuffle(spark, sf_dir):
    """Two tables of a size in an order that depends on the seed alone: what lies at each place, and whether both moved there from one place."""
    nodes = Q.vertices(spark, sf_dir)
    other = nodes.select((F.col("node_id") * 3 + 5).alias("other"))
    moved = P.shuffled(nodes, "node_id", 17)
    return moved.join(P.shuffled(other, "other", 17), "position").select("position", "node_id", "other")


def vector_shuffle(spark, sf_dir):
    """Two vectors shuffled under one key move alike."""
    v = P.vector_orders(Q.vectors(spark, sf_dir), "v", 7)
    pairs = F.zip_with(V.permute(F.col("v"), F.col("order")), V.permute(V.iota(F.size("v")), F.col("order")), lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i")))
    moved = v.select("row_id", F.posexplode(pairs).alias("pos", "p"))
    return moved.select("row_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.x").alias("term"), F.col("p.i").alias("came_from"))


def union_tables(spark, sf_dir):
    """Tables of the workers put together again."""
    split = Q.graph_split(spark, sf_dir)
    return P.union(*(split.where(F.col("clique_idx") == i).select("node_id") for i in range(K)))


def row_numbers(spark, sf_dir):
    return P.row_numbers(Q.vertices(spark, sf_dir), "node_id")


def range_sorted(spark, sf_dir):
    """Rows dealt by key ranges and sorted: no key in two partitions, none out of order."""
    dealt = P.by_range(Q.row_distinct(spark, sf_dir).select("term"), "term", K).select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"))
    kept = P.once(dealt)
    spread = kept.groupBy("term").agg(F.countDistinct("part").alias("parts"))
    order = kept.groupBy("part").agg(F.min(F.struct("n", "term")).alias("a"), F.max(F.struct("n", "term")).alias("b"), F.min("term").alias("least"), F.max("term").alias("most"))
    ordered = order.agg(F.min((F.col("a.term") == F.col("least")) & (F.col("b.term") == F.col("most"))).alias("ordered"))
    return kept.agg(F.count(F.lit(1)).alias("n")).crossJoin(spread.agg(F.max("parts").alias("parts"))).crossJoin(ordered)  # one row each


_REGISTRY = """
count_part:
  function: ravelin.surface:_count_part
  kind: multi
  arguments: {sf_dir: string, part: int}
  results: {rows: int, last: int}
"""


def _count_part(spark, sf_dir, part):
    return {"rows": Q.vertices(spark, sf_dir).where(F.col("node_id") % 3 == part).count(), "last": part}


def _named_part(spark, sf_dir, part):
    return {f"rows_{part}": Q.vertices(spark, sf_dir).where(F.col("node_id") % 3 == part).count(), "last": part}


def merged_results(spark, sf_dir):
    """Three tasks of one program; of the results of one name the last task's counts."""
    engine = jobs.Engine(spark, max_parallelism=3)
    engine.register("named", _named_part, "multi", {"sf_dir": "string", "part": "int"})
    made = engine.run("named", {"sf_dir": sf_dir}, 3, ("part", [0, 1, 2]))
    return spark.createDataFrame(sorted(made.items()), "name string, value bigint")


def registry(spark, sf_dir):
    """A program from YAML, run by name; what is asked beyond the limit, or with a wrong argument, is refused."""
    engine = jobs.Engine(spark, max_parallelism=2)
    engine.load(_REGISTRY)
    out = [("rows", engine.run("count_part", {"sf_dir": sf_dir, "part": 1})["rows"])]
    for name, arguments, n, error in (("refused", {"sf_dir": sf_dir, "part": 1}, 3, jobs.AdmissionError), ("mistyped", {"sf_dir": sf_dir, "part": "1"}, 1, TypeError), ("missing", {"sf_dir": sf_dir}, 1, TypeError)):
        try:
            engine.run("count_part", arguments, n)
            out.append((name, 0))
        except error:
            out.append((name, 1))
    return spark.createDataFrame(out, "name string, value bigint")


def disclosed(spark, sf_dir):
    """A private column summed, declassified on the record, and published."""
    rows = model.classify(Q.terms(spark, sf_dir), ["term"])
    total = model.carry(rows, rows.agg(F.sum("term").alias("total")), {"total": ["term"]})
    try:
        model.publish(total, "total")
        kept = 0
    except ValueError:
        kept = 1
    audit = model.Audit()
    value = model.publish(model.declassify(total, ["total"], "result", audit), "total")["total"]
    return spark.createDataFrame([(value, kept, len(audit.entries))], "total bigint, refused int, disclosures int")


def profiled(spark, sf_dir):
    """The sections of a run in phases and of a graph run: what each counted, and that it ran tasks, for some time, and moved bytes where it should."""
    profile.SECTIONS.clear()
    with profile.section("upload") as made:
        made.seen(Q.terms(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    C.by_stripes(Q.terms(spark, sf_dir), Q.L, partitions=Q.R, phases=True)
    G.shortest_distances(Q.vertices(spark, sf_dir), Q.edges(spark, sf_dir), 0)
    seen = [s for s in profile.SECTIONS if s.name != "superstep" or s.n == 2]
    moved = {"map", "partition", "reduce", "superstep"}
    named = [(s.name, s.n, s.rows, bool(s.jobs and s.tasks and s.task_seconds > 0 and s.seconds > 0 and (s.name not in moved or s.shuffle_written > 0))) for s in seen]
    return spark.createDataFrame(named, "section string, n int, n_rows bigint, ran boolean")


QUERIES = {
    f.__name__: f
    for f in (
        source_vectors, source_graph, sink_vector_chunks, vector_chunk_args, sink_graph_chunks, sink_flat_graph, flat_graph_args,
        upload_vectors, upload_cooc, upload_stream, upload_replayed, create_tables, preupload, column_by_ordinal, insert_rows, insert_columns, catalog, table_counts,
        csv_round, random_vectors, random_graph, padding_filter, asserted, permutation, keyed_shuffle, vector_shuffle, union_tables, row_numbers,
        range_sorted, merged_results, registry, disclosed, profiled,
    )
}

_ADJACENCY = f"WITH {Q._EDGES}"
_PART = "CAST(least(CASE WHEN n // 6 = 0 THEN 5 ELSE (rn - 1) // (n // 6) END, 5) AS INTEGER)"
_STATES = f"{_ADJACENCY}, graph AS (SELECT node_id, dst, w, state FROM s1 LEFT JOIN edges ON src = node_id)"



def _moved(rows: str, key: int) -> str:
    """CTEs (moved): where place x of 0 .. n - 1 goes, of rows(k, x, n), by the half-rounds of vectors.permuted; k names the rows that move together."""
    rounds = ", ".join(f"({i}, {(key % V.PRIME * a + b) % V.PRIME}, {c})" for i, (a, b, c) in enumerate(V.ROUNDS))
    half = f"(((r + add) % {V.PRIME}) * ((r + add) % {V.PRIME}) % {V.PRIME} * times % {V.PRIME})"
    return f"""half_rounds(i, add, times) AS (VALUES {rounds}),
domain AS (SELECT k, x, n, h, (n + h - 1) // h AS w FROM (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) + 1 AS h FROM ({rows}))),
walk(k, x, n, h, w, i, l, r) AS (
  SELECT k, x, n, h, w, 0, x // w, x % w FROM domain
  UNION ALL SELECT k, x, n, h, w, i + 1, l, r FROM (
    SELECT k, x, n, h, w, walk.i, r AS l, (l + {half}) % CASE WHEN walk.i % 2 = 0 THEN h ELSE w END AS r FROM walk JOIN half_rounds q ON q.i = walk.i % {len(V.ROUNDS)}
    WHERE walk.i = 0 OR walk.i % {len(V.ROUNDS)} > 0 OR l * w + r >= n)),
moved AS (SELECT k, x, l * w + r AS place FROM walk WHERE i > 0 AND i % {len(V.ROUNDS)} = 0 AND l * w + r < n)"""


_MOVED_NODES = _moved("SELECT 0 AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS x, count(*) OVER () AS n FROM part", 17)
_MOVED_TERMS = _moved("SELECT row_id AS k, pos AS x, n FROM sv", 7)

ORACLES = {
    "source_vectors": f"WITH {Q._TV}, ids AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS line FROM (SELECT DISTINCT row_id FROM tv)) SELECT line AS row_id, pos, term FROM sv JOIN ids USING (row_id)",
    "source_graph": f"{_ADJACENCY} SELECT node_id, dst, w FROM s1 LEFT JOIN edges ON src = node_id",
    "sink_vector_chunks": f"WITH {Q._TV}, {Q._ROWS} SELECT sv.row_id, slice AS part, pos, term FROM sv JOIN split USING (row_id)",
    "vector_chunk_args": f"WITH {Q._ROWS} SELECT slice AS part, count(*) AS num_entries, slice = 0 AS overwrite FROM split GROUP BY ALL",
    "sink_graph_chunks": f"{_STATES}, {Q._NODES} SELECT graph.*, clique_idx AS part FROM graph JOIN nodes USING (node_id)",
    "sink_flat_graph": f"{_STATES} SELECT * FROM graph",
    "flat_graph_args": f"WITH {Q._NODES} SELECT clique_idx AS part, count(*) AS num_nodes FROM nodes GROUP BY ALL",
    "upload_vectors": f"WITH {Q._TV} SELECT row_id, pos, term FROM sv",
    "upload_cooc": Q.ORACLES["cooc"],
    "upload_stream": f"WITH {Q._TV} SELECT row_id, pos, term FROM sv",
    "upload_replayed": f"WITH {Q._TV}, {Q._ROWS} SELECT sv.row_id, slice AS part, pos, term FROM sv JOIN split USING (row_id) WHERE slice <> 1",
    "create_tables": "SELECT * FROM (VALUES ('graph', CAST(0 AS BIGINT), CAST(3 AS BIGINT)), ('state', 0, 2)) t(name, n_rows, n_columns)",
    "preupload": f"{_STATES} SELECT * FROM graph",
    "column_by_ordinal": f"WITH {Q._TV} SELECT term, count(*) AS n FROM tv GROUP BY ALL",
    "insert_rows": f"{_ADJACENCY} SELECT * FROM s1",
    "insert_columns": f"{_ADJACENCY} SELECT * FROM s1",
    "catalog": "SELECT * FROM (VALUES ('before', false), ('created', true), ('deleted', false)) t(step, there)",
    "table_counts": f"WITH {Q._TV} SELECT count(DISTINCT row_id) AS n_rows, CAST(2 AS BIGINT) AS n_columns FROM tv",
    "csv_round": Q.ORACLES["cooc"],
    "random_vectors": "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS n_sound, CAST(8 AS BIGINT) AS n_sizes",
    "random_graph": "SELECT CAST(n AS INTEGER) AS nodes, CAST(m AS BIGINT) AS n_edges, CAST(m AS BIGINT) AS n_distinct, CAST(m AS BIGINT) AS n_sound FROM (VALUES (50, 300), (20, 370), (2, 2), (9, 0)) t(n, m)",
    "padding_filter": f"WITH {Q._CUT} SELECT key AS \"left\", term AS \"right\", CAST(sum(cnt) AS BIGINT) AS cnt FROM cut GROUP BY ALL",
    "asserted": f"{_ADJACENCY} SELECT node_id, dst, w, true AS raised FROM s1 LEFT JOIN edges ON src = node_id",
    "permutation": f"WITH {Q._TV} SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY term DESC, pos) - 1 AS pos, term, pos AS came_from FROM sv",
    "keyed_shuffle": f"WITH RECURSIVE {_MOVED_NODES}, node AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, row_number() OVER (ORDER BY p_partkey) - 1 AS x FROM part) SELECT place AS position, node_id, node_id * 3 + 5 AS other FROM moved JOIN node USING (x)",
    "vector_shuffle": f"WITH RECURSIVE {Q._TV}, {_MOVED_TERMS} SELECT row_id, place AS pos, term, pos AS came_from FROM sv JOIN moved ON k = row_id AND x = pos",
    "union_tables": f"WITH {Q._NODES} SELECT * FROM nodes",
    "row_numbers": "SELECT CAST(p_partkey AS BIGINT) AS node_id, row_number() OVER (ORDER BY p_partkey) AS row_number FROM part",
    "range_sorted": f"WITH {Q._TV} SELECT count(*) AS n, CAST(1 AS BIGINT) AS parts, true AS ordered FROM (SELECT DISTINCT row_id, term FROM tv)",
    "merged_results": "SELECT 'rows_' || p AS name, count(*) AS value FROM (SELECT p_partkey % 3 AS p FROM part) GROUP BY ALL UNION ALL SELECT 'last', 2",
    "registry": "SELECT 'rows' AS name, count(*) AS value FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT * FROM (VALUES ('refused', 1), ('mistyped', 1), ('missing', 1)) t(name, value)",
    "disclosed": f"WITH {Q._TV} SELECT CAST(sum(term) AS BIGINT) AS total, 1 AS refused, 1 AS disclosures FROM tv",
    "profiled": f"WITH {Q._CUT}, sums AS (SELECT key, term FROM cut GROUP BY ALL), keys AS (SELECT DISTINCT row_id, term FROM rc) SELECT 'upload' AS section, 1 AS n, count(*) AS n_rows, true AS ran FROM tv UNION ALL SELECT 'map', 1, count(*), true FROM keys UNION ALL SELECT 'partition', 6, count(*), true FROM keys UNION ALL SELECT 'reduce', 6, count(*), true FROM sums UNION ALL SELECT 'superstep', 2, (SELECT count(*) FROM part), true",
}
