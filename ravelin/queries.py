"""The engine's queries over the supplied tables, each with its SQL.

Term vectors: lineitem rows, row l_orderkey, term l_suppkey + 1 (0 is padding). Graph:
vertices part, source 0, edges between consecutive returned parts of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shares
from .functions import vectors as V
from .model import INF
from .operators import partition as P
from .plans import cooc as C
from .plans import graph as G
from .streaming import bsp

#: Slices, stripe length and reducers of the worked examples.
K, L, R = 6, 4, 6
STEPS = 32


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_suppkey") + 1).cast("bigint").alias("term"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).groupBy("row_id").agg(F.array_sort(F.collect_list("term")).alias("v"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("node_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    step = item.select(F.col("l_partkey").cast("bigint").alias("src"), F.lead("l_partkey").over(order).cast("bigint").alias("dst"), F.col("l_quantity").cast("bigint").alias("w"))
    return step.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def _flat(df: DataFrame, column, value: str = "term", pos: str = "pos") -> DataFrame:
    """(row_id, pos, value) from an array made on top of a shuffled vector."""
    made = df.select("row_id", column.alias("__a"))
    return made.select("row_id", F.posexplode_outer("__a").alias(pos, value)).where(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("bigint"))


def term_vectors(spark, sf_dir):
    return _flat(vectors(spark, sf_dir), F.col("v"))


def vector_stats(spark, sf_dir):
    return terms(spark, sf_dir).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("n_distinct"), F.min("term").alias("least"), F.max("term").alias("most"), F.sum("term").alias("total"))


def row_term_counts(spark, sf_dir):
    return C.term_counts(terms(spark, sf_dir))


def row_distinct(spark, sf_dir):
    return terms(spark, sf_dir).distinct()


def run_lengths(spark, sf_dir):
    runs = _flat(vectors(spark, sf_dir), V.run_lengths(F.col("v")), "r", "run_no")
    return runs.select("row_id", "run_no", F.col("r.value").alias("term"), F.col("r.length").alias("run_length"))


def run_bounds(spark, sf_dir):
    bounds = F.zip_with(V.run_starts(F.col("v")), V.run_ends(F.col("v")), lambda s, e: F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e")))
    return _flat(vectors(spark, sf_dir), bounds, "r", "run_no").select("row_id", "run_no", F.col("r.s").alias("run_start"), F.col("r.e").alias("run_end"))


def count_bits(spark, sf_dir):
    n, half = F.size("v"), F.floor(F.size("v") / 2).cast("int")
    bits = F.transform("v", lambda x: x % 2 == 0)
    return _flat(vectors(spark, sf_dir), V.count_bits(bits, F.array(F.lit(0), half), F.array(half, n)), "n_bits", "range_no")


def array_slice(spark, sf_dir):
    return _flat(vectors(spark, sf_dir), V.cut(F.col("v"), F.lit(1), F.size("v") - 1))


def gather(spark, sf_dir):
    n = F.size("v")
    return _flat(vectors(spark, sf_dir), V.gather(F.col("v"), F.transform(V.iota(n), lambda i: n - 1 - i)))


def scatter(spark, sf_dir):
    n = F.size("v")
    source = F.filter(V.iota(n), lambda i: i % 2 == 0)
    target = F.transform(source, lambda i: n - 1 - i)
    return _flat(vectors(spark, sf_dir), V.scatter(F.col("v"), V.fill(F.lit(0).cast("bigint"), n), source, target), "value")


def argsort(spark, sf_dir):
    order = V.argsort(F.transform("v", lambda x: x * 7919 % 1009))
    made = _flat(vectors(spark, sf_dir), order, "idx", "rank")
    return made.withColumn("idx", F.col("idx").cast("bigint"))


def contig_split(spark, sf_dir):
    rows = P.once(terms(spark, sf_dir).select("row_id").distinct())
    return P.contiguous(rows, "row_id", K, "slice")


def graph_split(spark, sf_dir):
    return P.contiguous(vertices(spark, sf_dir), "node_id", K)


def clique_last_nodes(spark, sf_dir):
    return P.last_keys(graph_split(spark, sf_dir), "node_id")


def emission_counts(spark, sf_dir):
    emitted = row_distinct(spark, sf_dir).join(contig_split(spark, sf_dir), "row_id").groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    return P.running_total(emitted, "slice", "n", "stop")


def _key_counts(spark, sf_dir):
    return row_distinct(spark, sf_dir).groupBy(F.col("term").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def range_bounds(spark, sf_dir):
    return P.range_starts(_key_counts(spark, sf_dir), "key", "n", R)


def part_sorted(spark, sf_dir):
    """Each key's place in the sorted emissions and the slice that holds it."""
    counts = P.once(_key_counts(spark, sf_dir))
    placed = P.once(P.running_total(counts, "key", "n", "stop").select("key", "n", (F.col("stop") - F.col("n")).alias("pos")))
    return P.route(placed, P.slice_cuts(P.range_starts_of(placed, R), "part"), "pos", "part")


def part_dealt(spark, sf_dir):
    """The emissions dealt to the exact slices: of each key in each partition how many rows lie there, and where the first and last do.

    Places are counted in the partitions as they were dealt, behind where the slice starts.
    """
    emitted = P.once(row_distinct(spark, sf_dir).select("row_id", F.col("term").alias("key")))
    lies = (F.col("__n") - F.shiftleft(F.col("part").cast("bigint"), 33)).alias("at")
    rows = P.once(P.by_slices(emitted, "key", R).select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("__n")))
    starts = P.range_starts(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "n", R)
    runs = rows.select("key", "part", lies).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("at").alias("a"), F.max("at").alias("b"))
    met = runs.join(F.broadcast(starts), F.col("part") == F.col("i"))  # a row a slice
    return met.select(F.col("part").alias("slice"), "key", "n_rows", (F.col("start") + F.col("a")).alias("first_pos"), (F.col("start") + F.col("b")).alias("last_pos"))


def _orders(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("node_id"))


def route_many(spark, sf_dir):
    """Items to the owners of their orders: 300 slices, looked up in a tree of two levels."""
    last = P.last_keys(P.contiguous(P.once(_orders(spark, sf_dir).distinct()), "node_id", 300), "node_id")
    items = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("node_id"), "l_linenumber")
    return P.route(items, last).groupBy("clique_idx").agg(F.count(F.lit(1)).alias("n_items"), F.min("node_id").alias("least"), F.max("node_id").alias("most"))


def running_items(spark, sf_dir):
    """Items up to each order, by a scan in as many levels as ranges of about 200 orders take."""
    items = terms(spark, sf_dir).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    return P.running_total(P.once(items), "row_id", "n", "upto", most=200)


def _stripes(spark, sf_dir):
    return C.stripes(C.term_counts(terms(spark, sf_dir)), L)


def _stripe_rows(df):
    made = df.select("row_id", "key", F.posexplode_outer("stripe").alias("pos", "s")).where("pos is not null")
    return made.select("row_id", "key", F.col("pos").cast("bigint").alias("pos"), F.col("s.term").alias("term"), F.col("s.cnt").alias("cnt"))


def stripe_emit(spark, sf_dir):
    return _stripe_rows(_stripes(spark, sf_dir))


def stripe_padded(spark, sf_dir):
    return _stripe_rows(C.padded(_stripes(spark, sf_dir), L))


def stripe_unfold(spark, sf_dir):
    flat = C.padded(_stripes(spark, sf_dir), L).select("row_id", "key", V.fold(F.col("stripe")).alias("flat"))
    return _stripe_rows(flat.select("row_id", "key", V.unfold(F.col("flat")).alias("stripe")))


def cooc_pairs(spark, sf_dir):
    return C.pairs(C.term_counts(terms(spark, sf_dir)))


def cooc(spark, sf_dir):
    return C.by_stripes(terms(spark, sf_dir))


def cooc_by_pairs(spark, sf_dir):
    return C.by_pairs(terms(spark, sf_dir))


def cooc_padded(spark, sf_dir):
    return C.by_stripes(terms(spark, sf_dir), L, pad=True)


def cooc_tiled(spark, sf_dir):
    """The same with rows of more than two terms, of those that a sample shows, as hot ones: tile by tile."""
    return C.by_stripes(terms(spark, sf_dir), tile=2)


def cooc_padded_tiled(spark, sf_dir):
    return C.by_stripes(terms(spark, sf_dir), L, pad=True, tile=2)


def cooc_wrapped(spark, sf_dir):
    return C.by_stripes(terms(spark, sf_dir), L, wrap=True, partitions=R)


def adjacency(spark, sf_dir):
    made = G.adjacency(vertices(spark, sf_dir), edges(spark, sf_dir))
    return made.select("node_id", F.explode_outer("edges").alias("e")).select("node_id", "e.dst", "e.w")


def sssd_init(spark, sf_dir):
    return G.start(vertices(spark, sf_dir), 0)


def _state(spark, sf_dir, steps):
    """After the first ``steps`` supersteps of a graph run whose first one only emits."""
    state = sssd_init(spark, sf_dir)
    made = edges(spark, sf_dir)
    for _ in range(steps - 1):
        state = bsp.superstep(state, made, bsp.shortest())
    return state.select("node_id", "state")


def bsp_messages(spark, sf_dir):
    return bsp.messages(sssd_init(spark, sf_dir), edges(spark, sf_dir), bsp.shortest())


def bsp_inbox(spark, sf_dir):
    boxes = P.inbox(bsp_messages(spark, sf_dir)).withColumnRenamed("node_id", "row_id")
    return _flat(boxes, F.col("messages"), "message").withColumnRenamed("row_id", "node_id")


def bsp_combine(spark, sf_dir):
    return bsp.combine(bsp_messages(spark, sf_dir), bsp.shortest())


def bsp_route(spark, sf_dir):
    return P.route(bsp_combine(spark, sf_dir).select("node_id"), clique_last_nodes(spark, sf_dir))


def bsp_update(spark, sf_dir):
    return bsp.superstep(sssd_init(spark, sf_dir), edges(spark, sf_dir), bsp.shortest())


def bsp_votes(spark, sf_dir):
    return bsp.votes(bsp_update(spark, sf_dir), graph_split(spark, sf_dir))


def bsp_step1(spark, sf_dir):
    return _state(spark, sf_dir, 1)


def bsp_step2(spark, sf_dir):
    return _state(spark, sf_dir, 2)


def bsp_step3(spark, sf_dir):
    return _state(spark, sf_dir, 3)


def sssd(spark, sf_dir):
    return G.shortest_distances(vertices(spark, sf_dir), edges(spark, sf_dir), 0)[0]


def sssd_hubs(spark, sf_dir):
    """The same with every vertex of more than three edges mirrored."""
    return G.shortest_distances(vertices(spark, sf_dir), edges(spark, sf_dir), 0, hub=3)[0]


def share_reconstruct(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("bigint").alias("size"))
    shared = shares.share(part, "size", ["node_id"])
    return shared.select("node_id", shares.reconstruct("size").alias("size"))


def share_sum(spark, sf_dir):
    """Sums of shares are shares of the sum."""
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_brand", F.col("p_size").cast("bigint").alias("size"))
    sums = shares.share(part, "size", ["node_id"]).groupBy("p_brand").agg(*[F.sum(f"size_{i}").alias(f"size_{i}") for i in (1, 2, 3)])
    return sums.select("p_brand", shares.reconstruct("size").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        term_vectors, vector_stats, row_term_counts, row_distinct, run_lengths, run_bounds, count_bits, array_slice, gather, scatter, argsort,
        contig_split, graph_split, clique_last_nodes, emission_counts, range_bounds, part_sorted, part_dealt, route_many, running_items,
        stripe_emit, stripe_padded, stripe_unfold, cooc_pairs, cooc, cooc_by_pairs, cooc_padded, cooc_tiled, cooc_padded_tiled, cooc_wrapped,
        adjacency, sssd_init, bsp_messages, bsp_inbox, bsp_combine, bsp_route, bsp_update, bsp_votes, bsp_step1, bsp_step2, bsp_step3, sssd, sssd_hubs,
        share_reconstruct, share_sum,
    )
}

_TV = "tv AS (SELECT l_orderkey AS row_id, CAST(l_suppkey + 1 AS BIGINT) AS term FROM lineitem), sv AS (SELECT row_id, term, row_number() OVER (PARTITION BY row_id ORDER BY term) - 1 AS pos, count(*) OVER (PARTITION BY row_id) AS n FROM tv)"
_RC = _TV + ", rc AS (SELECT row_id, term, count(*) AS cnt FROM tv GROUP BY ALL)"
_RUNS = _RC + ", runs AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY term) - 1 AS run_no, term, cnt, sum(cnt) OVER (PARTITION BY row_id ORDER BY term) AS stop FROM rc)"
_ROWS = "ids AS (SELECT DISTINCT l_orderkey AS row_id FROM lineitem), split AS (SELECT row_id, CAST(least(CASE WHEN n // 6 = 0 THEN 5 ELSE (rn - 1) // (n // 6) END, 5) AS INTEGER) AS slice FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM ids))"
_NODES = "nodes AS (SELECT p_partkey AS node_id, CAST(least(CASE WHEN n // 6 = 0 THEN 5 ELSE (rn - 1) // (n // 6) END, 5) AS INTEGER) AS clique_idx FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part)), last AS (SELECT clique_idx, max(node_id) AS last_node FROM nodes GROUP BY ALL)"
_KEYS = _RC + ", keys AS (SELECT term AS key, count(*) AS n FROM rc GROUP BY ALL), placed AS (SELECT key, n, CAST(sum(n) OVER (ORDER BY key) - n AS BIGINT) AS pos FROM keys), e AS (SELECT sum(n) AS e FROM keys), starts AS (SELECT CAST(i AS INTEGER) AS i, CAST(CASE WHEN i = 0 THEN 0 ELSE coalesce((SELECT min(pos) FROM placed WHERE pos > 0 AND pos >= (SELECT e // 6 FROM e) * i), (SELECT e FROM e)) END AS BIGINT) AS start FROM range(6) t(i))"
_PAIRS = _RC + ", pairs AS (SELECT a.row_id, a.term AS \"left\", b.term AS \"right\", b.cnt FROM rc a JOIN rc b ON a.row_id = b.row_id AND a.term <> b.term)"
_CUT = _PAIRS + ", numbered AS (SELECT row_id, \"left\" AS key, \"right\" AS term, cnt, row_number() OVER (PARTITION BY row_id, \"left\" ORDER BY \"right\") - 1 AS pos FROM pairs), cut AS (SELECT * FROM numbered WHERE pos < 4)"
_PADDED = _CUT + ", fill AS (SELECT r.row_id, r.term AS key, p.pos FROM rc r CROSS JOIN (SELECT range AS pos FROM range(4)) p), padded AS (SELECT f.row_id, f.key, CAST(f.pos AS BIGINT) AS pos, coalesce(c.term, 0) AS term, coalesce(c.cnt, 0) AS cnt FROM fill f LEFT JOIN cut c ON c.row_id = f.row_id AND c.key = f.key AND c.pos = f.pos)"
_EDGES = "step AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem WHERE l_returnflag = 'R'), edges AS (SELECT src, dst, min(w) AS w FROM step WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), s1 AS (SELECT p_partkey AS node_id, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE 2147483647 END AS BIGINT) AS state FROM part), m1 AS (SELECT dst AS node_id, state + w AS message FROM s1 JOIN edges ON src = node_id), c1 AS (SELECT node_id, min(message) AS message FROM m1 GROUP BY ALL), s2 AS (SELECT node_id, least(state, coalesce(message, 2147483647)) AS state, least(state, coalesce(message, 2147483647)) <> state AS changed FROM s1 LEFT JOIN c1 USING (node_id))"

ORACLES = {
    "term_vectors": f"WITH {_TV} SELECT row_id, pos, term FROM sv",
    "vector_stats": f"WITH {_TV} SELECT row_id, count(*) AS n, count(DISTINCT term) AS n_distinct, min(term) AS least, max(term) AS most, CAST(sum(term) AS BIGINT) AS total FROM tv GROUP BY row_id",
    "row_term_counts": f"WITH {_RC} SELECT * FROM rc",
    "row_distinct": f"WITH {_TV} SELECT DISTINCT row_id, term FROM tv",
    "run_lengths": f"WITH {_RUNS} SELECT row_id, run_no, term, cnt AS run_length FROM runs",
    "run_bounds": f"WITH {_RUNS} SELECT row_id, run_no, CAST(stop - cnt AS BIGINT) AS run_start, CAST(stop AS BIGINT) AS run_end FROM runs",
    "count_bits": f"WITH {_TV}, halves AS (SELECT row_id, term, n, CASE WHEN pos < n // 2 THEN 0 ELSE 1 END AS half FROM sv), all_ranges AS (SELECT DISTINCT row_id, r.range AS range_no FROM sv CROSS JOIN range(2) r) SELECT a.row_id, CAST(a.range_no AS BIGINT) AS range_no, count(h.term) AS n_bits FROM all_ranges a LEFT JOIN halves h ON h.row_id = a.row_id AND h.half = a.range_no AND h.term % 2 = 0 GROUP BY ALL",
    "array_slice": f"WITH {_TV} SELECT row_id, pos - 1 AS pos, term FROM sv WHERE pos >= 1 AND pos < n - 1",
    "gather": f"WITH {_TV} SELECT row_id, n - 1 - pos AS pos, term FROM sv",
    "scatter": f"WITH {_TV} SELECT row_id, n - 1 - pos AS pos, CASE WHEN pos % 2 = 0 THEN term ELSE 0 END AS value FROM sv",
    "argsort": f"WITH {_TV} SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY term * 7919 % 1009, pos) - 1 AS rank, pos AS idx FROM sv",
    "contig_split": f"WITH {_ROWS} SELECT * FROM split",
    "graph_split": f"WITH {_NODES} SELECT * FROM nodes",
    "clique_last_nodes": f"WITH {_NODES} SELECT * FROM last",
    "emission_counts": f"WITH {_RC}, {_ROWS}, c AS (SELECT slice, count(*) AS n FROM rc JOIN split USING (row_id) GROUP BY ALL) SELECT slice, n, CAST(sum(n) OVER (ORDER BY slice) AS BIGINT) AS stop FROM c",
    "range_bounds": f"WITH {_KEYS} SELECT * FROM starts",
    "part_sorted": f"WITH {_KEYS} SELECT key, n, pos, max(i) AS part FROM placed JOIN starts ON start <= pos GROUP BY ALL",
    "part_dealt": f"WITH {_KEYS} SELECT CAST(max(i) AS INTEGER) AS slice, key, n AS n_rows, pos AS first_pos, pos + n - 1 AS last_pos FROM placed JOIN starts ON start <= pos GROUP BY key, n, pos",
    "route_many": "WITH ids AS (SELECT DISTINCT o_orderkey AS k FROM orders), split AS (SELECT k, CAST(least(CASE WHEN n // 300 = 0 THEN 299 ELSE (rn - 1) // (n // 300) END, 299) AS INTEGER) AS clique_idx FROM (SELECT k, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS n FROM ids)), last AS (SELECT clique_idx, max(k) AS last_node FROM split GROUP BY ALL), item AS (SELECT l_orderkey AS node_id FROM lineitem) SELECT clique_idx, count(*) AS n_items, min(node_id) AS least, max(node_id) AS most FROM item ASOF LEFT JOIN last ON node_id <= last_node GROUP BY ALL",
    "running_items": f"WITH {_TV} SELECT row_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY row_id) AS BIGINT) AS upto FROM tv GROUP BY row_id",
    "stripe_emit": f"WITH {_CUT} SELECT row_id, key, pos, term, cnt FROM cut",
    "stripe_padded": f"WITH {_PADDED} SELECT * FROM padded",
    "stripe_unfold": f"WITH {_PADDED} SELECT * FROM padded",
    "cooc_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "cooc": f"WITH {_PAIRS} SELECT \"left\", \"right\", CAST(sum(cnt) AS BIGINT) AS cnt FROM pairs GROUP BY ALL",
    "cooc_padded": f"WITH {_PADDED} SELECT key AS \"left\", term AS \"right\", CAST(sum(cnt) AS BIGINT) AS cnt FROM padded GROUP BY ALL",
    "cooc_wrapped": f"WITH {_CUT} SELECT key AS \"left\", term AS \"right\", CAST(sum(cnt) % 4294967296 AS BIGINT) AS cnt FROM cut GROUP BY ALL",
    "adjacency": f"WITH {_EDGES} SELECT node_id, dst, w FROM s1 LEFT JOIN edges ON src = node_id",
    "sssd_init": f"WITH {_EDGES} SELECT * FROM s1",
    "bsp_messages": f"WITH {_EDGES} SELECT * FROM m1",
    "bsp_inbox": f"WITH {_EDGES} SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY message) - 1 AS pos, message FROM m1",
    "bsp_combine": f"WITH {_EDGES} SELECT * FROM c1",
    "bsp_route": f"WITH {_EDGES}, {_NODES} SELECT node_id, clique_idx FROM c1 JOIN nodes USING (node_id)",
    "bsp_update": f"WITH {_EDGES} SELECT * FROM s2",
    "bsp_votes": f"WITH {_EDGES}, {_NODES} SELECT clique_idx, bool_and(NOT changed) AS halt FROM s2 JOIN nodes USING (node_id) GROUP BY ALL",
    "bsp_step1": f"WITH {_EDGES} SELECT * FROM s1",
    "bsp_step2": f"WITH {_EDGES} SELECT node_id, state FROM s2",
    "bsp_step3": f"WITH {_EDGES}, c2 AS (SELECT dst AS node_id, min(state + w) AS message FROM s2 JOIN edges ON src = node_id GROUP BY ALL) SELECT node_id, least(state, coalesce(message, 2147483647)) AS state FROM s2 LEFT JOIN c2 USING (node_id)",
    "sssd": f"WITH RECURSIVE {_EDGES}, b(k, node_id, d) AS (SELECT 0, node_id, state FROM s1 UNION ALL SELECT k + 1, node_id, min(d) FROM (SELECT k, node_id, d FROM b UNION ALL SELECT b.k, e.dst, b.d + e.w FROM b JOIN edges e ON e.src = b.node_id) WHERE k < {STEPS} GROUP BY k, node_id) SELECT node_id, d AS state FROM b WHERE k = {STEPS}",
    "share_reconstruct": "SELECT p_partkey AS node_id, CAST(p_size AS BIGINT) AS size FROM part",
    "share_sum": "SELECT p_brand, CAST(sum(p_size) % 4294967296 AS BIGINT) AS size FROM part GROUP BY ALL",
}
ORACLES["cooc_by_pairs"] = ORACLES["cooc_tiled"] = ORACLES["cooc"]
ORACLES["cooc_padded_tiled"], ORACLES["sssd_hubs"] = ORACLES["cooc_padded"], ORACLES["sssd"]
assert INF == 2147483647  # as in the SQL above
