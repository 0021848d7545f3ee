"""Text, JSON and CSV forms of term vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGE, INF, PAD
from ..operators.partition import contiguous
from ..plans.graph import checked


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(terms) from lines of comma-separated whole numbers. An empty line or a term that is no number is an error."""
    return spark.read.text(path).select(F.transform(F.split("value", ","), lambda x: F.trim(x).cast("bigint")).alias("terms"))


def numbered_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, terms): as read_vectors, with the lines counted from 0 through all files in the order of their names.

    The places of the splits are summed up over one row a split; no line is moved.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__n"))
    blocks = lines.groupBy("__file", "__block").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__base"))
    row = (F.col("__base") + F.col("__n") - F.col("__first")).alias("row_id")
    return lines.join(blocks, ["__file", "__block"]).select(row, F.transform(F.split("value", ","), lambda x: F.trim(x).cast("bigint")).alias("terms"))


def write_vectors(df: DataFrame, path: str, order: str = "row_id", mode: str = "overwrite") -> None:
    """Lines of comma-separated terms, by ascending ``order`` through the files."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.array_join(F.transform("terms", lambda t: t.cast("string")), ",")).write.mode(mode).text(path)


def write_graph(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines ``v:dst|w,dst|w`` from (node_id, edges)."""
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws("|", e["dst"].cast("string"), e["w"].cast("string"))), ",")
    df.select(F.concat(F.col("node_id").cast("string"), F.lit(":"), edges)).write.mode(mode).text(path)


def without_padding(terms: DataFrame) -> DataFrame:
    """Term 0 is reserved: such terms are dropped on the way in."""
    return terms.withColumn("terms", F.filter("terms", lambda t: t != PAD))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, edges) from lines ``v:dst|w,dst|w``; a vertex without edges is ``v:``."""
    node = F.split("value", ":", 2)
    items = F.filter(F.split(F.coalesce(F.get(node, 1), F.lit("")), ","), lambda x: F.trim(x) != "")
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit("|"), F.lit(1))).cast("bigint").alias("dst"), F.trim(F.split_part(x, F.lit("|"), F.lit(2))).cast("bigint").alias("w"))
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.get(node, 0)).cast("bigint").alias("node_id"), F.transform(items, pair).alias("edges"))


def write_chunks(df: DataFrame, key: str, parts: int, path: str, mode: str = "overwrite") -> None:
    """JSON lines in folders part=0 .. parts-1: contiguous slices by key, the last takes the rest. An empty slice writes no folder."""
    contiguous(df, key, parts, "part").write.mode(mode).partitionBy("part").json(path)


def read_vector_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, terms, part) as written."""
    return spark.read.schema("row_id bigint, terms array<bigint>, part int").json(path)


def chunk_args(chunks: DataFrame) -> DataFrame:
    """(part, num_entries, overwrite): what the upload of each chunk is called with; the first one starts the table anew."""
    return chunks.groupBy("part").agg(F.count(F.lit(1)).alias("num_entries")).select("part", "num_entries", (F.col("part") == 0).alias("overwrite"))


def with_state(graph: DataFrame, source: int) -> DataFrame:
    """A graph with its start state: 0 at the source, elsewhere unreachable."""
    return graph.withColumn("state", F.when(F.col("node_id") == source, 0).otherwise(INF).cast("bigint"))


def read_graph_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"node_id bigint, edges array<{EDGE.simpleString()}>, state bigint, part int").json(path)


def write_flat_graph(graph: DataFrame, parts: int, path: str, mode: str = "overwrite") -> None:
    """One JSON object for each slice of (node_id, edges, state), with keys nid_i, nid_i_edges, nid_i_weights and nid_i_state.

    Slices are contiguous by node_id, the last takes the rest; i counts from 0 in each. A slice is written by
    one task, line by line: nothing is gathered.
    """
    dealt = contiguous(graph, "node_id", parts, "part")
    order = Window.partitionBy("part").orderBy("node_id")
    i, last = F.row_number().over(order) - 1, F.lead("node_id").over(order).isNull()
    name = lambda what: F.concat(F.lit('"nid_'), F.col("i").cast("string"), F.lit(what + '": '))
    listed = lambda field: F.concat(F.lit("["), F.array_join(F.transform("edges", lambda e: e[field].cast("string")), ", "), F.lit("]"))
    fields = [("", F.col("node_id").cast("string")), ("_edges", listed("dst")), ("_weights", listed("w")), ("_state", F.col("state").cast("string"))]
    body = F.concat_ws(",\n  ", *[F.concat(name(what), value) for what, value in fields])
    line = F.concat(F.when(F.col("i") == 0, "{\n  ").otherwise("  "), body, F.when(F.col("last"), "\n}").otherwise(","))
    rows = dealt.select("part", "node_id", "edges", "state", i.alias("i"), last.alias("last"))
    rows.repartition(parts, "part").sortWithinPartitions("part", "i").select("part", line.alias("value")).write.mode(mode).partitionBy("part").text(path)


#: What a line of a flat graph's pretty-printed object is: the braces, a key with what stands behind it, a number, the end of a list.
_KEY, _NUMBER, _REST = r'^\s*"nid_(\d+)(?:_(edges|weights|state))?"\s*:\s*(.*?),?\s*$', r"^\s*(-?\d+)\s*,?\s*$", r"^\s*[{}\]]?\s*,?\s*$"


def _flat_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, what, at, v): the numbers behind each key of pretty-printed objects, in order of ``at``; v is null for an empty list.

    Lines are read in splits, so a file may be of any size. A number on a line of its own belongs to the last key before it,
    in its split or, over one row a split, in those before.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    key, number = F.regexp_extract("value", _KEY, 1), F.regexp_extract("value", _NUMBER, 1)
    known = (key != "") | (number != "") | F.col("value").rlike(_REST)
    lines = lines.withColumn("value", F.when(known, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no line of a pretty-printed flat graph, read it with pretty=False: "), F.substring("value", 1, 80)))))
    named = F.struct(key.cast("bigint").alias("i"), F.regexp_extract("value", _KEY, 2).alias("what"))
    lines = lines.withColumn("key", F.when(key != "", named)).withColumn("rest", F.when(F.col("key").isNotNull(), F.regexp_extract("value", _KEY, 3)).otherwise(number))
    lines = lines.where("key IS NOT NULL OR rest <> ''")
    split = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("own", F.last("key", ignorenulls=True).over(split))
    ends = lines.groupBy("file", "block").agg(F.max(F.struct("n", "own"))["own"].alias("end"))  # a row a split
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    met = lines.join(ends.select("file", "block", before.alias("before")), ["file", "block"]).withColumn("own", F.coalesce("own", "before"))
    numbers = F.filter(F.split(F.translate("rest", "[] ", ""), ","), lambda x: x != "")
    return met.select("file", "own.i", "own.what", "block", "n", F.posexplode_outer(F.transform(numbers, lambda x: x.cast("bigint"))).alias("pos", "v")).select("file", "i", "what", F.struct("block", "n", "pos").alias("at"), "v")


def _flat_fields(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, what, v): the keys of whole-file JSON objects, by kind."""
    fields = F.from_json(F.col("value"), "map<string,string>")
    pairs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(fields).alias("k", "v"))
    return pairs.select("file", F.regexp_extract("k", r"^nid_(\d+)", 1).cast("bigint").alias("i"), F.regexp_extract("k", r"^nid_\d+(?:_(edges|weights|state))?$", 1).alias("what"), "v")


def flat_graph_args(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """(file, num_nodes): what the upload of each object is called with, a quarter of its keys."""
    keys = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(_KEY)) if pretty else _flat_fields(spark, path)
    return keys.groupBy("file").agg(F.floor(F.count(F.lit(1)) / 4).alias("num_nodes"))


def read_flat_graph(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """(node_id, edges, state) from JSON objects with keys nid_i, nid_i_edges, nid_i_weights and nid_i_state.

    i is a number within its file: every file counts from 0. pretty: the objects are printed with a line for each key, or for each number of a list,
    and are read line by line, in splits; else each file is read whole, as one row.
    """
    if pretty:
        rows = _flat_lines(spark, path)
        one = lambda what: F.max(F.when(F.col("what") == what, F.col("v")))
        many = lambda what: F.transform(F.array_sort(F.collect_list(F.when((F.col("what") == what) & F.col("v").isNotNull(), F.struct("at", "v")))), lambda x: x["v"])
        rows = rows.groupBy("file", "i").agg(one("").alias("node_id"), many("edges").alias("e"), many("weights").alias("w"), one("state").alias("state"))
        return rows.select("node_id", checked("node_id", "e", "w").alias("edges"), "state")
    ints = "array<bigint>"
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("v")))
    rows = _flat_fields(spark, path).groupBy("file", "i").agg(pick("").cast("bigint").alias("node_id"), F.from_json(pick("edges"), ints).alias("e"), F.from_json(pick("weights"), ints).alias("w"), pick("state").cast("bigint").alias("state"))
    return rows.select("node_id", checked("node_id", "e", "w").alias("edges"), "state")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
