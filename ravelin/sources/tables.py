"""Named tables: create, drop, append, column scans by name or place, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import STATE, VECTORS


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def delete(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """An empty table; one of that name is replaced."""
    delete(spark, name)
    spark.createDataFrame([], schema).write.saveAsTable(name)


def append(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def column(spark: SparkSession, name: str, which: str | int) -> DataFrame:
    """One column by name or place; nothing else is read."""
    table = spark.table(name)
    return table.select(which if isinstance(which, str) else table.columns[which])


def append_columns(spark: SparkSession, name: str, columns: dict[str, DataFrame], key: str) -> None:
    """Append whole columns, each a frame of (key, its name): rows are put together by key."""
    frames = list(columns.values())
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.join(f, key)
    append(rows.select(*spark.table(name).columns), name)


def counts(spark: SparkSession, name: str) -> tuple[int, int]:
    """(rows, columns)."""
    table = spark.table(name)
    return table.count(), len(table.columns)


def upload_vectors(rows: DataFrame, name: str, overwrite: bool) -> None:
    """Append (row_id, terms); with overwrite the table starts anew."""
    spark = rows.sparkSession
    if overwrite or not exists(spark, name):
        create(spark, name, VECTORS)
    append(rows.select("row_id", "terms"), name)


def create_graph(spark: SparkSession, state: str, graph: str) -> None:
    create(spark, state, STATE)
    create(spark, graph, T.StructType([T.StructField("node_id", T.LongType()), T.StructField("edges", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.LongType()))]))


def upload_graph(rows: DataFrame, state: str, graph: str) -> None:
    """Append (node_id, edges, weights, state); edge and weight lists of different size are an error.

    The rows are checked as a whole before either table is written, so a bad row leaves both as they were.
    """
    wrong = rows.where(F.coalesce(F.size("edges") != F.size("weights"), F.lit(True))).select("node_id").limit(1).collect()
    if wrong:
        raise ValueError(f"edges and weights differ in size at {wrong[0][0]}")
    append(rows.select("node_id", "edges", "weights"), graph)
    append(rows.select("node_id", "state"), state)
