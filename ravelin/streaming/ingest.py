"""Incremental upload: chunks of vectors that arrive as files get into a table exactly once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows of chunks, and of the ledger beside the table.
CHUNK = "row_id bigint, terms array<bigint>, part int"
LEDGER = "batch bigint, starts boolean, rows bigint"


def append_chunks(spark: SparkSession, source: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Read every JSON-lines file of (row_id, terms) under source, now or once it arrives in a later call, and append it."""
    rows = spark.readStream.schema("row_id bigint, terms array<bigint>").json(source)
    return rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, table_path: str) -> list:
    """The batches applied, a row each, oldest first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_path}/ledger")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{table_path}/ledger").orderBy("batch").collect()


def apply_batch(rows: DataFrame, batch: int, table_path: str) -> bool:
    """Put a batch of (row_id, terms, part) into the table, unless the ledger says that it has been; whether it was put.

    Its rows are written to a folder of the batch, then its line to the ledger. Only batches in the ledger are in the
    table, so one that failed in between is written anew, and one that comes again changes nothing. A batch with rows of part 0 starts the table anew.
    """
    spark = rows.sparkSession
    if any(r["batch"] == batch for r in _ledger(spark, table_path)):
        return False
    rows.select("row_id", "terms", "part").write.mode("overwrite").parquet(f"{table_path}/data/{batch}")
    written = spark.read.schema(CHUNK).parquet(f"{table_path}/data/{batch}")
    line = written.agg(F.lit(batch).cast("bigint").alias("batch"), F.coalesce(F.bool_or(F.col("part") == 0), F.lit(False)).alias("starts"), F.count(F.lit(1)).alias("rows"))
    line.coalesce(1).write.mode("overwrite").parquet(f"{table_path}/ledger/{batch}")
    return True


def upsert_chunks(spark: SparkSession, source: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Every JSON-lines file of (row_id, terms, part) under source, now or once it arrives in a later call, put into the table of
    table(). Batches are known by their number in the checkpoint, so a table has one checkpoint."""
    rows = spark.readStream.schema(CHUNK).json(source)
    put = lambda batch, no: apply_batch(batch, no, table_path)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, table_path: str) -> DataFrame:
    """(row_id, terms, part) as uploaded since part 0 last came; of a row that came several times what the last batch said.

    Rows without an id all stay. A batch is read as it was written; what came before the last start isn't read.
    """
    lines = _ledger(spark, table_path)  # a row a batch
    since = max((r["batch"] for r in lines if r["starts"]), default=-1)
    batches = [spark.read.schema(CHUNK).parquet(f"{table_path}/data/{r['batch']}").withColumn("batch", F.lit(r["batch"])) for r in lines if r["batch"] >= since and r["rows"]]
    if not batches:
        return spark.createDataFrame([], CHUNK)
    rows = reduce(DataFrame.unionByName, batches)
    if len(batches) == 1:
        return rows.drop("batch")
    last = rows.where("row_id IS NOT NULL").groupBy("row_id").agg(F.max_by(F.struct("terms", "part"), "batch").alias("s")).select("row_id", "s.terms", "s.part")
    return last.unionByName(rows.where("row_id IS NULL").drop("batch"))
