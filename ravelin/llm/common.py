"""What the text operators share: tables, columns, partition counts and durable cuts of lineage."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, shared_folder

_AT_END: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after the group that needed it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(function, groups: int = 1):
    """A function of one group, or two, after which freed memory is given back."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            trim()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            trim()

    return one if groups == 1 else two


#: Rows of a file of a small table.
FILE_ROWS = 50_000


def durable(spark: SparkSession, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends in replicated files.

    rows: how many there are at most, where that is known: a small table then makes few files, not one for
    each shuffle partition. The files go when the Python process ends with its session alive, or by ``clean``.
    """
    own = _own_dir(spark)
    if own not in _AT_END:
        _AT_END.add(own)
        atexit.register(_clean_at_end, spark)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    few = df if rows is None else df.coalesce(max(8, rows // FILE_ROWS))
    few.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean_at_end(spark: SparkSession) -> None:
    if spark.sparkContext._jsc:
        try:
            clean(spark)
        except (Py4JError, OSError):  # the JVM ended first
            pass


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ravelin-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all that durable() wrote in this application: once the results are written, nothing reads it."""
    delete_folder(spark, _own_dir(spark))


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame that durable() made, once nothing reads it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ravelin-" in parent:
            delete_folder(spark, parent)


def in_ranges(spark: SparkSession, df: DataFrame, doc_id: str, text: str, least: int = 2 << 20, most: int = 16 << 20, spread: bool = False) -> tuple[DataFrame, int, int]:
    """(df with ``__shard``, the number of a range of doc_id; the bytes of text; the number of ranges of ids).

    A range holds ``least`` to ``most`` bytes of text, or one longer text and what follows it
    up to that; rows of one id stay together. Null ids are in the last range or, with ``spread``,
    dealt over ranges of about as many bytes behind it. The bounds come from a distributed sort
    of the ids with the sizes of their texts and are broadcast: 8 bytes for each range, 100 TB
    in ranges of 16 MB make 50 MB.
    """
    length = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")
    size, none = df.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.sum(F.when(F.col(doc_id).isNull(), length + 64)), F.lit(0))).first()
    each = int(min(max(size // 2048, least), most))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            end = so_far + np.cumsum(batch.column(1).to_numpy())
            if len(end):
                begin = np.append(so_far, end[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.flatnonzero(end // each > begin // each)))], ["id"])
                so_far = int(end[-1])

    ids = df.select(F.col(doc_id).cast("bigint").alias("id"), length.alias("n")).where("id is not null")
    ids = ids.repartitionByRange("id").sortWithinPartitions("id")
    bounds = np.unique(np.array([r[0] for r in ids.mapInArrow(pick, "id bigint").collect()], np.int64))
    known = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def shard(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(known.value, ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False), "right"), pa.int32())

    place, ranges = shard(F.col(doc_id).cast("bigint")), len(bounds) + 1
    if not (spread and none):
        return df.withColumn("__shard", place), size, ranges
    # dealt by place, once: a row must not change its range when a lost task is run again
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 + none // each))
    others = durable(spark, df.where(F.col(doc_id).isNull()).withColumn("__shard", (ranges + number).cast("int")), "without-ids")
    return df.where(F.col(doc_id).isNotNull()).withColumn("__shard", place).unionByName(others), size, ranges
