"""Threshold-scaled sketches of documents.

A shingle is five consecutive words (a shorter text is one shingle). Its 64-bit hash is
kept if it lies below a fixed fraction of the hash space, whatever the length of the
document. So the sketch of a union is the union of sketches, and for documents of very
unequal length the share of the smaller sketch found in the larger estimates containment.

The fraction is one for all texts. A text none of whose hashes lies below it is known by its
smallest hash alone: such a sketch equals that of an equal text, is unlike all others, and gives
way in a union that has a hash below the fraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

WORDS = 5
FRACTION = 1 / 4


def _most(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))


def sketches(texts: textops.Texts, k: int = WORDS, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sorted distinct retained hashes of each text: those below the fraction, or else the smallest. A text without a word has none."""
    most = _most(fraction)
    out: list[np.ndarray] = []
    for first, end in texts.groups():
        starts, ends, first_word = texts.words(first, end)
        words = texts.hashes(starts, ends)
        at, text = textops.within(first_word, k)
        hashes = textops.shingles(words, k)[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((np.diff(first_word) > 0) & (np.diff(first_word) < k))
        if len(short):
            own = np.array([textops.shingles(words[first_word[i] : first_word[i + 1]], int(first_word[i + 1] - first_word[i]))[0] for i in short], np.uint64)
            hashes, text = np.concatenate([hashes, own]), np.concatenate([text, short])
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, text = hashes[new], text[new]
        least = np.ones(len(text), bool)
        least[1:] = text[1:] != text[:-1]
        keep = least | (hashes <= most)
        hashes, text = hashes[keep], text[keep]
        out += np.split(hashes, np.searchsorted(text, np.arange(1, end - first)))
    return out


def _shared(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[int, int, int]:
    """Hashes below the fraction that both hold, and how many each has."""
    most = _most(fraction)
    a, b = a[: np.searchsorted(a, most, "right")], b[: np.searchsorted(b, most, "right")]
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Share of the smaller sketch that the other holds: 1 for equal sketches, those of two texts without a word included, 0 if
    one of two different ones has no hash below the fraction."""
    if np.array_equal(a, b):
        return 1.0
    both, n, m = _shared(a, b, fraction)
    return both / min(n, m) if n and m else 0.0


def resemblance(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Share of the union of two sketches that both hold; 1 for equal ones."""
    if np.array_equal(a, b):
        return 1.0
    both, n, m = _shared(a, b, fraction)
    return both / (n + m - both) if n and m else 0.0


def as_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits a hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge(*many: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the texts together (shingles that span two texts aside)."""
    union = np.unique(np.concatenate(many)) if many else np.zeros(0, np.uint64)
    return union[: max(1, np.searchsorted(union, _most(fraction), "right"))]


def fingerprint(df: DataFrame, text: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """df with a column ``sketch`` array<bigint>: the retained hashes (as signed 64-bit, in unsigned order).

    Null texts and those without a word have an empty sketch, repeated rows equal ones. A task holds a batch of texts, read
    in groups of about 1 MB or one longer text. A column of that
    name in df is replaced; no other column is touched.
    """
    from pyspark.sql import types as T

    kept = df.drop("sketch")
    schema = T.StructType([*kept.schema.fields, T.StructField("sketch", T.ArrayType(T.LongType()))])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(textops.Texts(batch.column(at)), k, fraction)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], [*batch.schema.names, "sketch"])

    return kept.mapInArrow(run, schema)


def compare_with_next(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against an edited copy of itself and against the next document by descending doc_id.

    Edited: the last floor(n/2) code points replaced by as many first ones of the next
    document (or all it has). After the last document comes the first. Rows of one doc_id
    follow one another by descending text, null ids come first (as the largest); null text is empty text.
    Rows are dealt by ranges of doc_id; each range gets one further row, the first of the
    next range, so no task sees more than a range. Rows without an id are dealt over ranges of
    their own and follow one another by descending text in each. An empty table gives no row; other columns, whatever their names, are not read.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt, _, _ = common.in_ranges(spark, d, "doc_id", "text", spread=True)
    # a row for each range: as many as there are bounds
    largest = F.max(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    used = sorted((r[0], r[1]["doc_id"]) for r in dealt.groupBy("__shard").agg(largest).collect())
    if not used:
        return spark.createDataFrame([], RESULT)
    # the head of a range goes to the next higher range, that of the highest one to the lowest
    wanted = spark.createDataFrame([(s, h, used[(i + 1) % len(used)][0]) for i, (s, h) in enumerate(used)], "own int, head bigint, to int")
    heads = dealt.join(F.broadcast(wanted), (F.col("__shard") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")))
    heads = heads.groupBy(F.col("to").alias("shard"), "doc_id").agg(F.max("text").alias("text"))
    both = dealt.select("doc_id", "text", F.col("__shard").alias("shard"), F.lit(False).alias("extra")).unionByName(heads.withColumn("extra", F.lit(True)))
    return both.groupBy("shard").applyInArrow(_compare, RESULT)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, resembles_edited double"


def _compare(group: pa.Table) -> pa.Table:
    import hashlib

    if group.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64())})
    group = group.append_column("known", pc.is_valid(group["doc_id"])).combine_chunks().sort_by([("extra", "ascending"), ("known", "ascending"), ("doc_id", "descending"), ("text", "descending")])
    n = group.num_rows - int(pc.sum(group["extra"]).as_py())
    texts = group["text"].to_pylist()
    edited = []
    for i in range(n):
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    own = sketches(textops.Texts(group["text"]))
    new = sketches(textops.Texts(pa.array(edited, pa.string())))
    return pa.table(
        {
            "doc_id": group["doc_id"].slice(0, n),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [as_text(s) for s in own[:n]],
            "edited_fingerprint": [as_text(s) for s in new],
            "near_edited": [containment(own[i], new[i]) for i in range(n)],
            "near_next": [containment(own[i], own[i + 1]) for i in range(n)],
            "resembles_edited": [resemblance(own[i], new[i]) for i in range(n)],
        }
    )
