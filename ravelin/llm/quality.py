"""Quality of documents by supervised subword embeddings.

Every word and every character 3- and 4-gram inside a word (with its border) has a hashed
row in a table of learned vectors. A word whose trigram of words stood earlier in the same
document adds a marker row, so that repetition is seen. The rows of a document are
averaged, and a linear layer with softmax gives the classes. Vectors and layer are learned
together by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

BITS = 16
_REPEATED = (1 << BITS) - 1
_GRAM = np.uint32(0x01000193)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # (2**BITS, dim)
    layer: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)

    def weights(self) -> tuple[np.ndarray, float]:
        """The layer is linear in the average: a row's share of (logit of 1 - logit of 0), and the bias."""
        d = self.layer[:, 1] - self.layer[:, 0]
        return (self.vectors @ d).astype(np.float32), float(self.bias[1] - self.bias[0])


def features(texts: textops.Texts, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all features of texts first..end, and the text of each (from 0)."""
    starts, ends, first_word = texts.words(first, end)
    words = texts.hashes(starts, ends)
    text_of_word = np.repeat(np.arange(end - first), np.diff(first_word))
    shift = np.uint64(64 - BITS)
    rows, owner = [(words >> shift).astype(np.int32)], [text_of_word]
    at, text = textops.within(first_word, 3)
    if len(at):
        key = textops.mix(textops.shingles(words, 3)[at] + text.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        rows.append(np.full(len(again), _REPEATED, np.int32))
        owner.append(text[again])
    lo, hi = int(texts.offsets[first]), int(texts.offsets[end])
    flat = texts.data[lo:hi].tobytes().decode("utf-8", "replace")
    chars = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    if len(chars):
        raw = texts.data[lo:hi]
        # code point index of each text's start: count the bytes that begin a character
        begins = np.zeros(hi - lo + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
        owner_of = np.repeat(np.arange(end - first, dtype=np.int32), np.diff(begins[texts.offsets[first : end + 1] - lo]))
        chars = chars.copy()
        space = (chars == 0x20) | ((chars >= 9) & (chars <= 13))
        chars[space] = 0x20
        h = chars[:-1] * _GRAM + chars[1:]
        inner = ~space[1:-1]
        for n in (3, 4):
            if len(chars) < n:
                break
            h = h[: len(chars) - n + 1] * _GRAM + chars[n - 1 :]
            if n == 4:
                inner = inner[:-1] & ~space[2:-1]
            keep = np.flatnonzero(inner & (owner_of[: len(h)] == owner_of[n - 1 :]))
            mixed = h[keep] * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            rows.append((mixed * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int32))
            owner.append(owner_of[keep])
    return np.concatenate(rows), np.concatenate(owner)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 6000, dim: int = 8, epochs: int = 5, rate: float = 2.0, seed: int = 1) -> Model:
    """Learn from at most ``most_rows`` labelled documents (those of smallest hash of their id), never from held-out ones.

    labels: doc_id and a column of 0 and 1; rows with null in either are not used, of repeated
    ids the largest label counts. Ties of the order go by doc_id, and rows are learned in an order of their own, so a table
    gives one model however it is dealt. Without both labels present, in an empty table too, the model is constant.
    """
    chosen = labels.where(~common.held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(F.broadcast(chosen), "doc_id")  # most_rows ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.Texts(batch.column(1))
            blobs = []
            for first, end in texts.groups(1 << 18):
                rows, owner = features(texts, first, end)
                key, n = np.unique(owner.astype(np.int64) << BITS | rows, return_counts=True)
                cut = np.searchsorted(key >> BITS, np.arange(end - first + 1))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    blobs.append((key[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes() + n[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], ["doc_id", "label", "counts"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["doc_id"], r["counts"]))
        model = descend([(np.frombuffer(r["counts"], "<u4").reshape(2, -1), r["label"]) for r in seen], dim, epochs, rate, seed)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.vectors, model.layer, model.bias)], ["vectors", "layer", "bias"])

    counted = sample.select("doc_id", "text", "label").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, counts binary")
    row = counted.repartition(1).mapInArrow(train, "vectors binary, layer binary, bias binary").first()
    read = lambda x: np.frombuffer(bytes(x), "<f4")
    return Model(read(row["vectors"]).reshape(-1, dim), read(row["layer"]).reshape(dim, 2), read(row["bias"]))


def descend(rows: list, dim: int, epochs: int, rate: float, seed: int) -> Model:
    """Stochastic gradient descent, one document a step, rate falling linearly to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    known = {y for _, y in rows}
    if len(known) < 2:
        bias[list(known) or [1]] = 2
        return Model(vectors * 0, layer, bias)
    rows = [(c[0].astype(np.int64), c[1] / max(1, c[1].sum(dtype=np.int64)), y) for c, y in rows]
    rows = [(i, w.astype(np.float32), y) for i, w, y in rows]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, w, y = rows[k]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[ids]
            hidden = w @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p).astype(np.float32)
            bias -= lr * np.float32(0.1) * p
            # an average spreads its gradient over all its rows; scaled back by their number it moves each by its share
            vectors[ids] = own - (lr * np.sqrt(np.float32(len(ids)))) * np.outer(w, back).astype(np.float32)
    return Model(vectors, layer, bias)


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """df with a column ``to`` double: the probability of label 1. Null and empty texts get the model's constant.

    Nothing but the text is read for the score; other columns and repeated rows stay as they
    are, a column of that name in df is replaced. Texts are read whole, in groups of about 1 MB or one longer text, so a task
    needs memory in proportion to its longest text. An empty table gives no row.
    """
    from pyspark.sql import types as T

    kept = df.drop(to)
    at = kept.columns.index(text)
    table, bias = model.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.Texts(batch.column(at))
            means = []
            for first, end in texts.groups():
                rows, owner = features(texts, first, end)
                total = np.bincount(owner, table[rows], end - first)
                means.append(total / np.maximum(np.bincount(owner, minlength=end - first), 1))
            logit = np.clip((np.concatenate(means) if means else np.zeros(0)) + bias, -40, 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-logit)))], [*batch.schema.names, to])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(to, T.DoubleType())]))
