"""Documents to packed training sequences: one operator a stage, each on what the last one kept.

Tables may be empty, texts of any length, and further columns have any names but those that begin with ``__``; all stages but the last hand them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import common, packing, quality, queries, secrets, simhash, substrings

#: Score below which the quality classifier rejects a document.
LEAST_QUALITY = 0.3
#: Words of a passage that counts as a repeated one.
PASSAGE_WORDS = 40


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, doesn't reject; texts unchanged.

    Null and empty texts get the model's constant score; repeated rows stay or go together; without both labels nothing is rejected.
    """
    model = quality.fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, to="__quality").where(F.col("__quality") >= LEAST_QUALITY).drop("__quality")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8) the document of smallest id.

    Null and empty texts are copies of one another; rows of that smallest id all stay, and so do rows without an id.
    """
    return simhash.deduplicate(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one holds.

    Null texts stay null; rows of one id don't take from one another; n_chars follows the text (null for a null one).
    """
    return _measured(substrings.remove(spark, docs, k=PASSAGE_WORDS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text masked; null and empty texts stay, n_chars follows the text."""
    return _measured(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, sources mixed in their proportions.

    A null text is its end token alone, a null source a queue of its own; repeated rows are packed each for themselves.
    """
    return packing.pack(spark, docs, queries.vocabulary("byte_bpe_50k.json"))


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.select(*[F.char_length("text").cast(kind).alias(c) if c == "n_chars" else c for c in docs.columns])


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: A learned classifier decides what stays, which SQL cannot express; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.durable(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
