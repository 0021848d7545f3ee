"""Data model: sentinels, schemas, column visibility and its audited disclosure.

Visibility is bookkeeping in the schema. One Spark cluster is one party: nothing here
protects data from whoever runs the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The padding term, the distance of unreachable vertices, the size of the number domain.
PAD = 0
INF = 2147483647
MODULUS = 2**32

VECTORS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType()))])
EDGE = T.StructType([T.StructField("dst", T.LongType()), T.StructField("w", T.LongType())])
GRAPH = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("edges", T.ArrayType(EDGE))])
STATE = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("state", T.LongType())])

_KEY = "visibility"


@dataclass
class Audit:
    """Every disclosure, in order."""

    entries: list[tuple[tuple[str, ...], str]] = field(default_factory=list)


def classify(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mark columns private."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={_KEY: "private"}) if c in columns else F.col(f"`{c}`") for c in df.columns])


def private_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get(_KEY) == "private"]


def carry(source: DataFrame, result: DataFrame, origin: dict[str, list[str]]) -> DataFrame:
    """Mark result columns private that come from a private column of source (expressions and aggregates lose the mark)."""
    secret = set(private_columns(source))
    return classify(result, [c for c, parts in origin.items() if secret & set(parts)])


def declassify(df: DataFrame, columns: list[str], reason: str, audit: Audit) -> DataFrame:
    """Make private columns public; recorded. A column that isn't private is an error."""
    wrong = set(columns) - set(private_columns(df))
    if wrong:
        raise ValueError(f"not private: {sorted(wrong)}")
    audit.entries.append((tuple(columns), reason))
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={}) if c in columns else F.col(f"`{c}`") for c in df.columns])


def publish(df: DataFrame, name: str) -> dict:
    """A one-row public result as {name: value}; a private column in it is an error."""
    if private_columns(df):
        raise ValueError(f"private columns: {private_columns(df)}")
    rows = df.take(2)
    if len(rows) != 1 or len(df.columns) != 1:
        raise ValueError("one row of one column is published")
    return {name: rows[0][0]}


def wrap32(column):
    """A sum or difference in the domain of unsigned 32-bit numbers."""
    return F.pmod(column, F.lit(MODULUS))
