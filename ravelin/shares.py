"""Additive shares modulo 2**32: a simulation of the data model, no protection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import MODULUS


def share(df: DataFrame, column: str, key: list[str], seed: int = 17) -> DataFrame:
    """Replace a column by column_1..3, whose sum modulo 2**32 it is. The shares follow from key and seed."""
    one = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(MODULUS))
    two = F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(MODULUS))
    three = F.pmod(F.col(column).cast("bigint") - one - two, F.lit(MODULUS))
    return df.select(*[c for c in df.columns if c != column], one.alias(f"{column}_1"), two.alias(f"{column}_2"), three.alias(f"{column}_3"))


def reconstruct(column: str) -> Column:
    return F.pmod(F.col(f"{column}_1") + F.col(f"{column}_2") + F.col(f"{column}_3"), F.lit(MODULUS))


def add(a: str, b: str, to: str) -> list[Column]:
    """Shares of a sum from the shares of its terms, each party by itself."""
    return [F.pmod(F.col(f"{a}_{i}") + F.col(f"{b}_{i}"), F.lit(MODULUS)).alias(f"{to}_{i}") for i in (1, 2, 3)]
