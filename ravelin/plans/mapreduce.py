"""MapReduce as a plan: rows -> (key, payload) -> one result for each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.partition import ROWS, by_slices
from ..profile import section


def mapreduce(rows: DataFrame, emit: Callable[[DataFrame], DataFrame], reduce: Callable[[DataFrame], DataFrame], partitions: int | None = None, key: str = "key", phases: bool = False) -> DataFrame:
    """``emit`` makes rows with a key, ``reduce`` groups them; what can be is combined before the exchange.

    partitions: deal the emissions to that many exact key-aligned slices first, for output that is ordered across files. A slice
    of very many rows is several tasks. ``reduce`` then finds a key's rows in one partition, PART.
    phases: write what each phase makes before the next one begins, in a profiled section that counts its rows;
    otherwise nothing runs until the result is asked for, but for what dealing to slices has to know.
    """
    if not phases:
        emitted = emit(rows)
        return reduce(by_slices(emitted, key, partitions, most=ROWS).drop("slice") if partitions else emitted)
    with section("map") as made:
        emitted = made.kept(emit(rows))
    if partitions:
        with section("partition", partitions) as made:
            emitted = made.kept(by_slices(emitted, key, partitions, kept=True, most=ROWS).drop("slice"))
    with section("reduce", partitions or 1) as made:
        return made.kept(reduce(emitted))
