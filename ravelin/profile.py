"""Named sections with what ran in them: time, jobs, tasks and shuffled bytes, and row counts taken in passing.

The jobs that a section starts carry a tag of its own; when it ends, the session's status store is asked
what they did. So a section says nothing about plans that were only built in it: what is timed
is written, or counted, inside.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoints


class Section(NamedTuple):
    name: str
    n: int
    seconds: float
    rows: int | None = None
    jobs: int = 0
    tasks: int = 0
    task_seconds: float = 0.0
    shuffle_written: int = 0
    shuffle_read: int = 0


#: The last sections, oldest first.
SECTIONS: deque[Section] = deque(maxlen=10_000)


@dataclass
class Open:
    """A section that hasn't ended."""

    observed: list[Observation] = field(default_factory=list)

    def seen(self, df: DataFrame) -> DataFrame:
        """df, whose rows the section counts as they are computed."""
        out, seen = counted(df, f"rows-{uuid.uuid4().hex}")
        self.observed.append(seen)
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """df computed now and kept in the checkpoint folder, its rows counted."""
        ensure_checkpoints(df.sparkSession)
        return self.seen(df).checkpoint()


@contextmanager
def section(name: str, n: int = 1) -> Iterator[Open]:
    """Record a Section however the block ends. Jobs started by other threads are not its own."""
    spark = SparkSession.getActiveSession()
    tag, made = f"ravelin-{uuid.uuid4().hex}", Open()
    began = time.perf_counter()
    if spark:
        spark.sparkContext.addJobTag(tag)
    try:
        yield made
    finally:
        seconds = time.perf_counter() - began
        ran: tuple = ()
        if spark and spark.sparkContext._jsc:
            spark.sparkContext.removeJobTag(tag)
            ran = _ran(spark, tag)
        rows = sum(o.get["rows"] for o in made.observed) if made.observed and ran and ran[0] else None
        SECTIONS.append(Section(name, n, seconds, rows, *ran))


def _ran(spark: SparkSession, tag: str) -> tuple[int, int, float, int, int]:
    """(jobs, tasks, seconds of tasks, bytes written to shuffles, bytes read from them) of what ran under a tag."""
    context = spark.sparkContext._jsc.sc()
    with suppress(Py4JJavaError):  # not told in time: what the store has by now
        context.listenerBus().waitUntilEmpty(10_000)
    store, tracker = context.statusStore(), context.statusTracker()
    jobs = list(tracker.getJobIdsForTag(tag))
    stages = {i for j in jobs if (info := tracker.getJobInfo(j)).isDefined() for i in info.get().stageIds()}
    tasks = seconds = written = read = 0
    for i in stages:
        try:
            data = store.lastStageAttempt(i)
        except Py4JJavaError:  # it was skipped, or the store keeps no more of it
            continue
        tasks += data.numCompleteTasks()
        seconds += data.executorRunTime() / 1000
        written += data.shuffleWriteBytes()
        read += data.shuffleReadBytes()
    return len(jobs), tasks, seconds, written, read


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df and an observation whose ``rows`` is known after the first action on it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
