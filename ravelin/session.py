"""A session with the settings the engine relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "ravelin", elastic: tuple[int, int] | None = None, **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC and adaptive execution on; further settings by keyword with dots as double underscores.

    elastic: (least, most) executors of a cluster that grows when tasks wait and gives executors back after a minute idle.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if elastic:  # executors come and go with the work, between the two bounds
        least, most = elastic
        settings |= {"spark.dynamicAllocation.enabled": "true", "spark.dynamicAllocation.shuffleTracking.enabled": "true", "spark.dynamicAllocation.minExecutors": str(least), "spark.dynamicAllocation.maxExecutors": str(most), "spark.dynamicAllocation.executorIdleTimeout": "60s"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "ravelin-shared")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Tables of this process that go when it ends, by application.
_SCRATCH: dict[str, set[str]] = {}


def _own(spark: SparkSession) -> set[str]:
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = set()
        atexit.register(_clean_at_end, spark)
    return _SCRATCH[app]


def scratch_folder(spark: SparkSession, name: str = "scratch") -> str:
    """A path of its own in the shared folder; what is written there goes when the process ends with its session alive, or by clean_scratch."""
    _own(spark)
    return f"{shared_folder(spark)}/ravelin-scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession) -> str:
    """The name of a table that no one else has; it goes as scratch folders do."""
    name = f"ravelin_{uuid.uuid4().hex}"
    _own(spark).add(name)
    return name


def drop_scratch(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _own(spark).discard(name)


def clean_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables and folders of this application: once the results are written, nothing reads them."""
    drop_scratch(spark, *list(_own(spark)))
    delete_folder(spark, f"{shared_folder(spark)}/ravelin-scratch-{spark.sparkContext.applicationId}")


def _clean_at_end(spark: SparkSession) -> None:
    if spark.sparkContext._jsc:
        try:
            clean_scratch(spark)
        except (Py4JError, OSError):  # the JVM ended first
            pass
