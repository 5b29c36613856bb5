"""Session defaults, the shared work folder and size checks used before broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A lookup table above this many rows is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000

_local_folders: dict[str, str] = {}


def get_spark(app_name: str = "logtide", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC time; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint setting, a local one only if unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="logtide-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), "logtide", f"{name}-{uuid.uuid4().hex[:12]}")


def pinned(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and fixes row placement, surviving lost executors."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a reusable, pruned-column intermediate."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """Rows of a small file dealt to as many tasks as a shuffle has, where a scan would give fewer than there are cores."""
    spark = frame.sparkSession
    if frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return frame
    return frame.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def rows_at_most(frame: DataFrame, bound: int) -> bool:
    """Size check that never reads more than `bound + 1` rows into the count."""
    return frame.limit(bound + 1).count() <= bound


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for what runs inside: few where a row holds a block of numbers or a slice of a file."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
