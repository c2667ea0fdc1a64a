"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting (from 4.1 on, without effect before) by which shuffle files go at the end of an action.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python together; the engine's 10,000 are too many where a row is megabytes.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "probita", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings this library is written for.

    On a cluster the master, memory and checkpoint folder come from the submit command; only
    settings that change results or plans are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and master and executors are one machine
    (tests) is a temporary folder made, once per session; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    return spark.sparkContext.getCheckpointDir() or _own_folder(spark)


def _own_folder(spark: SparkSession) -> str:
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="probita-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table or a stream checkpoint."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session while the block runs; it is put back after it."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def released(df: DataFrame) -> DataFrame:
    """``df`` for a single action, at whose end the engine drops the shuffle files that the action wrote.

    Otherwise they stay until the driver happens to collect its garbage, all steps' files at once. A second action on
    the same frame would be right but shuffle anew. The setting counts when a frame is made, so it is put back at once.
    """
    with setting(df.sparkSession, RELEASE, "true"):
        return df.select("*")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor never replays the rounds before it; its shuffle files go."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return released(df).checkpoint(eager=True)
