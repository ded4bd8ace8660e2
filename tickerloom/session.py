"""Session defaults and the durable folder that plans may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the plans are tuned for.  A cluster session normally sets its own
# parallelism; these only say which adaptive features the plans lean on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folder of the innermost ``released`` block, if any.
_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tickerloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with the executor that wrote it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        folder = spark.conf.get("tickerloom.local.scratch", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="tickerloom-")
            spark.conf.set("tickerloom.local.scratch", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the folder of the ``released`` block around the call."""
    return f"{_run_folder.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[str]:
    """Removes on leaving, also by an error, all tables that plans built inside have pinned.

    Build a plan and write its result inside the block; a frame built inside
    must not be read after it.  The tables lie in one folder below the shared
    one, whose path is returned; a nested block removes its own only.
    Callbacks of streams run outside the block.
    """
    folder = scratch_path(spark, "run")
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that begins in this block go as soon as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later branches then all see the same rows and chunk numbers, also after an
    executor is lost, and read only the columns they need.  What was shuffled
    for the table is not kept beside it.
    """
    return _stored(df, scratch_path(df.sparkSession, "pinned"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def lent(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` pinned for this block only: what is read after it must be pinned in it."""
    path = scratch_path(df.sparkSession, "lent")
    try:
        yield _stored(df, path)
    finally:
        _remove(df.sparkSession, path)
