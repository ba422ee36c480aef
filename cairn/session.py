"""Session and scratch-folder helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairn")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="cairn-"))
        .getOrCreate()
    )


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a master that is this machine gets a temporary folder; a cluster gets an error, since a
    folder of one machine is no shared one.
    """
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="cairn-"))
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is run inside once it has ended, instead of when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # for discard
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``materialise`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        path = getattr(table, "_scratch", None) if table is not None else None
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan, dealt out over all cores if its files have fewer splits than these. Such a table is small, so its rows move for next
    to nothing; one with more splits is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def broadcast_if_small(df: DataFrame, max_rows: int):
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; otherwise as it is, to be joined by a shuffle.

    The rows are counted, so pass a table that is cheap to read twice.
    """
    small = len(df.limit(max_rows + 1).select(F.lit(1)).take(max_rows + 1)) <= max_rows if max_rows < 1000 else df.count() <= max_rows
    return F.broadcast(df) if small else df
