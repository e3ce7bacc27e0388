"""Session settings and the shared folders a job may write to."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "barline") -> SparkSession:
    """A session for tests and single-node runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BARLINE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what result values depend on: all clock arithmetic is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, laptops) a temporary folder is chosen.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
        current = sc.getCheckpointDir()
    return configured or current


_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    """Take away the tables that this session has written for itself."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is over; the folder's owner clears it
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table a job writes and reads again."""
    path = f"{shared_dir(spark).rstrip('/')}/barline-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)  # runs before the session's own end
    _WRITTEN.append((spark, path))
    return path


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Needed where later steps rely on how rows were placed (row sequence numbers
    of a range partitioning), which a re-run task must not see differently, and
    where an intermediate result is read several times.  Parquet keeps later
    reads prunable; a lost executor costs nothing but re-reading files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
