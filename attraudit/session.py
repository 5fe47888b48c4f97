"""Session defaults shared by tests, the bench and user jobs."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT_ROWS = 100_000  # a join side is broadcast only when a count has shown it to be no longer


def local_session(cores: int | str = 8, app: str = "attraudit") -> SparkSession:
    """A local session with the settings the operators expect from a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a fresh one is made only where none is set."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    target = current or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(target)
    return target


def materialize(df: DataFrame) -> DataFrame:
    """Write a table once to the checkpoint folder and go on from there.

    Used where a computed table is read several times or joined to itself by
    value, so that a lost executor cannot bring back slightly different floats.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(*loops: Callable) -> list:
    """Results of driver loops that don't depend on each other, run side by side: each waits for many short jobs."""
    target = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(loops)) as pool:
        running = [pool.submit(target(f)) for f in loops]
        return [r.result() for r in running]


def short(df: DataFrame) -> DataFrame:
    """A table of one row per key, stored, and broadcast if it proves short: rows joined to it stay where they are, however frequent a key is."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.limit(SHORT_ROWS + 1).count() <= SHORT_ROWS else kept
