"""Shared helpers of the corpus operators: stored tables, null-safe keys, checked broadcasts."""
from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST_ROWS = 200_000  # a join side is broadcast only when a count has shown it to be no longer


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from the files: lineage ends there.

    `batch_rows`: tasks hand Python so many rows at a time, where the session allows more. For whole texts: a batch is held on both sides.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(ARROW_ROWS)
    fewer = batch_rows is not None and not 0 < int(before) <= batch_rows
    try:
        if fewer:
            spark.conf.set(ARROW_ROWS, str(batch_rows))
        df.write.parquet(path)
    finally:
        if fewer:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def tidy(work):
    """Let a task's generator hand its memory back when it ends: workers are used again and would keep their peak."""
    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a (stored) side if counting proves it short; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
