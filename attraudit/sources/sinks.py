"""Result sinks: CSV and text tables, and per-model stage tables that can be resumed."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header, doubles rounded on request."""
    if digits is not None:
        df = df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
    df.write.mode("overwrite").csv(path, header=True)


def write_text(df: DataFrame, path: str, line: Column) -> None:
    """Summary lines of a small result table as one text file."""
    df.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_by_model(df: DataFrame, path: str, by: str = "model") -> None:
    """Replace only the partitions present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if there is no such path yet; a broken sink is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def missing_partitions(spark: SparkSession, wanted: DataFrame, path: str, by: str = "model") -> DataFrame:
    """Partition values not yet in the sink."""
    done = read_or_none(spark, path)
    return wanted if done is None else wanted.join(done.select(by).distinct(), by, "left_anti")


def pending(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not yet in the sink (S12); the key decides, not the position."""
    done = read_or_none(spark, path)
    return rows if done is None else rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All part tables as one, by column name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)
