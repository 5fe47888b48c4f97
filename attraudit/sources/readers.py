"""Scans of the input tables with declared schemas."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import labels_schema, report_labels_schema, units_schema


def read_units(spark: SparkSession, path: str, flags: Sequence[str] = (), findings: Sequence[str] = ()) -> DataFrame:
    """Unit metadata from CSV with the 0/1 sex flag derived."""
    df = spark.read.schema(units_schema(flags, findings)).csv(path, header=True)
    return df.withColumn("gender_binary", (F.col("gender") == "M").cast("int"))


def read_labels(spark: SparkSession, path: str, findings: Sequence[str]) -> DataFrame:
    """Raw ternary labels from CSV, long: (entity_id, study_id, finding, raw)."""
    df = spark.read.schema(labels_schema(findings)).csv(path, header=True)
    return df.unpivot(["entity_id", "study_id"], list(findings), "finding", "raw")


def read_gzip_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """A few columns of gzip CSV files (S3).

    Gzip does not split, so one file is one task: spread the rows right after
    the scan, and write them to Parquet if they are read again.
    """
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False).select(*columns)
    return df.repartition(partitions) if partitions else df


def load_table(spark: SparkSession, path: str, schema: T.StructType, target: str) -> DataFrame:
    """Bulk load of a CSV table with declared types; empty fields are null."""
    spark.read.schema(schema).option("nullValue", "").csv(path, header=True, enforceSchema=False).write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def read_report_labels(
    spark: SparkSession, path: str, findings: Sequence[str], key: str = "path_to_image", wanted: DataFrame | None = None
) -> DataFrame:
    """JSON-lines labels keyed by unit, long; optionally only the wanted ids."""
    schema = T.StructType([T.StructField(key, T.StringType())] + report_labels_schema(findings).fields[1:])
    df = spark.read.schema(schema).json(path).withColumnRenamed(key, "unit_id").where(F.col("unit_id").isNotNull())
    if wanted is not None:
        df = df.join(wanted.select("unit_id"), "unit_id", "left_semi")
    return df.unpivot(["unit_id"], list(findings), "finding", "raw")


def all_missing(labels: DataFrame) -> DataFrame:
    """Number of units without any label: the warning of a filtered label scan."""
    per = labels.groupBy("unit_id").agg(F.count("raw").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("n") == 0).alias("n_all_missing"))


def read_embeddings(spark: SparkSession, path: str, models: Sequence[str] | None = None, units: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Embeddings partitioned by model; only the named models are scanned."""
    from ..operators.cohort import align

    df = spark.read.parquet(path)
    if models is not None:
        df = df.where(F.col("model").isin(*models))
    return df if units is None else align(units.select("unit_id"), df, strict)


#: Column types of result tables that later studies read again.
RESULTS = {
    "cells": "model string, attribute string, attribute_type string, disease string, auroc_baseline double, auroc_residualized double, auroc_drop double",
    "odds": "attribute string, disease string, odds_ratio double, log_or double, abs_log_or double",
    "geometry": "model string, domain string, training_signal string, ambient_dim int, effective_rank double, stable_rank double, participation_ratio double, isotropy_ratio double",
}


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A stored table of cells, odds ratios or geometry with its declared types.

    Columns are found by name; those the file doesn't have are null, others are left out.
    """
    names = spark.read.csv(path, header=True).columns
    declared = {f.name: f.dataType for f in T._parse_datatype_string(RESULTS[kind]).fields}
    schema = T.StructType([T.StructField(n, declared.get(n, T.StringType())) for n in names])
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*[F.col(n) if n in names else F.lit(None).cast(t).alias(n) for n, t in declared.items()])


def available_models(embeddings: DataFrame) -> DataFrame:
    """Models that have rows (S17); on a partitioned table this reads directory names only."""
    return embeddings.select("model").distinct()


def keep_existing(units: DataFrame, listing: DataFrame, path: str = "img_path") -> DataFrame:
    """Units whose file is in a directory listing.

    The listing comes from `list_files`; no file content is read.
    """
    return units.join(listing.select(F.col("path").alias(path)), path, "left_semi")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Relative paths below a folder, by the binary file source without its content column."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    prefix = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    full = F.regexp_replace("path", "^file:/+", "/")
    return df.select(F.when(full.startswith(prefix), F.substr(full, F.lit(len(prefix) + 1))).otherwise(full).alias("path"))
