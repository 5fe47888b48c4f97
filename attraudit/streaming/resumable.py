"""Resumable batch map with a dead-letter table.

Work is claimed by key: rows already in the sink or the dead-letter table are
skipped by an anti join. New input files can also be fed by a file stream with
an available-now trigger, whose checkpoint keeps track of the files done.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import pending


def map_with_errors(
    rows: DataFrame, key: str, inputs: str, make: Callable[[], Callable[[list], np.ndarray]], batch_size: int = 32
) -> DataFrame:
    """Apply a user's batch function (key, input) -> vector; failures become text.

    `make` builds the function once per task, which is where a model is loaded.
    A failing batch is retried row by row, so one bad row costs only itself.
    """
    schema = T.StructType([
        rows.schema[key], T.StructField("value", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        fn = make()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                ids, data = part[key].tolist(), part[inputs].tolist()
                try:
                    out = [(i, np.asarray(v, np.float32), None) for i, v in zip(ids, fn(data), strict=True)]
                except Exception:
                    out = []
                    for i, d in zip(ids, data):
                        try:
                            out.append((i, np.asarray(fn([d])[0], np.float32), None))
                        except Exception as e:
                            out.append((i, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=[key, "value", "error"])

    return rows.select(key, inputs).mapInPandas(run, schema)


def run_resumable(
    spark: SparkSession, rows: DataFrame, key: str, inputs: str, make: Callable, sink: str, dead: str, batch_size: int = 32
) -> None:
    """Process the rows that neither sink nor dead letters hold yet, then append.

    The mapped rows are written once, split by outcome into partitions of a stage
    folder beside the sink, and copied from there: no row's function runs again
    because a second table is written or an executor is lost afterwards.
    """
    todo = pending(spark, pending(spark, rows, sink, [key]), dead, [key])
    mapped = map_with_errors(todo, key, inputs, make, batch_size).withColumn("ok", F.col("error").isNull())
    stage = f"{sink.rstrip('/')}.stage-{uuid.uuid4().hex}"
    mapped.write.partitionBy("ok").parquet(stage)
    kept = spark.read.schema(mapped.schema).parquet(stage)
    kept.where("NOT ok").select(key, "error").write.mode("append").parquet(dead)
    kept.where("ok").select(key, "value").write.mode("append").parquet(sink)


def ingest_available(
    spark: SparkSession, source: str, schema: T.StructType, key: str, inputs: str, make: Callable, sink: str, dead: str, checkpoint: str
) -> None:
    """Process every new input file once and stop."""
    stream = spark.readStream.schema(schema).parquet(source)

    def each(batch: DataFrame, _id: int) -> None:
        run_resumable(batch.sparkSession, batch, key, inputs, make, sink, dead)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
