"""Sources and sinks as round trips: the given tables are written in a format and read back."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attraudit.functions.labels import Aliases
from attraudit.operators import cohort
from attraudit.plans.inputs import build_cohort
from attraudit.session import ensure_checkpoint_dir
from attraudit.sources import readers, sinks
from attraudit.streaming.resumable import run_resumable

from .base import FINDINGS, UNITS_SQL, labelled_sql, query, r, read, units

U = f"WITH {UNITS_SQL}"
_LONG_SQL = " UNION ALL ".join(f"SELECT unit_id, entity_id, '{f}' AS finding, {f} AS raw FROM units" for f in FINDINGS)


def folder(spark, name: str) -> str:
    """A new folder where all executors can write."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def metadata(spark, sf):
    """The units in the layout of the metadata file."""
    return units(spark, sf).select(
        F.col("unit_id").cast("string").alias("unit_id"), "entity_id", F.col("unit_id").alias("study_id"),
        F.concat(F.lit("p"), F.col("entity_id"), F.lit("/"), F.col("unit_id"), F.lit(".jpg")).alias("img_path"),
        F.when(F.col("building") == 1, "M").otherwise("F").alias("gender"), "age", F.col("balance").alias("bmi"),
        F.col("stratum").alias("view"), F.lit("train").alias("split"), "in_debt", *FINDINGS)


@query("source_units_csv", f"""{U} SELECT unit_id::VARCHAR AS unit_id, entity_id, building AS gender_binary, {r('age', 'age')}, in_debt, {', '.join(FINDINGS)} FROM units""")
def source_units_csv(spark, sf):
    path = folder(spark, "units")
    sinks.write_csv(metadata(spark, sf), path)
    return readers.read_units(spark, path, ["in_debt"], FINDINGS).select("unit_id", "entity_id", "gender_binary", "age", "in_debt", *FINDINGS)


@query("sink_rounded_csv", """SELECT c_custkey, round(c_acctbal / 7, 3) + 0.0::DOUBLE AS share FROM customer""")
def sink_rounded_csv(spark, sf):
    path = folder(spark, "rounded")
    sinks.write_csv(read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("share")), path, digits=3)
    return spark.read.schema("c_custkey long, share double").csv(path, header=True)


@query("source_labels_csv", f"{U} SELECT entity_id, unit_id AS study_id, finding, raw FROM ({_LONG_SQL})")
def source_labels_csv(spark, sf):
    path = folder(spark, "labels")
    sinks.write_csv(units(spark, sf).select("entity_id", F.col("unit_id").alias("study_id"), *FINDINGS), path)
    return readers.read_labels(spark, path, FINDINGS)


@query("source_gzip_csv", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def source_gzip_csv(spark, sf):
    path, o = folder(spark, "gzip"), read(spark, sf, "orders")
    o.write.option("compression", "gzip").csv(path, header=True)
    return readers.read_gzip_csv(spark, path, o.schema, ["o_custkey", "o_orderstatus"], 8).groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("source_bulk_load", f"SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN {r('c_acctbal', 'x').split(' AS ')[0]} END AS balance FROM customer")
def source_bulk_load(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    path = folder(spark, "load")
    sinks.write_csv(df, path)
    return readers.load_table(spark, path, df.schema, folder(spark, "table"))


def _json_labels(spark, sf):
    path = folder(spark, "json")
    u = units(spark, sf)
    u.select(F.col("unit_id").cast("string").alias("path_to_image"), *FINDINGS).write.json(path)
    return path, u.where("in_debt = 1").select(F.col("unit_id").cast("string").alias("unit_id"))


@query("source_report_labels", f"{U}, l AS ({_LONG_SQL}) SELECT unit_id::VARCHAR AS unit_id, finding, raw FROM l JOIN units USING (unit_id) WHERE in_debt = 1")
def source_report_labels(spark, sf):
    path, wanted = _json_labels(spark, sf)
    return readers.read_report_labels(spark, path, FINDINGS, wanted=wanted)


@query("source_all_missing", f"{U} SELECT count(*) AS n_units, count(*) FILTER (WHERE urgent IS NULL) AS n_all_missing FROM units WHERE in_debt = 1")
def source_all_missing(spark, sf):
    path, wanted = _json_labels(spark, sf)
    return readers.all_missing(readers.read_report_labels(spark, path, ["urgent"], wanted=wanted))


def _models(spark, sf):
    """Two models' vectors, one of them written twice."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), "embedding")
    path = folder(spark, "by_model")
    both = e.withColumn("model", F.lit("a")).unionByName(e.withColumn("model", F.lit("b")))
    sinks.write_by_model(both, path)
    sinks.write_by_model(e.select("unit_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit("b").alias("model")), path)
    return e, path


@query("source_embeddings_strict", """SELECT 'b' AS model, vec_id::VARCHAR AS unit_id, len(embedding)::INTEGER AS width, round(-embedding[1]::DOUBLE, 5) + 0.0::DOUBLE AS first
FROM embeddings WHERE vec_id % 2 = 0""", digits=5)
def source_embeddings_strict(spark, sf):
    e, path = _models(spark, sf)
    got = readers.read_embeddings(spark, path, ["b"], e.where("cast(unit_id as long) % 2 = 0"), strict=True)
    return got.select("model", "unit_id", F.size("embedding").alias("width"), F.col("embedding")[0].cast("double").alias("first"))


@query("source_available_models", "SELECT m.model, count(*) AS n FROM embeddings, (SELECT unnest(['a', 'b']) AS model) m GROUP BY m.model")
def source_available_models(spark, sf):
    _, path = _models(spark, sf)
    stored = readers.read_embeddings(spark, path)
    return readers.available_models(stored).join(stored.groupBy("model").agg(F.count("*").alias("n")), "model")


@query("sink_missing_partitions", "SELECT DISTINCT n_name AS model FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def sink_missing_partitions(spark, sf):
    path = folder(spark, "nations")
    n = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("model"))
    c = read(spark, sf, "customer").where("c_acctbal < 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    sinks.write_by_model(c.select("c_custkey", "model"), path)
    return sinks.missing_partitions(spark, n.select("model"), path)


@query("source_keep_existing", "SELECT c_custkey, 'segment=' || c_mktsegment AS img_path FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 3)")
def source_keep_existing(spark, sf):
    path, c = folder(spark, "files"), read(spark, sf, "customer")
    c.where("c_nationkey = 3").select("c_custkey", F.col("c_mktsegment").alias("segment")).write.partitionBy("segment").json(path)
    listing = readers.list_files(spark, path, "*.json").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    return readers.keep_existing(c.select("c_custkey", F.concat(F.lit("segment="), F.col("c_mktsegment")).alias("img_path")), listing)


@query("sink_merge_parts", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS o_custkey FROM orders")
def sink_merge_parts(spark, sf):
    o, paths = read(spark, sf, "orders"), [folder(spark, "part") for _ in range(2)]
    o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").write.parquet(paths[0])
    o.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderstatus", "o_orderkey").write.parquet(paths[1])
    return sinks.merge_parts(spark, paths).select("o_orderkey", "o_orderstatus", "o_custkey")


@query("sink_text_lines", "SELECT o_orderstatus || ': ' || count(*) || ' orders' AS value FROM orders GROUP BY o_orderstatus")
def sink_text_lines(spark, sf):
    path = folder(spark, "text")
    counts = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sinks.write_text(counts, path, F.format_string("%s: %d orders", "o_orderstatus", "n"))
    return spark.read.text(path)


def _make():
    def run(batch):
        if any(v < 0 for v in batch):
            raise ValueError("negative")
        return [np.array([v, 2 * v], np.float32) for v in batch]
    return run


@query("resumable_map", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(2 * c_acctbal::FLOAT::DOUBLE, 1) + 0.0::DOUBLE END AS twice,
CASE WHEN c_acctbal < 0 THEN 'ValueError: negative' END AS error FROM customer""", digits=1)
def resumable_map(spark, sf):
    sink, dead = folder(spark, "sink"), folder(spark, "dead")
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    run_resumable(spark, c.where("c_custkey % 3 = 0"), "c_custkey", "c_acctbal", _make, sink, dead)
    run_resumable(spark, c, "c_custkey", "c_acctbal", _make, sink, dead)
    done = spark.read.parquet(sink).select("c_custkey", F.col("value")[1].cast("double").alias("twice"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(spark.read.parquet(dead).select("c_custkey", F.lit(None).cast("double").alias("twice"), "error"))


@query("labels_by_composite_key", f"{U}, {labelled_sql('zero')} SELECT unit_id, entity_id, {', '.join(FINDINGS)} FROM lab")
def labels_by_composite_key(spark, sf):
    u = units(spark, sf).withColumn("study_id", F.col("unit_id"))
    labels = u.select("entity_id", "study_id", *FINDINGS).unpivot(["entity_id", "study_id"], FINDINGS, "finding", "raw")
    emb = u.select(F.lit("a").alias("model"), "unit_id")
    return build_cohort(emb, u, FINDINGS, policy="zero", labels=labels).select("unit_id", "entity_id", *FINDINGS)


@query("train_zscore_eps", """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0)) /
((SELECT stddev_pop(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0) + 1000), 6) + 0.0::DOUBLE AS z FROM orders""")
def train_zscore_eps(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return cohort.zscore(o, "o_totalprice", F.col("o_orderkey") % 2 == 0, "z", eps=1000.0).select("o_orderkey", "z")


@query("alias_columns", f"{U} SELECT building AS sex, count(*) AS n FROM units GROUP BY ALL")
def alias_columns(spark, sf):
    u = units(spark, sf).withColumnRenamed("building", "gender_binary")
    return u.groupBy(F.col(Aliases().resolve("sex")).alias("sex")).agg(F.count("*").alias("n"))


@query("source_result_tables", """WITH c AS (SELECT 'a' AS model, c_mktsegment AS attribute, n_name AS disease, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT model, attribute, disease, round(v / 1000, 6) + 0.0::DOUBLE AS auroc_drop, round(v / 500, 6) + 0.0::DOUBLE AS abs_log_or, round(v / 100, 6) + 0.0::DOUBLE AS effective_rank FROM c""")
def source_result_tables(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.groupBy(F.col("c_mktsegment").alias("attribute"), F.col("n_name").alias("disease")).agg(F.avg("c_acctbal").alias("v"))
    cells, odds, geometry = folder(spark, "cells"), folder(spark, "odds"), folder(spark, "geometry")
    sinks.write_csv(v.select(F.lit("a").alias("model"), "attribute", "disease", (F.col("v") / 1000).alias("auroc_drop")), cells)
    sinks.write_csv(v.select("attribute", "disease", (F.col("v") / 500).alias("abs_log_or")), odds)
    sinks.write_csv(v.select(F.concat_ws("|", "attribute", "disease").alias("model"), (F.col("v") / 100).alias("effective_rank")), geometry)
    g = readers.read_result(spark, geometry, "geometry").select(
        F.split("model", "[|]")[0].alias("attribute"), F.split("model", "[|]")[1].alias("disease"), "effective_rank")
    joined = readers.read_result(spark, cells, "cells").join(readers.read_result(spark, odds, "odds").drop("odds_ratio", "log_or"), ["attribute", "disease"])
    return joined.join(g, ["attribute", "disease"]).select("model", "attribute", "disease", "auroc_drop", "abs_log_or", "effective_rank")
