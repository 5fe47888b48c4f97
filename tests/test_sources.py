"""Readers, sinks and the resumable map."""
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attraudit.schema import ADMISSIONS, EMBEDDINGS
from attraudit.sources import readers, sinks
from attraudit.streaming.resumable import ingest_available, map_with_errors, run_resumable


def test_units_and_labels(spark, tmp_path):
    u = tmp_path / "u.csv"
    u.write_text("unit_id,entity_id,study_id,img_path,gender,age,bmi,view,split,hf,Edema\nd1,1,10,a/b.jpg,M,61,,AP,train,1,-1\nd2,2,20,c.jpg,F,,22.5,PA,test,0,\n")
    rows = readers.read_units(spark, str(u), ["hf"], ["Edema"]).orderBy("unit_id").collect()
    assert [r["gender_binary"] for r in rows] == [1, 0] and rows[0]["bmi"] is None and rows[1]["Edema"] is None
    l = tmp_path / "l.csv"
    l.write_text("entity_id,study_id,Edema,Pneumonia\n1,10,1.0,\n2,20,-1.0,0.0\n")
    got = {(r["entity_id"], r["finding"]): r["raw"] for r in readers.read_labels(spark, str(l), ["Edema", "Pneumonia"]).collect()}
    assert got == {(1, "Edema"): 1.0, (1, "Pneumonia"): None, (2, "Edema"): -1.0, (2, "Pneumonia"): 0.0}


def test_gzip_scan_and_bulk_load(spark, tmp_path):
    p = tmp_path / "adm.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("subject_id,hadm_id,admittime,race\n1,5,2180-01-01 10:00:00,WHITE\n2,6,,\n")
    df = readers.read_gzip_csv(spark, str(p), ADMISSIONS, ["subject_id", "race"], 2)
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "WHITE"), (2, None)]
    t = readers.load_table(spark, str(p), ADMISSIONS, str(tmp_path / "t"))
    assert t.where("admittime IS NULL").count() == 1 and t.schema["subject_id"].dataType == ADMISSIONS["subject_id"].dataType


def test_report_labels(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text("\n".join(json.dumps(r) for r in [{"path_to_image": "a", "Edema": 1.0}, {"path_to_image": "b"}, {"path_to_image": "c", "Edema": 0.0}]))
    wanted = spark.createDataFrame([("a",), ("b",)], "unit_id string")
    l = readers.read_report_labels(spark, str(p), ["Edema", "Fracture"], wanted=wanted)
    assert l.count() == 4
    assert tuple(readers.all_missing(l).first()) == (2, 1)


def test_partitioned_embeddings_and_sinks(spark, tmp_path):
    path = str(tmp_path / "emb")
    df = spark.createDataFrame([("m1", "a", [1.0]), ("m2", "a", [2.0]), ("m2", "b", [3.0])], EMBEDDINGS)
    sinks.write_by_model(df, path)
    sinks.write_by_model(spark.createDataFrame([("m1", "a", [9.0])], EMBEDDINGS), path)
    got = readers.read_embeddings(spark, path)
    assert got.count() == 3 and got.where("model = 'm1'").first()["embedding"] == [9.0]
    assert {r[0] for r in readers.available_models(got).collect()} == {"m1", "m2"}
    plan = readers.read_embeddings(spark, path, ["m1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "model" in plan.split("PartitionFilters: [")[1][:60]
    wanted = spark.createDataFrame([("m1",), ("m3",)], "model string")
    assert [r[0] for r in sinks.missing_partitions(spark, wanted, path).collect()] == ["m3"]
    assert sinks.missing_partitions(spark, wanted, str(tmp_path / "none")).count() == 2
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, path, units=spark.createDataFrame([("zz",)], "unit_id string"), strict=True)


def test_csv_text_and_listing(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(0.12345678,)], "v double"), str(tmp_path / "c"), 6)
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["v"] == "0.123457"
    sinks.write_text(spark.range(2), str(tmp_path / "t"), F.format_string("row %d", "id"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"row 0", "row 1"}
    img = tmp_path / "img" / "p1"
    img.mkdir(parents=True)
    (img / "a.jpg").write_bytes(b"x")
    listing = readers.list_files(spark, str(tmp_path / "img"), "*.jpg")
    units = spark.createDataFrame([("1", "p1/a.jpg"), ("2", "p1/b.jpg")], "unit_id string, img_path string")
    assert [r["unit_id"] for r in readers.keep_existing(units, listing).collect()] == ["1"]


def maker():
    """A user batch function, built inside a call so that workers get it by value."""
    def make():
        def run(batch):
            if any(v < 0 for v in batch):
                raise ValueError("negative")
            return [np.array([v, v * 2], np.float32) for v in batch]
        return run
    return make


def test_failed_batch_is_retried_by_row(spark):
    rows = spark.createDataFrame([(i, float(i - 3)) for i in range(10)], "unit_id int, v double").coalesce(1)
    got = map_with_errors(rows, "unit_id", "v", maker(), 4).collect()
    assert len(got) == 10
    assert {r["unit_id"] for r in got if r["error"]} == {0, 1, 2}
    assert [r["value"] for r in got if r["unit_id"] == 5] == [[2.0, 4.0]]


def test_resume_by_key(spark, tmp_path):
    sink, dead = str(tmp_path / "s"), str(tmp_path / "d")
    rows = spark.createDataFrame([(i, float(i - 1)) for i in range(6)], "unit_id int, v double")
    run_resumable(spark, rows.where("unit_id < 4"), "unit_id", "v", maker(), sink, dead)
    run_resumable(spark, rows, "unit_id", "v", maker(), sink, dead)
    done = [r["unit_id"] for r in spark.read.parquet(sink).collect()]
    assert sorted(done) == [1, 2, 3, 4, 5]
    assert [r["unit_id"] for r in spark.read.parquet(dead).collect()] == [0]


def test_available_now_ingest(spark, tmp_path):
    src, sink, dead, cp = (str(tmp_path / n) for n in ("src", "s", "d", "cp"))
    rows = spark.createDataFrame([(i, float(i)) for i in range(4)], "unit_id int, v double")
    rows.where("unit_id < 2").write.mode("append").parquet(src)
    ingest_available(spark, src, rows.schema, "unit_id", "v", maker(), sink, dead, cp)
    rows.where("unit_id >= 2").write.mode("append").parquet(src)
    ingest_available(spark, src, rows.schema, "unit_id", "v", maker(), sink, dead, cp)
    assert sorted(r["unit_id"] for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3]
