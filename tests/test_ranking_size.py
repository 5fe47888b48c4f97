"""AUROC in as many tasks as the rows fill."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from attraudit.operators import ranking


@pytest.mark.parametrize("rows_a_task", [50, 1 << 19])
def test_area_by_size_equals_the_plain_one(spark, rows_a_task):
    rng = np.random.default_rng(4)
    p = np.where(rng.random(3000) < 0.4, 0.5, np.round(rng.random(3000), 3))  # one value fills several buckets
    rows = [
        (None if i % 50 == 0 else f"c{i % 3}", None if i % 41 == 0 else float(p[i]), None if i % 31 == 0 else int(rng.random() < p[i])) for i in range(3000)
    ] + [("one", 0.1, 1), ("one", 0.2, 1)]
    df = spark.createDataFrame(rows, "c string, p double, y int")
    want = {r["c"]: r for r in ranking.auroc(df.where("c IS NOT NULL"), ["c"]).collect()}
    got = {r["c"]: r for r in ranking.auroc_by_size(df, ["c"], 3000, rows_a_task=rows_a_task).collect()}
    assert set(got) == {*want, None} and got["one"]["auroc"] is None
    for c, r in want.items():
        assert (got[c]["n"], got[c]["n_pos"]) == (r["n"], r["n_pos"])
        assert got[c]["auroc"] == (None if r["auroc"] is None else pytest.approx(r["auroc"], abs=1e-12))


def test_more_rows_go_to_more_tasks(spark):
    """A task's share stays, whatever the session's shuffle partitions are."""
    df = spark.range(4000).select(F.lit("a").alias("c"), (F.col("id") / 4000).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    plan = ranking.auroc_by_size(df, ["c"], 4000, rows_a_task=100)._jdf.queryExecution().executedPlan().toString()
    assert ", 40), REPARTITION_BY_NUM" in plan


def test_attributes_are_cells_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(40)), int(rng.integers(2)), None if i % 7 == 0 else int(rng.integers(2)), int(rng.integers(2))) for i in range(800)]
    df = spark.createDataFrame(rows, "p double, y int, u int, v int").withColumn("c", F.lit("a"))
    got = {(r["attribute"], r["a"]): (r["n"], r["auroc"]) for r in ranking.auroc_by_size(df, ["c"], 800, attributes=["u", "v"], rows_a_task=60).collect()}
    for k in ("u", "v"):
        for r in ranking.auroc(df.where(F.col(k).isNotNull()), ["c", k]).collect():
            assert got.pop((k, r[k])) == (r["n"], pytest.approx(r["auroc"], abs=1e-12))
    assert not got
