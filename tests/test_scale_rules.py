"""Nothing is dropped or changed by null keys, large counts or sizes."""
import pytest
from pyspark.sql import functions as F

from attraudit.functions.rand import poisson_many
from attraudit.operators import cohort, odds, summary
from attraudit.operators.running import exact_quantiles, rank_rows
from attraudit.sources import sinks


def test_split_keeps_entities_with_a_null_stratum(spark):
    e = spark.range(100).select(F.col("id").alias("entity_id"), F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("s"))
    got = cohort.entity_split(e, "entity_id", "s").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {None: 25, "1": 25, "2": 25, "3": 25}


@pytest.mark.parametrize("small", [False, True])
def test_ranks_and_quantiles_of_a_null_group(spark, small):
    df = spark.createDataFrame([(g, float(v)) for g in (None, "a") for v in (1, 2, 2, 3)], "g string, v double")
    got = rank_rows(df, ["g"], "v", "rk", small=small).where("g IS NULL").select("v", "rk").collect()
    assert sorted(map(tuple, got)) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0)]
    assert {(r["g"], r["m"]) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {(None, 2.0), ("a", 2.0)}


def test_fdr_of_a_null_family(spark):
    df = spark.createDataFrame([(None, 0.01), (None, 0.04), ("a", 0.04), ("a", None)], "f string, p_value double")
    got = {(r["f"], r["p_value"]): r["p_adjusted"] for r in summary.benjamini_hochberg(df, ["f"]).collect()}
    assert got == {(None, 0.01): 0.02, (None, 0.04): 0.04, ("a", 0.04): 0.04, ("a", None): None}


def test_large_counts_draw_in_constant_time(spark):
    n = F.create_map(*[F.lit(x) for kv in ((0, 3), (1, 64), (2, 65), (3, 5_000), (4, 1 << 40)) for x in kv])
    df = spark.range(5000).select((F.col("id") % 5).alias("k"), "id")
    got = df.select("k", n[F.col("k").cast("int")].alias("n"), poisson_many(n[F.col("k").cast("int")].cast("bigint"), 7, "id").alias("w"))
    for r in got.groupBy("k").agg(F.max("n").alias("n"), F.avg("w").alias("mean"), F.var_samp("w").alias("var")).collect():
        assert abs(r["mean"] - r["n"]) < 5 * (r["n"] / 1000) ** 0.5
        assert 0.75 < r["var"] / r["n"] < 1.25


def test_attributes_other_than_0_and_1_are_left_out(spark):
    df = spark.createDataFrame([(0.7, 1), (1.0, 1), (0.0, 0), (None, 1)], "a double, y int")
    r = odds.contingency(df, ["a"], ["y"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 0, 0, 1)


def test_only_a_missing_path_counts_as_nothing_written(spark, tmp_path):
    assert sinks.read_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):
        sinks.read_or_none(spark, str(tmp_path / "broken"))


def test_subsample_keeps_splits_without_a_size(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, "train").otherwise("test").alias("split"))
    got = {r["split"]: r["count"] for r in cohort.subsample(df, "id", {"train": 7}).groupBy("split").count().collect()}
    assert got == {"train": 7, "test": 50}
