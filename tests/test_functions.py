"""Label policies, bins, categories, tails and draws against hand values."""
import math

import pytest
from pyspark.sql import functions as F

from attraudit.functions import tails
from attraudit.functions.classify import classify_confounding, classify_pattern, cost_tier, format_ci, format_delta
from attraudit.functions.labels import apply_policy, assign_bins, collapse_category, split_at
from attraudit.functions.rand import poisson_many, poisson_one, uniform
from attraudit.schema import require


def test_policies_stay_distinct(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "raw double")
    got = {p: [r[0] for r in df.select(apply_policy(F.col("raw"), p)).collect()] for p in ("ignore", "zero", "blank_dropped")}
    assert got == {"ignore": [1, 0, None, None], "zero": [1, 0, 0, 0], "blank_dropped": [1, 0, 0, None]}
    with pytest.raises(ValueError):
        apply_policy(F.col("raw"), "other")


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 49.999, 50.0, 70.0, 199.0, 200.0, -1.0, None)], "v double")
    got = [r[0] for r in df.select(assign_bins(F.col("v"), [0, 50, 70, 200], ["a", "b", "c"])).collect()]
    assert got == ["a", "a", "b", "c", "c", None, None, None]


def test_category_rules(spark):
    raw = ["WHITE - RUSSIAN", "portuguese", "Black/Cape", "South Asian", "unknown", "HISPANIC", None, "UNABLE TO OBTAIN"]
    df = spark.createDataFrame([(v,) for v in raw], "v string")
    got = [r[0] for r in df.select(collapse_category(F.col("v"))).collect()]
    assert got == ["White", "White", "Black", "Asian", "Unknown", "Other", "Unknown", "Unknown"]


def test_split_sides(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    row = [tuple(r) for r in df.select(split_at(F.col("v"), F.lit(2.0)), split_at(F.col("v"), F.lit(2.0), ">", 0)).collect()]
    assert row == [(0, 0), (1, 0), (1, 1), (None, 0)]


def test_classes_and_text(spark):
    df = spark.createDataFrame([(0.01, 0.10), (0.09, 0.20), (0.05, 0.04), (None, 0.1)], "d double, a double")
    got = [r[0] for r in df.select(classify_confounding(F.col("d"), F.col("a"))).collect()]
    assert got == ["genuine", "heavily_confounded", "partially_confounded", "unknown"]
    one = spark.range(1).select(
        cost_tier(F.lit(-0.004)), classify_pattern(F.lit("auroc"), F.lit(0.7), F.lit(0.006)),
        format_ci(F.lit(0.8125), F.lit(0.79), F.lit(0.834)), format_delta(F.lit(-0.01), F.lit(-0.02), F.lit(-0.001), F.lit(0.03)),
    ).first()
    assert tuple(one) == ("cheap", "Hidden conf.", "0.813 (0.790-0.834)", "-0.010 (-0.020, -0.001) p=0.030*")


def test_tail_probabilities():
    # tabulated critical values
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    # z of the published slope and its clustered error
    assert tails.normal_two_sided(0.02904523767 / 0.00461595557) == pytest.approx(3.1268e-10, rel=1e-3)
    assert tails.t_two_sided(1.5, 7) == pytest.approx(tails.f_upper(2.25, 1, 7), abs=1e-12)
    assert tails.gamma_upper(1.0, 2.0) == pytest.approx(math.exp(-2.0), abs=1e-14)


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(4000)
    w = poisson_one(uniform(7, "id")).alias("w")
    a = sorted(map(tuple, ids.repartition(1).select("id", w).collect()))
    b = sorted(map(tuple, ids.repartition(13).select("id", w).collect()))
    assert a == b
    mean = sum(x[1] for x in a) / len(a)
    var = sum((x[1] - mean) ** 2 for x in a) / len(a)
    assert abs(mean - 1) < 0.06 and abs(var - 1) < 0.1
    many = ids.select(poisson_many(F.lit(5), 7, "id").alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(many[0] - 5) < 0.15 and abs(many[1] - 5) < 0.5


def test_require(spark):
    df = spark.range(3)
    require(df, id="numeric")
    with pytest.raises(ValueError):
        require(df, missing="any")
    with pytest.raises(TypeError):
        require(df, id="string")
