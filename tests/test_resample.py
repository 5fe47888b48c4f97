"""Bootstrap and permutation operators: agreement with theory, not with a random stream."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.operators import resample as R


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = (rng.random(n) < 0.5).astype(int)
    p = np.round(rng.normal(size=n) + 0.8 * y, 2)
    q = np.round(p + rng.normal(size=n) * 0.5, 2)
    return spark.createDataFrame(pd.DataFrame({
        "cell": "c", "unit": np.arange(n), "y": y, "p": p, "q": q, "grp": rng.choice(["a", "b"], n),
    })).persist()


def test_interval_width_matches_the_standard_error(scores):
    for unit in (None, "unit"):
        r = R.bootstrap_ci(scores.select("cell", "unit", "y", "p"), ["cell"], "auroc", b=200, unit=unit).first()
        se = (r["ci_high"] - r["ci_low"]) / (2 * 1.96)
        assert r["n_draws"] == 200 and r["ci_low"] < r["point"] < r["ci_high"]
        assert 0.018 < se < 0.032


def test_same_draws_for_any_partitioning(scores):
    a = R.bootstrap_ci(scores.select("cell", "unit", "y", "p"), ["cell"], b=20, unit="unit").first()
    b = R.bootstrap_ci(scores.repartition(11).select("cell", "unit", "y", "p"), ["cell"], b=20, unit="unit").first()
    assert a["ci_low"] == pytest.approx(b["ci_low"], abs=1e-12) and a["ci_high"] == pytest.approx(b["ci_high"], abs=1e-12)


def test_delta_of_a_worse_score(scores):
    r = R.bootstrap_delta(scores, ["cell"], "q", "p", b=100, unit="unit").first()
    assert r["delta"] > 0 and r["ci_low"] < r["delta"] < r["ci_high"] and r["p_value"] < 0.2
    whole = R.bootstrap_delta(scores.drop("cell"), [], "q", "p", b=30, unit="unit").first()
    assert whole["delta"] == pytest.approx(r["delta"])


def test_permutation_null_is_centred(scores):
    r = R.permutation_auroc(scores, ["cell"], "unit", b=60).first()
    assert r["p_value"] == 0.0 and abs(r["null_mean"] - 0.5) < 0.02 and 0.015 < r["null_std"] < 0.045
    assert R.permutation_auroc(scores, ["cell"], "unit", b=19, plus_one=True).first()["p_value"] == pytest.approx(0.05)


def test_permutation_gap_keeps_group_sizes(scores):
    r = R.permutation_gap(scores, ["cell"], "unit", b=40).first()
    assert r["n_draws"] == 40 and 0.0 <= r["p_value"] <= 1.0 and r["n_groups"] == 2


def test_too_few_valid_draws_give_no_interval(spark):
    df = spark.createDataFrame([("c", i, 1 if i == 0 else 0, float(i)) for i in range(3)], "cell string, unit int, y int, p double")
    r = R.bootstrap_ci(df, ["cell"], b=12, unit="unit").first()
    assert r["ci_low"] is None or r["n_draws"] >= 10


def test_user_metric(scores):
    R.register_metric("share", lambda rows, keys, weight, base=None: rows.groupBy(*keys).agg((F.sum(F.col(weight) * F.col("y")) / F.sum(weight)).alias("value")))
    r = R.bootstrap_ci(scores.select("cell", "unit", "y", "p"), ["cell"], "share", b=50).first()
    assert r["ci_low"] < r["point"] < r["ci_high"]


def test_exact_mean(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(30)], "g string, i int, v double")
    r = R.bootstrap_mean_exact(df, ["g"], "i", "v", b=400).first()
    se = (r["ci_high"] - r["ci_low"]) / (2 * 1.96)
    assert r["point"] == 14.5 and abs(se - np.std(np.arange(30)) / np.sqrt(30)) < 0.25
