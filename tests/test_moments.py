"""Centred moments and rank correlations at the edges of double precision and of skew."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.operators import linear, panel, probes
from attraudit.operators.blocks import Moments
from attraudit.operators.probes import ProbeTable, Variant

N, D = 400, 3


@pytest.fixture(scope="module")
def far(spark):
    """Columns whose means are a million times their deviations."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=N)
    x = rng.normal(size=(N, D)) + a[:, None] * [1.0, 0.5, 0.0]
    moved = x + 1e6
    emb = spark.createDataFrame([(m, i, [float(v) for v in moved[i, :d]]) for m, d in (("m1", D), ("m2", 2)) for i in range(N)], "model string, unit_id int, embedding array<double>").repartition(7)
    units = spark.createDataFrame([(i, float(a[i] + 1e6), float(x[i] @ [1, 2, 3] + 1e6), "train") for i in range(N)], "unit_id int, a double, t double, split string")
    return x, a, emb, units


def test_merging_equals_one_pass():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(90, 4)) + 1e6
    parts = [Moments.of(z[s], 2, z[s].sum(0)) for s in (slice(0, 1), slice(1, 1), slice(1, 50), slice(50, 90))]
    got = parts[1]
    for p in (parts[3], parts[0], parts[2]):
        got = got.add(p)
    c = z - z.mean(0)
    assert got.n == 90 and np.allclose(got.mean, z.mean(0), rtol=1e-14) and np.allclose(got.cross, c[:, :2].T @ c, rtol=1e-7, atol=1e-7)
    assert np.allclose(got.squares, (c * c).sum(0), rtol=1e-8) and np.allclose(got.extra, z.sum(0))


def test_residuals_and_spectrum_far_from_zero(far):
    x, a, emb, units = far
    rows = linear.residualize(emb, units, ["a"], alpha=0.0).where("model = 'm1'").toPandas().sort_values("unit_id")
    d = a - a.mean()
    want = x - x.mean(0) - np.outer(d, d @ (x - x.mean(0)) / (d @ d))
    assert np.abs(np.stack(rows.residual) - want).max() < 1e-6
    lam = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = linear.geometry(emb).where("model = 'm1'").first()
    assert got["stable_rank"] == pytest.approx(lam.sum() / lam[0], rel=1e-6) and got["isotropy_ratio"] == pytest.approx(lam[-1] / lam[0], rel=1e-6)


def test_probe_moments_far_from_zero(far):
    x, a, emb, units = far
    d = a - a.mean()
    fit = np.outer(d, d @ (x - x.mean(0)) / (d @ d))
    with ProbeTable(emb, units, ["a"], ["t"]) as t:
        assert t.residual_r2(Variant("a", remove=("a",), alpha=0.0))["m1"] == pytest.approx((fit**2).sum() / ((x - x.mean(0)) ** 2).sum(), rel=1e-6)
        assert np.allclose(t.second_moment("m1"), np.corrcoef(x.T), atol=1e-6)
    p = probes.ridge_probe(emb, units, "t", splits=("train",)).where("model = 'm1'").toPandas().sort_values("unit_id")
    z = (x - x.mean(0)) / x.std(0)
    y = x @ [1, 2, 3]
    w = np.linalg.solve(z.T @ z + np.eye(D), z.T @ (y - y.mean()))
    assert np.abs(p.p.to_numpy() - 1e6 - (z @ w + y.mean())).max() < 1e-5


def test_regression_far_from_zero(far):
    x, a, emb, units = far
    rows = units.withColumn("y", 3 * (F.col("a") - 1e6) + 7e6)
    got = {r["term"]: r["beta"] for r in panel.ols(rows, "y", {"m": [panel.num("a")]}).collect()}
    assert got["a"] == pytest.approx(3, rel=1e-9)


def brute(pdf):
    both = pdf.dropna(subset=["x", "y"])
    return np.corrcoef(both.x.rank(), both.y.rank())[0, 1], len(both)


@pytest.mark.parametrize("kind", ["plain", "hot"])
def test_spearman_in_buckets_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), "x": rng.normal(size=n).round(2)})
    pdf["y"] = (pdf.x + rng.normal(size=n)).round(1)
    if kind == "hot":  # one value a half of all, one pair a third
        pdf.loc[: n // 2, "x"] = 0.25
        pdf.loc[: n // 3, "y"] = -0.5
    pdf.loc[::37, "x"] = np.nan
    pdf.loc[::41, "y"] = np.nan
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "k string, x double, y double").repartition(5)
    got = {r["k"]: (r["rho"], r["n"]) for r in panel.spearman(df, ["k"], "x", "y").collect()}
    assert len(got) == 3
    for k, part in pdf.groupby("k", dropna=False):
        rho, m = brute(part)
        assert got[None if pd.isna(k) else k] == (pytest.approx(rho, abs=1e-10), m)
    rho, m = brute(pdf)
    every = panel.spearman(df, [], "x", "y").first()
    assert every["rho"] == pytest.approx(rho, abs=1e-10) and every["n"] == m
    twice = panel.spearman(df.withColumn("w", F.when(F.col("x") > 0, 2).otherwise(0)), [], "x", "y", weight="w").first()
    rho, m = brute(pd.concat([pdf[pdf.x > 0]] * 2))
    assert twice["rho"] == pytest.approx(rho, abs=1e-10) and twice["n"] == m


def test_rows_are_exchanged_twice(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    cells = panel._rank_cells(df.withColumn("__w", F.lit(1)), ["k"], "x", "y")
    plan = cells._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    full = cells._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert full.count("Exchange hashpartitioning") == 3  # x, y, and the cells
