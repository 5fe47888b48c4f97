"""Panel regression against numpy."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.functions.tails import f_upper, normal_two_sided, t_two_sided
from attraudit.operators import panel as P
from attraudit.operators.gram import gram


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 240
    g = rng.integers(0, 8, n)
    x, z = rng.normal(5, 2, n), rng.normal(size=n)
    y = 1000 + 0.5 * x - 0.2 * z + rng.normal(size=8)[g] * 0.7 + rng.normal(size=n) * (0.5 + 0.1 * x)
    return pd.DataFrame({"x": x, "z": z, "y": y, "g": [f"g{i}" for i in g], "m": rng.choice(["u", "v", "w"], n)})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data)


def np_ols(X, y):
    X = np.column_stack([np.ones(len(y)), *X])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    n, k = X.shape
    return X, b, e, e @ e / (n - k), np.linalg.inv(X.T @ X)


def test_gram_is_additive(spark, df):
    full = np.array(gram(df, ["x", "y"]).first()["g"])
    parts = sum(np.array(r["g"]) for r in gram(df.repartition(9), ["x", "y"], ["m"]).collect())
    assert np.allclose(full, parts)


def test_ols_terms(df, data):
    fits = {"M1": [P.num("x")], "M5": [P.num("x"), P.cat("m")], "I": [P.num("x"), P.num("z"), P.inter("x", "z")]}
    got = P.ols(df, "y", fits).toPandas()
    d = {c: (data.m == c).astype(float) for c in ("v", "w")}
    designs = {"M1": [data.x], "M5": [data.x, d["v"], d["w"]], "I": [data.x, data.z, data.x * data.z]}
    for name, cols in designs.items():
        X, b, e, s2, inv = np_ols(cols, data.y.to_numpy())
        part = got[got.fit == name]
        assert np.allclose(part.beta, b, atol=1e-6)
        se = np.sqrt(np.diag(inv) * s2)
        assert np.allclose(part.se, se, rtol=1e-6)
        r2 = 1 - e @ e / ((data.y - data.y.mean()) ** 2).sum()
        n, k = X.shape
        assert part.r2.iloc[0] == pytest.approx(r2, abs=1e-9)
        assert part.f_p_value.iloc[0] == pytest.approx(f_upper(r2 / (k - 1) / ((1 - r2) / (n - k)), k - 1, n - k), rel=1e-5)
        ll = -n / 2 * (math.log(2 * math.pi) + math.log(e @ e / n) + 1)
        assert part.aic.iloc[0] == pytest.approx(-2 * ll + 2 * k, rel=1e-9)
        assert part.p_value.iloc[1] == pytest.approx(t_two_sided(b[1] / se[1], n - k), rel=1e-4)
    table = P.fit_table(P.ols(df, "y", fits), base="M1").toPandas().set_index("fit")
    assert table.loc["M1", "delta_r2"] == 0 and table.loc["M5", "delta_r2"] > 0


def test_cluster_robust(df, data):
    got = P.cluster_robust(df, "y", ["x"], "g").toPandas().set_index("term").loc["x"]
    X, b, e, s2, inv = np_ols([data.x], data.y.to_numpy())
    meat = np.zeros((2, 2))
    for c in data.g.unique():
        s = X[data.g == c].T @ e[data.g == c]
        meat += np.outer(s, s)
    n, g = len(data), data.g.nunique()
    v = g / (g - 1) * (n - 1) / (n - 2) * inv @ meat @ inv
    assert got.se_cluster == pytest.approx(math.sqrt(v[1, 1]), rel=1e-6)
    assert got.p_cluster == pytest.approx(normal_two_sided(b[1] / math.sqrt(v[1, 1])), rel=1e-5)


def test_influence_and_residuals(df, data):
    X, b, e, s2, inv = np_ols([data.x], data.y.to_numpy())
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    cook = e**2 / (2 * s2) * h / (1 - h) ** 2
    got = P.influence_counts(P.influence(df, "y", ["x"])).first()
    assert got["max_cooks_d"] == pytest.approx(cook.max(), rel=1e-6)
    assert got["n_above_4_over_n"] == (cook > 4 / len(data)).sum()
    r = P.residual_summary(df, "y", ["x"]).first()
    assert r["skew"] == pytest.approx(((e - e.mean()) ** 3).mean() / e.std() ** 3, abs=1e-6)
    lm = P.breusch_pagan(df, "y", ["x"]).first()["lm"]
    _, _, e2, _, _ = np_ols([data.x], e**2)
    assert lm == pytest.approx(len(data) * (1 - e2 @ e2 / ((e**2 - (e**2).mean()) ** 2).sum()), rel=1e-5)


def test_spearman_and_concordance(spark, df, data):
    rho = data.x.rank().corr(data.y.rank())
    for small in (True, False):
        assert P.spearman(df, [], "x", "y", small=small).first()["rho"] == pytest.approx(rho, abs=1e-12)
    rows = [(f"s{i}", j, float(i)) for i in range(5) for j in range(4)]
    same = spark.createDataFrame(rows, "s string, j int, v double")
    assert P.kendall_w(same, "s", "j", "v").first()["kendall_w"] == pytest.approx(1.0)


def test_leave_one_group_out(df, data):
    got = P.leave_one_group_out(df, "y", ["x"], "m").toPandas().set_index("m")
    for m in "uvw":
        part = data[data.m != m]
        assert got.loc[m, "r2"] == pytest.approx(np.corrcoef(part.x, part.y)[0, 1] ** 2, abs=1e-9)


def test_random_intercept(df, data):
    got = P.random_intercept(df, "y", ["x"], "g")
    X, y = np.column_stack([np.ones(len(data)), data.x]), data.y.to_numpy()

    def crit(theta):
        a, b, c, logdet = np.zeros((2, 2)), np.zeros(2), 0.0, 0.0
        for g in data.g.unique():
            at = (data.g == g).to_numpy()
            v = np.eye(at.sum()) + theta
            vi = np.linalg.inv(v)
            a, b, c = a + X[at].T @ vi @ X[at], b + X[at].T @ vi @ y[at], c + y[at] @ vi @ y[at]
            logdet += np.linalg.slogdet(v)[1]
        rss = c - b @ np.linalg.solve(a, b)
        return logdet + np.linalg.slogdet(a)[1] + (len(y) - 2) * math.log(rss / (len(y) - 2))

    theta = got["group_variance"] / got["residual_variance"]
    assert crit(theta) <= min(crit(theta * 1.05), crit(theta / 1.05))
    assert 0 < got["icc"] < 1


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = 2 * x + rng.normal(size=300) * 0.3
    y[:15] += 40
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    m = P.huber(df, "y", ["x"])
    b = np.array(m["beta"])
    e = y - b[0] - b[1] * x
    s = np.median(np.abs(e)) / 0.6744897501960817
    psi = np.clip(e / s, -1.345, 1.345)
    assert abs(psi.sum()) < 1e-3 and abs((psi * x).sum()) < 1e-3
    assert abs(b[1] - 2) < 0.1


def test_minimum_detectable_effect(spark):
    rows = [(float(v),) for v in (-1, 0, 1, 2, -2)]
    r = P.minimum_detectable(spark.createDataFrame(rows, "v double"), [], "v").first()
    assert r["mde"] == pytest.approx(2.8015852 * np.std([-1, 0, 1, 2, -2], ddof=1) / math.sqrt(5), rel=1e-6)


def test_product_of_a_column_that_hardly_varies(spark):
    rng = np.random.default_rng(3)
    model, x = np.repeat([0.0, 1.0], 24), np.abs(rng.normal(0, 0.004, 48))
    g = 3.93 + 4e-5 * model
    y = 0.002 * model + x * (0.3 + 0.5 * model) + rng.normal(0, 0.001, 48)
    got = P.ols(spark.createDataFrame(pd.DataFrame({"x": x, "g": g, "y": y})), "y", {"p": [P.num("x"), P.num("g"), P.inter("x", "g")]}).collect()
    _, _, e, _, _ = np_ols([x, model, x * model], y)  # the same space, well apart
    assert got[0]["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    slope = {m: np.polyfit(x[model == m], y[model == m], 1)[0] for m in (0.0, 1.0)}
    assert {r["term"]: r["beta"] for r in got}["x:g"] == pytest.approx((slope[1.0] - slope[0.0]) / 4e-5, rel=1e-5)
