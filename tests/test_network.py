"""Two-layer networks as cells of the shared scans, against plain numpy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.operators import network, ranking
from attraudit.operators.network import Network, fit_network, score_network
from attraudit.operators.probes import BASELINE, ProbeTable, Variant
from attraudit.plans import representation as plans
from attraudit.plans.inputs import Study
from attraudit.operators.probes import FourierMap

N, D = 900, 4


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, D)) * [1, 2, 3, 1] + 5
    a = (rng.random(N) < 0.5).astype(float)
    x[:, 3] += a
    z = (x - 5) / [1, 2, 3, 1]
    y = (z[:, 0] * z[:, 1] > 0).astype(float)
    y[::11] = np.nan
    a[::19] = np.nan
    split = np.where(np.arange(N) % 10 < 6, "train", np.where(np.arange(N) % 10 < 8, "val", "test"))
    return {"x": x, "y": y, "a": a, "split": split}


@pytest.fixture(scope="module")
def tables(spark, raw):
    rows = [(m, i, [float(v) for v in raw["x"][i]]) for m in ("m1", "m2") for i in range(N)]
    emb = spark.createDataFrame(rows, "model string, unit_id int, embedding array<double>").repartition(4)
    units = spark.createDataFrame(pd.DataFrame({k: raw[k] for k in ("y", "a", "split")}).assign(unit_id=range(N), entity_id=range(N)))
    for c in ("y", "a"):
        units = units.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return emb, units.withColumn("unit_id", F.col("unit_id").cast("int")).persist()


def plain_loss(w, v, c, x, y):
    act = np.tanh(x @ w[:, :-1].T + w[:, -1])
    logit = act @ v + c
    return (np.logaddexp(0, logit) - y * logit).sum()


def test_loss_and_gradient_equal_plain_numpy(tables, raw):
    emb, units = tables
    ok = (raw["split"] == "train") & ~np.isnan(raw["y"]) & ~np.isnan(raw["a"])
    check = (raw["split"] == "val") & ~np.isnan(raw["y"]) & ~np.isnan(raw["a"])
    h, rng = 3, np.random.default_rng(1)
    with ProbeTable(emb, units, ["a"], ["y"]) as t:
        cells = t.cells([BASELINE, Variant("removed", remove=("a",), alpha=0.0)], ["y"])
        t._need_moments([(), *[c.variant.needs for c in cells]])
        mp = t._map("m1", cells[1].variant)
        theta = rng.normal(size=h * (mp.size + 1) + h + 1)
        units_, out, offset = network.unpack(theta, mp, h)
        rows = t.rows.where("split IN ('train', 'val')").select("model", "x", "f", "y", "split")
        got = network._evaluate(t, rows, [cells[1]], [units_], [out], [offset], "train")[0]
    tr = raw["split"] == "train"
    xs = (raw["x"] - raw["x"][tr].mean(0)) / raw["x"][tr].std(0)
    fit = tr & ~np.isnan(raw["a"])
    am = raw["a"][fit].mean()
    d = raw["a"][fit] - am
    w_res = d @ (xs[fit] - xs[fit].mean(0)) / (d @ d)
    r = xs - xs[fit].mean(0) - np.outer(np.nan_to_num(raw["a"]) - am, w_res)
    w = theta[: h * (D + 1)].reshape(h, -1)
    v, c = theta[-h - 1:-1], theta[-1]
    assert got["loss"] == pytest.approx(plain_loss(w, v, c, r[ok], raw["y"][ok]), rel=1e-9) and got["n"] == ok.sum()
    assert got["val"] == pytest.approx(plain_loss(w, v, c, r[check], raw["y"][check]), rel=1e-9) and got["n_val"] == check.sum()
    grad = np.concatenate([np.array([mp.back(g) for g in got["g_units"]]).ravel(), got["g_out"], [got["g_offset"]]])
    for k in range(len(theta)):
        ends = []
        for e in (1e-5, -1e-5):
            u = theta.copy()
            u[k] += e
            ends.append(plain_loss(u[: h * (D + 1)].reshape(h, -1), u[-h - 1:-1], u[-1], r[ok], raw["y"][ok]))
        assert grad[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-4)


def test_a_product_of_two_directions_is_decoded(tables):
    emb, units = tables
    with ProbeTable(emb, units, [], ["y"]) as t:
        cells = t.cells([BASELINE], ["y"])
        fitted = fit_network(t, cells, Network(hidden=24))
        assert max(fitted.rounds) <= Network().max_rounds
        net = {r["model"]: r["auroc"] for r in ranking.auroc(score_network(t, fitted), ["model"]).collect()}
        line = {r["model"]: r["auroc"] for r in ranking.auroc(t.score(t.fit(cells)), ["model"]).collect()}
        again = fit_network(t, cells, Network(hidden=24))
    assert set(net) == {"m1", "m2"} and min(net.values()) > 0.9 and max(line.values()) < 0.65
    assert np.allclose(fitted.out[0], fitted.out[1], atol=1e-6) and np.allclose(fitted.out[0], again.out[0], atol=1e-6)


def test_columns_of_the_study_and_rows_without_a_design(tables):
    emb, units = tables
    s = Study(emb.where("model = 'm1'"), units, ["a"], ["y"], min_train=30, min_test=20, min_pos=5)
    out = plans.nonlinear_use(s, "a", FourierMap(size=32), Network(hidden=16, max_rounds=40))
    use, dec = out["use"].collect()[0], out["decodability"].collect()[0]
    assert use["network_base"] > 0.8 and abs(use["network_dependence"]) < 0.2 and use["linear_base"] < 0.65
    assert dec["linear_base"] > 0.65 and dec["linear_after"] < 0.6 and dec["network_base"] > 0.6


def test_cells_without_rows_stay_at_the_start(tables):
    emb, units = tables
    with ProbeTable(emb, units.withColumn("none", F.lit(None).cast("double")), [], ["none"]) as t:
        fitted = fit_network(t, t.cells([BASELINE], ["none"], ["m1"]), Network(hidden=4))
        assert fitted.rounds == [0] and score_network(t, fitted).count() == 0
