"""Many-cell probes, residualization, erasure and geometry against closed forms."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.operators import linear, probes, ranking
from attraudit.operators.erasure import erasure_effect, nullspace_directions, random_directions
from attraudit.operators.probes import BASELINE, FourierMap, ProbeTable, Variant
from attraudit.plans.inputs import Study
from attraudit.plans import representation as plans

D = 6


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(8)
    n = 600
    a = (rng.random(n) < 0.5).astype(float)
    age = rng.normal(60, 10, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * a - 1 + 0.5 * rng.normal(size=n))))).astype(float)
    z = (rng.random(n) < 0.4).astype(float)
    x = rng.normal(size=(n, D))
    x[:, 0] += 2 * a
    x[:, 1] += 0.8 * z + 0.02 * age
    x = x * np.array([1, 2, 3, 1, 1, 5]) + 4
    split = np.where(np.arange(n) % 10 < 7, "train", np.where(np.arange(n) % 10 < 8, "val", "test"))
    age[::17] = np.nan
    y[::13] = np.nan
    return {"x": x, "a": a, "age": age, "y": y, "z": z, "split": split, "n": n}


@pytest.fixture(scope="module")
def tables(spark, raw):
    rows = [(m, i, [float(v) for v in (raw["x"][i] if m == "m1" else raw["x"][i][:4])]) for m in ("m1", "m2") for i in range(raw["n"])]
    emb = spark.createDataFrame(rows, "model string, unit_id int, embedding array<double>").repartition(5)
    units = spark.createDataFrame(pd.DataFrame({k: raw[k] for k in ("a", "age", "y", "z", "split")}).assign(unit_id=range(raw["n"]), entity_id=range(raw["n"])))
    for c in ("age", "y"):
        units = units.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return emb, units.withColumn("unit_id", F.col("unit_id").cast("int")).withColumn("grp", F.when(F.col("a") == 1, "g1").otherwise("g0")).persist()


def newton(X, y, c=1.0, w=None):
    z = np.hstack([X, np.ones((len(X), 1))])
    th, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 0
    w = np.ones(len(y)) if w is None else w
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ th))
        g = c * z.T @ (w * (p - y)) + ridge @ th
        th = th - np.linalg.solve(c * (z * (w * p * (1 - p))[:, None]).T @ z + ridge, g)
    return th


def scaled(raw, d=D):
    tr = raw["split"] == "train"
    x = raw["x"][:, :d]
    return (x - x[tr].mean(0)) / x[tr].std(0), tr


def ridge_residual(xs, dm, fit, alpha):
    m, xm = dm[fit].mean(0), xs[fit].mean(0)
    c = dm[fit] - m
    w = np.linalg.solve(c.T @ c + alpha * np.eye(dm.shape[1]), c.T @ (xs[fit] - xm))
    return xs - xm - (dm - m) @ w


def logits(raw, fitted, i, designs, d=D):
    f = np.nan_to_num(np.column_stack([raw[c] for c in designs])) if designs else np.zeros((raw["n"], 0))
    return np.hstack([raw["x"][:, :d], f, np.ones((raw["n"], 1))]) @ fitted.coef[i]


def test_cells_match_single_newton_fits(tables, raw):
    emb, units = tables
    variants = [
        BASELINE, Variant("a", remove=("a",)), Variant("age", remove=("age",)), Variant("both", remove=("a", "age"), alpha=0.0),
        Variant("fused", append=("a",)), Variant("alone", append=("a", "age"), use_x=False), Variant("cohort", cohort=("age",)),
    ]
    with ProbeTable(emb, units, ["a", "age"], ["y", "z"]) as t:
        fitted = t.fit(t.cells(variants, ["y", "z"]), tol=1e-9)
        score = t.score(fitted, ("train", "val", "test"))
        n_rows = {(r["model"], r["variant"], r["target"]): r["n"] for r in score.groupBy("model", "variant", "target").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, cell in enumerate(fitted.cells):
        d = D if cell.model == "m1" else 4
        xs, tr = scaled(raw, d)
        need = [raw[c] for c in cell.variant.needs]
        ok = ~np.isnan(np.column_stack(need)).any(1) if need else np.ones(raw["n"], bool)
        y = raw[cell.target]
        if cell.variant.remove:
            dm = np.nan_to_num(np.column_stack([raw[c] for c in cell.variant.remove]))
            feats = ridge_residual(xs, dm, tr & ok, cell.variant.alpha)
        elif cell.variant.append:
            extra = np.column_stack([raw[c] for c in cell.variant.append])
            extra = np.nan_to_num(extra - np.nanmean(extra[tr & ok], axis=0))
            feats = np.hstack([xs, extra]) if cell.variant.use_x else extra
        else:
            feats = xs
        use = tr & ok & ~np.isnan(y)
        th = newton(feats[use], y[use])
        want = feats @ th[:-1] + th[-1]
        got = logits(raw, fitted, i, ["a", "age"], d)
        assert np.abs(got - want)[ok].max() < 2e-4, cell
        assert n_rows[(cell.model, cell.variant.name, cell.target)] == (ok & ~np.isnan(y)).sum()


def test_balanced_weights(tables, raw):
    emb, units = tables
    with ProbeTable(emb, units, [], ["z"]) as t:
        fitted = t.fit(t.cells([BASELINE], ["z"], ["m1"]), balanced=True, tol=1e-9)
    xs, tr = scaled(raw)
    z = raw["z"][tr]
    pw = min(max((1 - z).sum() / z.sum(), 0.1), 10)
    th = newton(xs[tr], z, w=np.where(z == 1, pw, 1.0))
    assert np.abs(logits(raw, fitted, 0, []) - (xs @ th[:-1] + th[-1])).max() < 2e-4


def test_single_mllib_probe_agrees(tables, raw, spark):
    emb, units = tables
    xs, tr = scaled(raw)
    rows = linear.scale(emb.where("model = 'm1'").join(units, "unit_id"), linear.fit_scaler(emb.where("model = 'm1'").join(units.where("split = 'train'"), "unit_id")))
    model = probes.single_probe(rows.where("split = 'train'"), "embedding", "z")
    th = newton(xs[tr], raw["z"][tr])
    assert np.allclose(model.coefficients.toArray(), th[:-1], atol=1e-4) and model.intercept == pytest.approx(th[-1], abs=1e-4)


def test_result_does_not_depend_on_partitions(tables):
    emb, units = tables
    out = []
    for n in (1, 16):
        with ProbeTable(emb.repartition(n), units, ["a"], ["y"]) as t:
            out.append(np.concatenate(t.fit(t.cells([Variant("a", remove=("a",))], ["y"]), tol=1e-9).coef))
    assert np.allclose(out[0], out[1], atol=1e-6)


def test_guard_drops_small_cells(tables):
    emb, units = tables
    u = units.withColumn("rare", F.when(F.col("unit_id") < 30, F.col("z")))
    with ProbeTable(emb, u, [], ["rare", "z"]) as t:
        assert {c.target for c in t.guard(t.cells([BASELINE], ["rare", "z"]))} == {"z"}


def test_residual_is_uncorrelated_with_the_design(tables, raw):
    emb, units = tables
    r = linear.residualize(emb, units, ["a", "age"], alpha=0.0, keep=("unit_id", "split"))
    pdf = r.where("model = 'm1' AND split = 'train'").toPandas().sort_values("unit_id")
    res = np.stack(pdf.residual)
    d = np.column_stack([raw["a"], raw["age"]])[pdf.unit_id]
    assert np.abs((d - d.mean(0)).T @ res).max() < 1e-6
    assert len(pdf) == ((raw["split"] == "train") & ~np.isnan(raw["age"])).sum()


def test_residual_r2(tables, raw):
    emb, units = tables
    with ProbeTable(emb, units, ["a"], ["y"]) as t:
        got = t.residual_r2(Variant("a", remove=("a",), alpha=0.0))["m1"]
    tr = raw["split"] == "train"
    x, a = raw["x"][tr], raw["a"][tr]
    c = x - x.mean(0)
    fit = np.outer(a - a.mean(), (a - a.mean()) @ c / ((a - a.mean()) ** 2).sum())
    assert got == pytest.approx((fit**2).sum() / (c**2).sum(), rel=1e-9)


def test_ridge_probe(tables, raw):
    emb, units = tables
    got = probes.ridge_probe(emb, units, "age").where("model = 'm1'").toPandas().sort_values("unit_id")
    ok = ~np.isnan(raw["age"])
    tr = (raw["split"] == "train") & ok
    xs = (raw["x"] - raw["x"][tr].mean(0)) / raw["x"][tr].std(0)
    w = np.linalg.solve(xs[tr].T @ xs[tr] + np.eye(D), xs[tr].T @ (raw["age"][tr] - raw["age"][tr].mean()))
    want = (xs @ w + raw["age"][tr].mean())[(raw["split"] == "test") & ok]
    assert np.allclose(got.p, want, atol=1e-6)


def test_leak_check_is_chance(spark, tables):
    emb, units = tables
    s = Study(emb, units, ["a"], ["y"], min_test=20, min_pos=5)
    for r in plans.leak_check(s, "a").collect():
        assert abs(r["auroc"] - 0.5) < 0.15


def test_dependence_finds_the_used_attribute(spark, tables):
    emb, units = tables
    s = Study(emb, units, ["a", "age"], ["y"], min_test=20, min_pos=5)
    cells = {(r["model"], r["attribute"]): r["auroc_drop"] for r in plans.dependence_matrix(s, b=20)["cells"].collect()}
    assert cells[("m1", "a")] > 0.1 and abs(cells[("m1", "age")]) < 0.05


def test_erasure_removes_the_direction(tables):
    emb, units = tables
    with ProbeTable(emb, units, [], ["a", "y"]) as t:
        found, log = nullspace_directions(t, ["a"], max_rounds=6, target=0.6)
        q = found["a"]["m1"]
        assert q.shape[1] >= 1 and np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-9)
        eff = {r["model"]: r for r in erasure_effect(t, "a", found["a"], ["y"]).collect()}
    assert eff["m1"]["decode_after"] < 0.65 and eff["m1"]["net_drop"] > 0.05
    first = [v for m, a, k, v in log if m == "m1" and k == 0][0]
    assert first > 0.85
    r = random_directions(found["a"])["m1"]
    assert r.shape == q.shape and np.allclose(r.T @ r, np.eye(r.shape[1]), atol=1e-9)


def test_fourier_features_see_a_nonlinear_target(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)
    emb = spark.createDataFrame([("m", i, [float(v) for v in x[i]]) for i in range(900)], "model string, unit_id int, embedding array<double>")
    units = spark.createDataFrame([(i, "train" if i % 3 else "test", int(y[i])) for i in range(900)], "unit_id int, split string, y int")
    out = {}
    for name, fmap in (("linear", None), ("fourier", FourierMap(200))):
        with ProbeTable(emb, units, [], ["y"], feature_map=fmap) as t:
            out[name] = ranking.auroc(t.score(t.fit(t.cells([BASELINE], ["y"]), c=10.0)), ["model"]).first()["auroc"]
    assert out["linear"] < 0.6 and out["fourier"] > 0.85


def test_geometry(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) * np.array([5, 2, 1, 1, 0.1])
    emb = spark.createDataFrame([("m", i, [float(v) for v in x[i]]) for i in range(300)], "model string, unit_id int, embedding array<double>")
    g = linear.geometry(emb).first()
    lam = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    s = lam / lam.sum()
    assert g["stable_rank"] == pytest.approx(lam.sum() / lam[0], rel=1e-9)
    assert g["stable_rank"] == pytest.approx(100 / g["var_top1_pct"], rel=1e-9)
    assert g["participation_ratio"] == pytest.approx(lam.sum() ** 2 / (lam**2).sum(), rel=1e-9)
    assert g["effective_rank"] == pytest.approx(np.exp(-(s * np.log(s)).sum()), rel=1e-9)
    assert g["dims_for_90pct_var"] == int(np.searchsorted(np.cumsum(s), 0.9) + 1)


def test_softmax_cells_are_stationary_and_rank_like_their_table(spark, tables, raw):
    from attraudit.operators.softmax import fit_softmax, score_softmax

    emb, units = tables
    code = (np.arange(raw["n"]) % 3 + (raw["x"][:, 2] > 6)) % 4
    codes = spark.createDataFrame([(i, int(v) if i % 11 else None) for i, v in enumerate(code)], "unit_id int, code int")
    with ProbeTable(emb, units.join(codes, "unit_id"), ["a", "age"], ["code"], keep=("grp",)) as t:
        got = fit_softmax(t, t.cells([BASELINE, Variant("aged", cohort=("age",))], ["code"]), 4)
        scores = score_softmax(t, got).toPandas()
    for cell, th in zip(got.cells, got.theta):
        x, tr = scaled(raw, D if cell.model == "m1" else 4)
        use = tr & (np.arange(raw["n"]) % 11 != 0)
        if cell.variant.name == "aged":
            use &= ~np.isnan(raw["age"])
        z = np.hstack([x, np.ones((len(x), 1))])
        p = np.exp(z @ th.T)
        p /= p.sum(1, keepdims=True)
        grad = (p[use] - np.eye(4)[code[use]]).T @ z[use]
        grad[:, :-1] += th[:, :-1]
        # the loss is convex: a vanishing gradient proves the optimum
        assert np.abs(grad).max() / use.sum() < 3e-6
        mine = scores[(scores.model == cell.model) & (scores.variant == cell.variant.name)]
        want = (raw["split"] == "test") & (np.arange(raw["n"]) % 11 != 0)
        if cell.variant.name == "aged":
            want = want & ~np.isnan(raw["age"])
        assert sorted(mine.unit_id) == list(np.flatnonzero(want))
        at = mine.unit_id.to_numpy()
        np.testing.assert_allclose(np.stack(mine.p), p[at], atol=1e-6)
        np.testing.assert_array_equal(mine.y, code[at])


def test_softmax_handles_absent_classes_and_no_cells(tables):
    from attraudit.operators.softmax import fit_softmax, score_softmax

    emb, units = tables
    with ProbeTable(emb, units, [], ["z"]) as t:
        got = fit_softmax(t, t.cells([BASELINE], ["z"]), 3)
        p = np.stack([r["p"] for r in score_softmax(t, got).collect()])
        assert p[:, 2].max() < 1e-3 and np.allclose(p.sum(1), 1)
        assert fit_softmax(t, [], 3).cells == []
        two = t.fit(t.cells([BASELINE], ["z"]))
        q = {(r["model"], r["unit_id"]): r["p"] for r in t.score(two).collect()}
        for r in score_softmax(t, fit_softmax(t, t.cells([BASELINE], ["z"]), 2)).collect():
            # two classes share the weight, so their penalty is half the binary one's
            assert abs(r["p"][1] - q[r["model"], r["unit_id"]]) < 0.05


def test_category_study(spark, tables, raw):
    emb, units = tables
    units = units.withColumn("cat", F.when(F.col("unit_id") % 19 == 0, None).otherwise(F.concat(F.col("grp"), (F.col("unit_id") % 2).cast("string"))))
    s = Study(emb, units, ["a"], ["z", "y"], min_train=20, min_test=10, min_pos=2)
    out = plans.category_study(s, "cat", ["g00", "g01", "g10", "g11"], ("g10", "g00"), 5, 2)
    dec = {r["model"]: r.asDict() for r in out["decoding"].collect()}
    assert dec["m1"]["auroc_g10_vs_g00"] > 0.8 and 0.5 < dec["m1"]["macro_auroc"] < 0.95
    dep = {(r["model"], r["target"]): r["auroc_drop"] for r in out["dependence"].collect()}
    x, tr = scaled(raw)
    i, d = np.arange(raw["n"]), raw["a"]
    known = (i % 19 != 0) & (i % 2 == 0)  # g10 and g00
    fit, test = known & tr, known & (raw["split"] == "test")
    centred = d - d[fit].mean()
    w = centred[fit] @ (x[fit] - x[fit].mean(0)) / (centred[fit] @ centred[fit] + 1)
    res = x - x[fit].mean(0) - np.outer(centred, w)
    for finding in ("y", "z"):
        v = raw[finding]
        a, b = fit & ~np.isnan(v), test & ~np.isnan(v)
        areas = []
        for m in (x, res):
            p = np.hstack([m[b], np.ones((b.sum(), 1))]) @ newton(m[a], v[a])
            up, down = p[v[b] == 1], p[v[b] == 0]
            areas.append((up[:, None] > down).mean())
        assert dep["m1", finding] == pytest.approx(areas[0] - areas[1], abs=0.02)
    rows = units.where("split = 'train' and cat in ('g10', 'g00')").select("cat", "z").toPandas()
    cells = [((rows.cat == c) & (rows.z == v)).sum() + 0.5 for c, v in (("g10", 1), ("g00", 0), ("g10", 0), ("g00", 1))]
    got = {r["finding"]: r["odds_ratio"] for r in out["odds"].collect()}
    assert got["z"] == pytest.approx(cells[0] * cells[1] / cells[2] / cells[3])
    groups = out["groups"].toPandas()
    assert set(groups.cat) <= {"g00", "g01", "g10", "g11"} and (groups.n >= 5).all()
    gaps = out["gaps"].toPandas().set_index(["model", "target"])
    for key, g in groups.groupby(["model", "target"]):
        if len(g) > 1:
            assert gaps.loc[key, "gap"] == pytest.approx(g.auroc.max() - g.auroc.min())


def test_warm_started_erasure_matches_cold_rounds(tables, raw):
    """Each round's direction is that of a cold fit on the data with the earlier directions taken out."""
    emb, units = tables
    with ProbeTable(emb, units, [], ["a"]) as t:
        found, log = nullspace_directions(t, ["a"], max_rounds=3, target=0.0)
    x, tr = scaled(raw)
    q = np.zeros((D, 0))
    for _ in range(3):
        left = x - x @ q @ q.T
        w = newton(left[tr], raw["a"][tr])[:-1]
        w -= q @ (q.T @ w)
        q = np.linalg.qr(np.hstack([q, (w / np.linalg.norm(w))[:, None]]))[0]
    np.testing.assert_allclose(found["a"]["m1"] @ found["a"]["m1"].T, q @ q.T, atol=2e-3)
    assert max(r for m, _, r, _ in log if m == "m1") == 3
