"""Cohort, odds, ranking and fairness operators against brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.operators import cohort, fairness, odds, ranking, summary
from attraudit.operators.running import exact_quantiles, midranks, rank_rows, running_totals


def brute_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def skewed():
    """One cell holds almost all rows; scores have ties."""
    rng = np.random.default_rng(1)
    n = 3000
    cell = np.where(rng.random(n) < 0.9, "hot", np.where(rng.random(n) < 0.5, "b", "c"))
    y = (rng.random(n) < 0.4).astype(int)
    p = np.round(rng.random(n) * 0.8 + 0.1 * y, 3)
    return pd.DataFrame({"cell": cell, "unit": np.arange(n), "y": y, "p": p, "grp": rng.choice(["g1", "g2", "g3"], n)})


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_running_totals_do_not_depend_on_buckets(spark, skewed, buckets):
    df = spark.createDataFrame(skewed).groupBy("cell", "p").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(df, ["cell"], "p", {"n": "below"}, {"n": "least"}, n_buckets=buckets).toPandas()
    for _, g in got.groupby("cell"):
        g = g.sort_values("p")
        assert (g.below.to_numpy() == np.concatenate([[0], g.n.cumsum().to_numpy()[:-1]])).all()
        assert (g.least.to_numpy() == np.minimum.accumulate(g.n.to_numpy()[::-1])[::-1]).all()
        assert (g.all_below == g.n.sum()).all()


def test_ranks_and_quantiles(spark, skewed):
    df = spark.createDataFrame(skewed)
    r = rank_rows(df, ["cell"], "p", "rk").toPandas().sort_values("unit")
    assert np.allclose(r.rk, skewed.groupby("cell").p.rank())
    d = midranks(df, [], "p", "rk", descending=True).toPandas().set_index("p").rk
    assert np.allclose(skewed.p.map(d), skewed.p.rank(ascending=False))
    q = exact_quantiles(df, ["cell"], "p", {"a": 0.025, "m": 0.5, "z": 1.0}).toPandas().set_index("cell")
    for c, g in skewed.groupby("cell"):
        assert np.allclose(q.loc[c, ["a", "m", "z"]].astype(float), np.quantile(g.p, [0.025, 0.5, 1.0]))


def test_auroc_and_friends(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = ranking.ranking_metrics(df, ["cell"]).toPandas().set_index("cell")
    for c, g in skewed.groupby("cell"):
        y, p = g.y.to_numpy(), g.p.to_numpy()
        assert got.loc[c, "auroc"] == pytest.approx(brute_auroc(y, p), abs=1e-12)
        cuts = np.unique(p)[::-1]
        tpr = np.array([(p[y == 1] >= t).mean() for t in cuts])
        fpr = np.array([(p[y == 0] >= t).mean() for t in cuts])
        prec = np.array([y[p >= t].mean() for t in cuts])
        assert got.loc[c, "auprc"] == pytest.approx((np.diff(np.concatenate([[0], tpr])) * prec).sum(), abs=1e-12)
        assert got.loc[c, "threshold"] == pytest.approx(cuts[np.argmax(np.round(tpr - fpr, 12))])
    flipped = ranking.auroc(df.withColumn("p", 1 - F.col("p")), ["cell"]).toPandas().set_index("cell").auroc
    assert np.allclose(flipped.sort_index() + got.auroc.sort_index(), 1.0)


def test_ties_and_one_class(spark):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("t", 0, 0.5), ("o", 1, 0.1), ("o", 1, 0.9)], "cell string, y int, p double")
    got = {r["cell"]: r["auroc"] for r in ranking.auroc(df, ["cell"]).collect()}
    assert got == {"t": 0.5, "o": None}


def test_ece_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.3), (0, 1.0)], "y int, p double")
    closed = ranking.calibration(df, [], closed_last=True).first()["ece"]
    left_open = ranking.calibration(df, [], closed_last=False).first()["ece"]
    assert closed == pytest.approx((0.0 + 0.9 + 0.7 + 1.0) / 4)
    assert left_open == pytest.approx((0.0 + 0.9 + 0.7) / 4)


def test_mcc_of_empty_margin(spark):
    r = spark.range(1).select(ranking.mcc(F.lit(0), F.lit(0), F.lit(3), F.lit(4)), ranking.mcc(F.lit(2), F.lit(0), F.lit(0), F.lit(2))).first()
    assert tuple(r) == (0.0, 1.0)


@pytest.mark.parametrize("ties", ["half", "strict"])
def test_delong(spark, ties):
    rng = np.random.default_rng(3)
    n = 120
    y = (rng.random(n) < 0.5).astype(int)
    s = {m: np.round(rng.random(n) + w * y, 1) for m, w in (("a", 0.3), ("b", 0.1), ("c", 0.0))}
    rows = [("x", i, m, int(y[i]), float(s[m][i])) for m in s for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, unit int, model string, y int, p double")
    got = {(r["model_a"], r["model_b"]): r for r in ranking.delong(df, ["cell"], "unit", "model", ["a", "b", "c"], ties).collect()}
    half = 0.5 if ties == "half" else 0.0
    place = {}
    for m, v in s.items():
        pos, neg = v[y == 1], v[y == 0]
        above = (pos[:, None] > neg) + half * (pos[:, None] == neg)
        place[m] = (above.mean(1), above.mean(0))
    for (a, b), r in got.items():
        dp, dn = place[a][0] - place[b][0], place[a][1] - place[b][1]
        var = dp.var(ddof=1) / len(dp) + dn.var(ddof=1) / len(dn)
        assert r["variance"] == pytest.approx(var, rel=1e-9)
        assert r["auroc_a"] == pytest.approx(brute_auroc(y, s[a]), abs=1e-12)
    assert len(got) == 3


def test_odds_corrections(spark):
    rows = [(1, 1.0)] * 4 + [(1, 0.0)] * 2 + [(0, 0.0)] * 3 + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "a int, f double").withColumn("f", F.col("f").cast("int"))
    t = odds.contingency(df, ["a"], ["f"])
    r = t.first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (4, 2, 0, 3)
    assert odds.odds_ratio(t, "zero_cell").first()["odds_ratio"] == pytest.approx(4.5 * 3.5 / (2.5 * 0.5))
    assert odds.odds_ratio(t, "none").first()["odds_ratio"] is None
    assert odds.odds_ratio(t, "none").first()["abs_log_or"] is None
    with pytest.raises(ValueError):
        odds.odds_ratio(t, "some")


def test_weighted_odds_hot_entity(spark):
    rows = [(1, 1, 1)] * 50 + [(2, 0, 1), (3, 1, 0), (4, 0, 0)]
    df = spark.createDataFrame(rows, "entity_id int, a int, f int")
    r = odds.entity_weighted_contingency(df, ["a"], ["f"], "entity_id").first()
    assert (round(r["tp"], 9), r["fn"], r["fp"], r["tn"]) == (1.0, 1.0, 1.0, 1.0)


def test_split_keeps_entities_apart(spark):
    u = spark.range(500).select((F.col("id") % 60).alias("entity_id"), F.col("id").alias("unit_id"), ((F.col("id") % 60) % 2).alias("s"))
    s = cohort.entity_split(u, "entity_id", "s")
    rows = s.collect()
    assert len(rows) == 60
    sizes = pd.Series([(r["s"], r["split"]) for r in rows]).value_counts()
    assert sizes[(0, "train")] == 21 and sizes[(0, "val")] == 4 and sizes[(0, "test")] == 5
    again = cohort.entity_split(u.repartition(7), "entity_id", "s")
    assert {tuple(r) for r in rows} == {tuple(r) for r in again.collect()}


def test_majority_ties_and_unknown(spark):
    rows = [(1, "White"), (1, "Black"), (2, "Unknown"), (2, "Unknown"), (3, "Unknown"), (3, "Asian"), (3, "Unknown")]
    df = spark.createDataFrame(rows, "e int, c string")
    assert dict(map(tuple, cohort.majority_category(df, "e", "c").collect())) == {1: "Black", 2: "Unknown", 3: "Asian"}


def test_canonical_units(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("a", 1)]
    emb = spark.createDataFrame(rows, "model string, unit_id int")
    units = spark.createDataFrame([(1,), (3,)], "unit_id int")
    assert [r[0] for r in cohort.canonical_units(emb, units).collect()] == [1]
    with pytest.raises(ValueError):
        cohort.align(spark.createDataFrame([(9,)], "unit_id int"), emb, strict=True)


def test_gaps(spark, skewed):
    df = spark.createDataFrame(skewed)
    g = fairness.gap(fairness.subgroup_auroc(df, ["cell"], min_n=10, min_pos=3, min_neg=3), ["cell"]).toPandas().set_index("cell")
    for c, part in skewed.groupby("cell"):
        a = part.groupby("grp")[["y", "p"]].apply(lambda v: brute_auroc(v.y.to_numpy(), v.p.to_numpy()))
        assert g.loc[c, "gap"] == pytest.approx(a.max() - a.min())
        assert g.loc[c, "max_group"] == a.idxmax()


@pytest.mark.parametrize("small", [True, False])
def test_benjamini_hochberg(spark, small):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(60) ** 2, 2)
    rows = [("f", i, float(v)) for i, v in enumerate(p)] + [("f", 99, None), ("one", 0, 0.04)]
    df = spark.createDataFrame(rows, "family string, i int, p_value double")
    got = {(r["family"], r["i"]): (r["p_adjusted"], r["rejected"]) for r in summary.benjamini_hochberg(df, ["family"], small=small).collect()}
    order = np.argsort(p, kind="stable")
    adj = np.minimum(np.minimum.accumulate((p[order] * 60 / np.arange(1, 61))[::-1])[::-1], 1.0)
    for rank, i in enumerate(order):
        assert got[("f", i)][0] == pytest.approx(adj[rank])
    assert got[("f", 99)] == (None, False)
    assert got[("one", 0)] == (0.04, True)


def test_stem_match_prefers_full_path(spark):
    idx = spark.createDataFrame([("top/p1/a.jpg",), ("p2/b.jpg",), ("x/p2/b.jpg",)], "path string")
    want = spark.createDataFrame([("p2/b.png",), ("p1/a.png",), ("none.png",)], "path string")
    assert dict(map(tuple, cohort.match_by_stem(idx, want).collect())) == {
        "p2/b.png": "p2/b.jpg", "p1/a.png": "top/p1/a.jpg", "none.png": None,
    }
