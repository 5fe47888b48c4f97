"""Vector bootstrap and dealt permutations against plain numpy, replicate by replicate."""
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attraudit.functions.weights import CUTS, poisson_weights, row_hash
from attraudit.operators import permute
from attraudit.operators import resample as R
from attraudit.operators.draws import auprc_draws, auroc_draws, weighted_sums

B = 40


def md5_hash(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def frame(n=900, seed=4):
    """Two cells, three groups, many ties; one score holds a third of the rows."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(rng.normal(size=n) + 0.6 * y, 1)
    p[rng.random(n) < 0.35] = 0.5
    q = np.round(p + rng.normal(size=n) * 0.5, 2)
    return pd.DataFrame({"cell": rng.choice(["c", "d"], n, p=[0.8, 0.2]), "unit": np.arange(n), "y": y, "p": p, "q": q, "grp": rng.choice(list("abc"), n)})


@pytest.fixture(scope="module")
def data():
    return frame()


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data).repartition(5).persist()


def weights_of(data, b=B, seed=42):
    return poisson_weights(np.array([md5_hash(seed, u) for u in data["unit"]]), np.ones(len(data), "i8"), b)


def auroc(y, s, w):
    pos, neg = y == 1, y == 0
    d = s[pos][:, None] - s[neg][None, :]
    total = w[pos].sum() * w[neg].sum()
    return (w[pos][:, None] * w[neg][None, :] * ((d > 0) + (d == 0) / 2)).sum() / total if total else np.nan


def precision(y, s, w):
    area, n_pos = 0.0, w[y == 1].sum()
    if n_pos == 0 or w[y == 0].sum() == 0:
        return np.nan
    for v in np.unique(s):
        called = s >= v
        if w[called].sum():
            area += w[(s == v) & (y == 1)].sum() / n_pos * w[called & (y == 1)].sum() / w[called].sum()
    return area


def brute(data, keys, fn, score="p", b=B):
    w = weights_of(data, b)
    out = {}
    for k, g in data.groupby(keys):
        i = g.index.to_numpy()
        for r in range(b):
            out[(k if isinstance(k, tuple) else (k,)) + (r,)] = fn(g["y"].to_numpy(), g[score].to_numpy(), w[i, r])
    return out


@pytest.mark.parametrize("partitions", ["4", "23"])
@pytest.mark.parametrize("draws,fn", [(auroc_draws, auroc), (auprc_draws, precision)])
def test_every_replicate_equals_brute_force(spark, rows, data, draws, fn, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.cell, r.rep): r.value for r in draws(R.hashed(rows, 42, ["unit"]), ["cell"], B).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = brute(data, "cell", fn)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_intervals_delta_and_gap_equal_brute_force(rows, data):
    a, b = brute(data, "cell", auroc), brute(data, "cell", auroc, "q")
    got = {r.cell: r for r in R.bootstrap_delta(rows, ["cell"], "p", "q", b=B, unit="unit").collect()}
    for c in "cd":
        d = np.array([b[c, r] - a[c, r] for r in range(B)])
        assert [got[c].ci_low, got[c].ci_high] == pytest.approx(np.quantile(d, [0.025, 0.975]).tolist(), abs=1e-12)
        share = (d < 0).mean() if got[c].delta >= 0 else (d > 0).mean()
        assert got[c].p_value == pytest.approx(min(1, 2 * share))
    per, w = brute(data, ["cell", "grp"], auroc), weights_of(data)
    for drop, least in ((True, 24), (False, 24)):
        got = {r.cell: r for r in R.bootstrap_gap(rows, ["cell"], b=B, unit="unit", min_n=least, min_side=6, drop_draw=drop).collect()}
        for c in "cd":
            gaps = []
            for r in range(B):
                ok = []
                for g in "abc":
                    i = data.index[(data.cell == c) & (data.grp == g)]
                    n, pos = w[i, r].sum(), w[i, r][data.y[i] == 1].sum()
                    if n >= least and min(pos, n - pos) >= 6:
                        ok.append(per[c, g, r])
                if len(ok) == 3 or (not drop and len(ok) >= 2):
                    gaps.append(max(ok) - min(ok))
            assert got[c].n_draws == len(gaps)
            if len(gaps) >= 10:
                assert [got[c].ci_low, got[c].ci_high] == pytest.approx(np.quantile(gaps, [0.025, 0.975]).tolist(), abs=1e-12)


def test_observed_gap_follows_the_rule_of_the_draws(rows):
    strict = R.bootstrap_gap(rows, ["cell"], b=12, unit="unit", min_n=100, drop_draw=True).collect()
    assert {r.cell: r.gap is None for r in strict} == {"c": False, "d": True}  # groups of d have fewer rows


def test_counts_of_equal_rows_draw_poisson_of_the_count(spark):
    w = poisson_weights(np.array([7, 7, 8]), np.array([5_000_000, 5_000_000, 1]), 2000)
    assert (w[0] == w[1]).all() and abs(w[0].mean() - 5e6) < 300 and 0.9 < w[0].var() / 5e6 < 1.1
    assert abs(w[2].mean() - 1) < 0.1 and abs(w[2].var() - 1) < 0.15
    got = spark.range(3).select(row_hash(42, "id").alias("h")).collect()
    assert [r.h for r in got] == [md5_hash(42, k) for k in range(3)] and CUTS == sorted(CUTS)


def test_weighted_sums_and_stable_slopes(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=300) + 1e7, rng.normal(size=300)
    data = pd.DataFrame({"unit": range(300), "x": x, "y": y + 0.5 * (x - 1e7) + 1e7})
    df = spark.createDataFrame(data)
    w = weights_of(data, 60)
    got = {r.rep: r.s for r in weighted_sums(R.hashed(df, 42, ["unit"]), [], {"s": F.col("y") - 1e7}, 60).collect()}
    assert [got[r] for r in range(60)] == pytest.approx(((data.y.to_numpy() - 1e7) @ w).tolist(), rel=1e-9)
    slopes = [np.polyfit(data.x - 1e7, data.y - 1e7, 1, w=np.sqrt(w[:, r]))[0] for r in range(60)]
    r = R.bootstrap_slope(df, [], "x", "y", "unit", b=60).first()
    assert [r.ci_low, r.ci_high] == pytest.approx(np.quantile(slopes, [0.025, 0.975]).tolist(), rel=1e-6)


def test_r2_and_means_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"unit": range(200), "y": rng.normal(size=200) + 1e6})
    data["p"] = data.y + rng.normal(size=200) * 0.3
    df, w = spark.createDataFrame(data), weights_of(data, 50)
    y, p = data.y.to_numpy(), data.p.to_numpy()
    r2 = [1 - (w[:, r] * (y - p) ** 2).sum() / (w[:, r] * (y - np.average(y, weights=w[:, r])) ** 2).sum() for r in range(50)]
    got = R.bootstrap_ci(df, [], "r2", b=50, unit="unit").first()
    assert [got.ci_low, got.ci_high] == pytest.approx(np.quantile(r2, [0.025, 0.975]).tolist(), rel=1e-7)
    mae = [np.average(np.abs(y - p), weights=w[:, r]) for r in range(50)]
    got = R.bootstrap_ci(df, [], "mae", b=50, unit="unit").first()
    assert [got.ci_low, got.ci_high] == pytest.approx(np.quantile(mae, [0.025, 0.975]).tolist(), rel=1e-7)


def test_dealing_keeps_totals_and_follows_the_distribution():
    rng = np.random.default_rng(3)
    left = np.tile(np.array([30, 20, 50]), (4000, 1))
    for count in (1, 17):
        got = permute.dealt(rng, left, count)
        assert (got.sum(1) == count).all() and (got <= left).all() and (got >= 0).all()
        assert got.mean(0) == pytest.approx(count * np.array([0.3, 0.2, 0.5]), abs=0.12)
    assert (permute.dealt(rng, left, 100) == left).all()


@pytest.mark.parametrize("partitions", ["4", "23"])
def test_permutations_equal_brute_force_within_sampling_error(spark, rows, data, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        labels = {r.cell: r for r in R.permutation_auroc(rows, ["cell"], b=1000).collect()}
        groups = {r.cell: r for r in R.permutation_gap(rows, ["cell"], b=1000).collect()}
        again = {r.cell: r for r in R.permutation_auroc(rows, ["cell"], b=1000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(again[c].p_value == r.p_value and again[c].null_std == pytest.approx(r.null_std, abs=1e-12) for c, r in labels.items())
    rng = np.random.default_rng(9)
    for c, g in data.groupby("cell"):
        y, s, grp, one = g.y.to_numpy(), g.p.to_numpy(), g.grp.to_numpy(), np.ones(len(g))
        null = np.array([auroc(rng.permutation(y), s, one) for _ in range(400)])
        assert labels[c].auroc == pytest.approx(auroc(y, s, one)) and labels[c].p_value <= (null >= labels[c].auroc).mean() + 0.01
        assert labels[c].null_mean == pytest.approx(0.5, abs=4 * null.std() / 30) and labels[c].null_std == pytest.approx(null.std(), rel=0.15)
        spread = lambda k: np.ptp([auroc(y[k == x], s[k == x], one[k == x]) for x in "abc"])
        gaps = np.array([spread(rng.permutation(grp)) for _ in range(400)])
        share = (gaps >= spread(grp)).mean()
        assert groups[c].n_draws == 1000 and groups[c].gap == pytest.approx(spread(grp))
        assert groups[c].p_value == pytest.approx(share, abs=4 * np.sqrt(0.25 / 400) * max(0.3, 2 * np.sqrt(share * (1 - share))))


def test_rows_are_not_copied_per_replicate(rows):
    plan = auroc_draws(R.hashed(rows, 42, ["unit"]), ["cell"], 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("FlatMapGroupsInArrow")  # the plan is printed from the top
    assert plan.count("Generate") == 1


def test_md5_grid_equals_hashlib():
    from attraudit.functions.md5 import as_bytes, md5_grid

    texts = as_bytes(["", "é:x", "17", "a" * 54, "b" * 60, *map(str, range(40))])
    prefixes = ["", "7:", "42:19:R:O:", "x" * 50]
    got = md5_grid(prefixes, texts)
    assert [[int(hashlib.md5(p.encode() + t).hexdigest()[:16], 16) for t in texts.tolist()] for p in prefixes] == got.tolist()


def test_work_of_draws_is_dealt_to_many_tasks(spark, rows):
    few = rows.coalesce(1).withColumn("h", row_hash(42, "unit")).withColumn("m", F.lit(1))  # AQE would join so few rows into one task
    for out in (weighted_sums(few, ["cell"], {"x": F.col("p")}, B), auroc_draws(few, ["cell"], B)):
        out.collect()
        assert f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()


def test_picks_of_many_blocks_and_null_keys(spark, monkeypatch):
    from attraudit.operators import picks

    monkeypatch.setattr(picks, "VALUES", 7)
    panel = [(m, i, float(i * i % 11)) for m in ("a", None) for i in range(20)]
    base = spark.createDataFrame([(m, i + 1, v) for m, i, v in panel], "m string, i int, v double")
    got = {(r["m"], r["rep"]): r["value"] for r in picks.picked_means(base, ["m"], 9, 42).collect()}
    for m in ("a", None):
        v = [x[2] for x in panel if x[0] == m]
        for rep in range(9):
            at = [int(int(hashlib.md5(":".join(map(str, [42, rep, *([m] if m else []), d])).encode()).hexdigest()[:8], 16) / 2**32 * 20) for d in range(1, 21)]
            assert got[m, rep] == pytest.approx(np.mean([v[k] for k in at]))


def test_first_flags_over_batches_and_a_null_entity(spark):
    from attraudit.operators.cohort import one_per_entity_patterns

    rng = np.random.default_rng(8)
    data = [(None if e == 5 else int(e), u, int(f)) for u, (e, f) in enumerate(zip(np.sort(rng.integers(0, 9, 300)), rng.integers(0, 2, 300)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["seed"], r["f"]): r["n"] for r in one_per_entity_patterns(spark.createDataFrame(data, "e int, u int, f int"), "e", "u", ["f"], [1, 23]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for seed in (1, 23):
        for e in {x[0] for x in data}:
            f = min((hashlib.md5(f"{seed}:{u}".encode()).hexdigest(), f) for k, u, f in data if k == e)[1]
            want[seed, f] = want.get((seed, f), 0) + 1
    assert got == want
