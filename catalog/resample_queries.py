"""Bootstrap and permutation queries at the operators' full number of draws.

A weight follows from the md5 of its row and the replicate, so SQL can repeat it where it stays quick; the
others are held against brute force in tests/test_draws.py.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from attraudit.functions.rand import poisson_cuts
from attraudit.functions.weights import CUTS, MIX, STEP
from attraudit.operators import resample as R

from .base import SCORES_SQL, query, r, read, scores
from .fairness_queries import PANEL_SQL, panel

S = f"WITH {SCORES_SQL}"
CELL = ["model", "finding"]
B, SLOPES, RANKS = 1000, 2000, 10_000


def u_sql(*parts, seed=42):
    text = " || ':' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def w_sql(*parts, seed=42):
    return "(" + " + ".join(f"({u_sql(*parts, seed=seed)} >= {c!r}::DOUBLE)::INT" for c in poisson_cuts()) + ")"


def reps_sql(src: str, cols: str, unit: str, b: int = B, seed: int = 42, name: str = "drawn") -> str:
    """Rows repeated by their Poisson weight in every replicate."""
    return (
        f"us AS (SELECT DISTINCT {unit} AS uu FROM {src}), rp AS (SELECT unnest(range({b})) AS rep), "
        f"uw AS (SELECT uu, rep, {w_sql('rep', 'uu', seed=seed)} AS w FROM us, rp), "
        f"{name} AS (SELECT rep, {cols}, unnest(range(w)) AS copy FROM {src} JOIN uw ON {unit} = uu WHERE w > 0)"
    )


def weights_sql(src: str, unit: str, b: int = B, seed: int = 42) -> str:
    """wt(uu, rep, w): the Poisson weight of every unit in every replicate."""
    low, high = MIX & 0xFFFFFFFF, MIX >> 32  # products modulo 2**64 in halves
    top = f"(((x >> 32) * {low} & 4294967295) + ((x & 4294967295) * {high} & 4294967295) + ((x & 4294967295) * {low} >> 32) & 4294967295)"
    folded = "xor(x, x >> 32) AS x"
    return (
        f"us AS (SELECT DISTINCT {unit} AS uu FROM {src}), hs AS (SELECT uu, ('0x' || substr(md5('{seed}:' || uu), 1, 15))::BIGINT AS h FROM us), "
        f"x0 AS (SELECT uu, rep, ((h::UHUGEINT + step) % 18446744073709551616)::UBIGINT AS x FROM hs, (SELECT rep, (rep::UHUGEINT * {STEP}) % 18446744073709551616 AS step FROM (SELECT unnest(range({b})) AS rep))), "
        f"f0 AS (SELECT uu, rep, {folded} FROM x0), x1 AS (SELECT uu, rep, ({top} << 32) + ((x & 4294967295) * {low} & 4294967295) AS x FROM f0), "
        f"f1 AS (SELECT uu, rep, {folded} FROM x1), x2 AS (SELECT uu, rep, {top} AS u FROM f1), "
        f"wt AS (SELECT uu, rep, {' + '.join(f'(u >= {c})::INT' for c in CUTS)} AS w FROM x2)"
    )


def ci_sql(v: str = "v") -> str:
    return (f"count({v}) AS n_draws, {r(f'CASE WHEN count({v}) >= 10 THEN quantile_cont({v}, 0.025) END', 'ci_low')}, "
            f"{r(f'CASE WHEN count({v}) >= 10 THEN quantile_cont({v}, 0.975) END', 'ci_high')}")


@query("bootstrap_auroc")
def bootstrap_auroc(spark, sf):
    return R.bootstrap_ci(scores(spark, sf), CELL, "auroc", b=B, unit="unit_id")


@query("bootstrap_brier", f"""{S}, {weights_sql('scores', 'unit_id')},
a AS (SELECT model, finding, rep, sum(w * (y - p) * (y - p)) / sum(w) AS v FROM scores JOIN wt ON unit_id = uu GROUP BY ALL), c AS (SELECT model, finding, {ci_sql()} FROM a GROUP BY ALL)
SELECT model, finding, {r('avg((y - p) * (y - p))', 'point')}, any_value(n_draws) AS n_draws, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high
FROM scores JOIN c USING (model, finding) GROUP BY ALL""")
def bootstrap_brier(spark, sf):
    return R.bootstrap_ci(scores(spark, sf), CELL, "brier", b=B, unit="unit_id")


@query("bootstrap_auprc")
def bootstrap_auprc(spark, sf):
    return R.bootstrap_ci(scores(spark, sf), CELL, "auprc", b=B, unit="unit_id")


@query("subgroup_intervals")
def subgroup_intervals(spark, sf):
    from attraudit.plans.outcomes import subgroup_intervals as intervals

    return intervals(scores(spark, sf), CELL, "unit_id", b=B)


_R2 = "1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*))"
_R2_W = "1 - sum(w * (y - p) ** 2) / (sum(w * y * y) - sum(w * y) ** 2 / sum(w))"


@query("bootstrap_regression", f"""WITH li AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, l_quantity AS p, l_orderkey * 10 + l_linenumber AS unit_id FROM lineitem),
{weights_sql('li', 'unit_id')}, m AS (SELECT flag, 'mae' AS metric, avg(abs(y - p)) AS point FROM li GROUP BY flag UNION ALL SELECT flag, 'r2', {_R2} FROM li GROUP BY flag),
t AS (SELECT flag, rep, sum(w * abs(y - p)) / sum(w) AS mae, {_R2_W} AS r2 FROM li JOIN wt ON unit_id = uu GROUP BY ALL),
a AS (SELECT flag, 'mae' AS metric, rep, mae AS v FROM t UNION ALL SELECT flag, 'r2', rep, r2 FROM t),
c AS (SELECT flag, metric, {ci_sql()} FROM a GROUP BY ALL) SELECT flag, metric, {r('point', 'point')}, n_draws, ci_low, ci_high FROM m JOIN c USING (flag, metric)""")
def bootstrap_regression(spark, sf):
    li = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("p"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"),
    )
    mae = R.bootstrap_ci(li, ["flag"], "mae", b=B, unit="unit_id").withColumn("metric", F.lit("mae"))
    return mae.unionByName(R.bootstrap_ci(li, ["flag"], "r2", b=B, unit="unit_id").withColumn("metric", F.lit("r2")))


def wide(spark, sf):
    s = scores(spark, sf)
    return s.groupBy("unit_id", "finding").agg(
        F.max("y").alias("y"), F.max(F.when(F.col("model") == "a", F.col("p"))).alias("pa"),
        F.max(F.when(F.col("model") == "b", F.col("p"))).alias("pb"),
    )


@query("bootstrap_delta")
def bootstrap_delta(spark, sf):
    return R.bootstrap_delta(wide(spark, sf), ["finding"], "pa", "pb", b=B, unit="unit_id")


@query("bootstrap_gap_pooled")
def bootstrap_gap_pooled(spark, sf):
    return R.bootstrap_gap(scores(spark, sf), CELL, b=B, unit="unit_id")


@query("bootstrap_gap_within")
def bootstrap_gap_within(spark, sf):
    return R.bootstrap_gap(scores(spark, sf), CELL, b=B, unit="unit_id", min_side=3, drop_draw=False)


@query("bootstrap_mean_panel", f"""WITH {PANEL_SQL}, s AS (SELECT model, finding, attribute, avg(drop_v) AS v FROM panel GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY model, finding ORDER BY attribute) AS i FROM s), z AS (SELECT model, finding, count(*) AS n, avg(v) AS point FROM s GROUP BY ALL),
d AS (SELECT model, finding, n, rep, unnest(range(1, n + 1)) AS d FROM z, (SELECT unnest(range({B})) AS rep)),
k AS (SELECT model, finding, rep, floor({u_sql('rep', 'model', 'finding', 'd')} * n)::BIGINT + 1 AS i FROM d),
m AS (SELECT model, finding, rep, avg(v) AS v FROM k JOIN i USING (model, finding, i) GROUP BY ALL),
c AS (SELECT model, finding, {ci_sql()} FROM m GROUP BY ALL)
SELECT model, finding, n, {r('point', 'point')}, n_draws, ci_low, ci_high FROM z JOIN c USING (model, finding)""")
def bootstrap_mean_panel(spark, sf):
    s = panel(spark, sf).groupBy("model", "finding", "attribute").agg(F.avg("drop_v").alias("v"))
    return R.bootstrap_mean_exact(s, ["model", "finding"], "attribute", "v", b=B)


@query("bootstrap_slope", f"""WITH e AS (SELECT event_id, event_type AS cell, event_id % 97 AS x, value AS y FROM events), {weights_sql('e', 'event_id', SLOPES)},
mean AS (SELECT cell, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS point FROM e GROUP BY cell), z AS (SELECT cell, event_id, point, x - mx AS x, y - my AS y FROM e JOIN mean USING (cell)),
m AS (SELECT cell, rep, any_value(point) AS point, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) ** 2 / sum(w)) AS v FROM z JOIN wt ON event_id = uu GROUP BY ALL)
SELECT cell, {r('any_value(point)', 'point')}, {ci_sql()} FROM m GROUP BY cell""")
def bootstrap_slope(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("event_type").alias("cell"), (F.col("event_id") % 97).alias("x"), F.col("value").alias("y"))
    return R.bootstrap_slope(e, ["cell"], "x", "y", "event_id", b=SLOPES)


@query("bootstrap_spearman", f"""WITH {PANEL_SQL}, e AS (SELECT attribute, round(avg(drop_v), 9) AS x, round(avg(added), 9) AS y FROM panel GROUP BY attribute), {reps_sql('e', 'x, y', 'attribute', RANKS)},
al AS (SELECT -1 AS rep, x, y FROM e UNION ALL SELECT rep, x, y FROM drawn),
k AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0::DOUBLE AS b FROM al),
c AS (SELECT rep, corr(a, b) AS v FROM k GROUP BY rep)
SELECT {r('max(v) FILTER (WHERE rep = -1)', 'point')}, count(v) FILTER (WHERE rep >= 0) AS n_draws, {r('quantile_cont(v, 0.025) FILTER (WHERE rep >= 0)', 'ci_low')}, {r('quantile_cont(v, 0.975) FILTER (WHERE rep >= 0)', 'ci_high')} FROM c""")
def bootstrap_spearman(spark, sf):
    e = panel(spark, sf).groupBy("attribute").agg(F.round(F.avg("drop_v"), 9).alias("x"), F.round(F.avg("added"), 9).alias("y"))
    return R.bootstrap_spearman(e, [], "x", "y", "attribute", b=RANKS, small=True)


@query("permutation_auroc")
def permutation_auroc(spark, sf):
    return R.permutation_auroc(scores(spark, sf), CELL, "unit_id", b=B)


@query("permutation_gap")
def permutation_gap(spark, sf):
    return R.permutation_gap(scores(spark, sf), CELL, "unit_id", b=B)
