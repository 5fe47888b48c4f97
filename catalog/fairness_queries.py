"""Subgroup, gap and result-table summary queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from attraudit.operators import fairness, ranking, summary
from attraudit.operators.panel import spearman

from .base import LINES_SQL, SCORES_SQL, auroc_expr, line_scores, midrank_sql, query, r, read, scores

S = f"WITH {SCORES_SQL}"
CELL = ["model", "finding"]
GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

SUB_SQL = f"""k AS ({midrank_sql('scores', 'model, finding, grp')}),
au AS (SELECT model, finding, grp, count(*) AS n, count(*) FILTER (WHERE y=1) AS n_pos, {auroc_expr()} AS auroc FROM k GROUP BY ALL)"""
_EDGES = " + ".join(f"(p >= {i * 0.1!r}::DOUBLE)::INT" for i in range(10))


@query("subgroup_metrics", f"""{S}, {SUB_SQL},
t AS (SELECT model, finding, grp, p, count(*) FILTER (WHERE y=1) AS pos, count(*) AS m FROM scores GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(m) OVER w AS called, sum(pos) OVER (PARTITION BY model, finding, grp) AS np FROM t WINDOW w AS (PARTITION BY model, finding, grp ORDER BY p DESC)),
ap AS (SELECT model, finding, grp, sum(pos / np::DOUBLE * tp / called) AS auprc FROM c GROUP BY ALL),
b AS (SELECT model, finding, grp, CASE WHEN p >= 0 AND p < 1 THEN {_EDGES} - 1 END AS b, count(*) AS n, sum(y) AS sy, sum(p) AS sp, sum((p - y) * (p - y)) AS se FROM scores GROUP BY ALL),
e AS (SELECT model, finding, grp, sum(CASE WHEN b IS NOT NULL THEN abs(sy - sp) ELSE 0 END) / sum(n) AS ece, sum(se) / sum(n) AS brier FROM b GROUP BY ALL),
z AS (SELECT *, n >= 50 AND n_pos >= 15 AND n - n_pos >= 15 AS ok FROM au JOIN ap USING (model, finding, grp) JOIN e USING (model, finding, grp))
SELECT model, finding, grp, n, n_pos, {r('n_pos / n::DOUBLE', 'prevalence')}, ok AS sufficient_data, {r('CASE WHEN ok THEN auroc END', 'auroc')},
 {r('CASE WHEN ok THEN auprc END', 'auprc')}, {r('CASE WHEN ok THEN ece END', 'ece')}, {r('CASE WHEN ok THEN brier END', 'brier')} FROM z""")
def subgroup_metrics(spark, sf):
    return fairness.subgroup_metrics(scores(spark, sf), CELL)


@query("subgroup_auroc_wide", f"""{S}, {SUB_SQL} SELECT model, finding, """ + ", ".join(
    r(f"max(auroc) FILTER (WHERE grp = '{g}')", f'"{g}"') for g in GROUPS) + " FROM au GROUP BY ALL")
def subgroup_wide(spark, sf):
    return fairness.widen(fairness.subgroup_auroc(scores(spark, sf), CELL), CELL, "grp", GROUPS, "auroc")


@query("subgroup_gap", f"""{S}, {SUB_SQL} SELECT model, finding, count(*) AS n_groups, arg_max(grp, auroc) AS max_group, arg_min(grp, auroc) AS min_group,
 {r('max(auroc)', 'max_value')}, {r('min(auroc)', 'min_value')}, {r('max(auroc) - min(auroc)', 'gap')} FROM au GROUP BY ALL""")
def subgroup_gap(spark, sf):
    return fairness.gap(fairness.subgroup_auroc(scores(spark, sf), CELL), CELL)


@query("gap_any_metric", f"""{S}, c AS (SELECT model, finding, grp, count(*) FILTER (WHERE p >= 0.5 AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE AS sensitivity,
 count(*) FILTER (WHERE p < 0.5 AND y = 0) / nullif(count(*) FILTER (WHERE y = 0), 0)::DOUBLE AS specificity FROM scores GROUP BY ALL),
l AS (SELECT model, finding, grp, 'sensitivity' AS metric, sensitivity AS v FROM c UNION ALL SELECT model, finding, grp, 'specificity', specificity FROM c
 UNION ALL SELECT model, finding, grp, 'fpr', 1 - specificity FROM c UNION ALL SELECT model, finding, grp, 'fnr', 1 - sensitivity FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY model, finding, metric ORDER BY v DESC, grp DESC) AS hi, row_number() OVER (PARTITION BY model, finding, metric ORDER BY v, grp) AS lo FROM l)
SELECT model, finding, metric, count(*) AS n_groups, max(grp) FILTER (WHERE hi = 1) AS max_group, max(grp) FILTER (WHERE lo = 1) AS min_group,
 {r('max(v)', 'max_value')}, {r('min(v)', 'min_value')}, {r('max(v) - min(v)', 'gap')} FROM x GROUP BY ALL""")
def gap_any_metric(spark, sf):
    per = fairness.group_rates(scores(spark, sf), CELL, F.lit(0.5))
    return fairness.gap_any_metric(per, CELL, ["sensitivity", "specificity", "fpr", "fnr"])


@query("equalized_odds", f"""{S}, c AS (SELECT model, finding, grp, count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE y = 1)::DOUBLE AS tpr,
 count(*) FILTER (WHERE p >= 0.5 AND y = 0) / count(*) FILTER (WHERE y = 0)::DOUBLE AS fpr FROM scores GROUP BY ALL)
SELECT model, finding, count(*) AS n_groups, {r('max(tpr) - min(tpr)', 'tpr_gap')}, {r('max(fpr) - min(fpr)', 'fpr_gap')}, {r('max(tpr) - min(tpr) + max(fpr) - min(fpr)', 'eq_odds_diff')} FROM c GROUP BY ALL""")
def equalized_odds(spark, sf):
    return fairness.equalized_odds(scores(spark, sf), CELL, F.lit(0.5))


@query("base_rates", f"""{S} SELECT model, finding, grp, count(*) AS n, sum(y)::BIGINT AS n_pos, {r('avg(y)', 'prevalence')} FROM scores GROUP BY ALL HAVING count(*) >= 30""")
def base_rates(spark, sf):
    return fairness.base_rates(scores(spark, sf), CELL)


@query("base_rate_spread", f"""{S}, b AS (SELECT finding, grp, avg(y) AS p FROM scores WHERE model = 'a' GROUP BY ALL HAVING count(*) >= 30)
SELECT finding, {r('max(p) - min(p)', 'spread')}, {r('max(p)', 'max_prevalence')}, {r('min(p)', 'min_prevalence')} FROM b GROUP BY finding""")
def base_rate_spread(spark, sf):
    return fairness.base_rate_spread(scores(spark, sf).where("model = 'a'"), ["finding"])


_CAL = f"""{SUB_SQL}, e AS (SELECT model, finding, grp, avg((p - y) * (p - y)) AS brier, avg(p) AS mean_p, avg(y) AS prevalence FROM scores GROUP BY ALL)"""


@query("calibration_by_group", f"""{S}, {_CAL} SELECT model, finding, grp, n, n_pos, {r('auroc', 'auroc')}, {r('brier', 'brier')}, {r('mean_p', 'mean_p')}, {r('prevalence', 'prevalence')},
 {r('mean_p - prevalence', 'calibration_gap')} FROM au JOIN e USING (model, finding, grp)""")
def calibration_by_group(spark, sf):
    return fairness.calibration_by_group(scores(spark, sf), CELL)


@query("calibration_spearman", f"""{S}, {_CAL}, j AS (SELECT model, round(auroc, 9) AS a, round(prevalence, 9) AS p FROM au JOIN e USING (model, finding, grp)),
kk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS rp FROM j)
SELECT model, count(*) AS n, {r('corr(ra, rp)', 'rho')} FROM kk GROUP BY model""")
def calibration_spearman(spark, sf):
    c = fairness.calibration_by_group(scores(spark, sf), CELL)
    c = c.select("model", F.round("auroc", 9).alias("a"), F.round("prevalence", 9).alias("p"))
    return spearman(c, ["model"], "a", "p", small=True).select("model", "n", "rho")


@query("before_after", f"""WITH {LINES_SQL}, k AS ({midrank_sql('lines', 'finding, grp')}), a AS (SELECT finding, grp, {auroc_expr()} AS auroc FROM k GROUP BY ALL)
SELECT x.finding, x.grp, {r('b.auroc', 'before')}, {r('x.auroc', 'after')}, {r('b.auroc - x.auroc', 'reduction')} FROM a x JOIN a b ON x.finding = b.finding AND b.grp = 'line1' WHERE x.grp <> 'line1'""")
def before_after(spark, sf):
    a = ranking.auroc(line_scores(spark, sf), ["finding", "grp"])
    return fairness.before_after(a, ["finding"], "grp", "line1", "auroc")


PANEL_SQL = """panel AS (SELECT l_suppkey AS attribute, l_returnflag AS model, l_linestatus AS finding, l_linenumber AS seed,
 avg(l_discount) AS drop_v, avg(l_tax) AS added FROM lineitem GROUP BY ALL)"""


def panel(spark, sf):
    """A result panel (attribute, model, finding, seed) built from line items."""
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("attribute"), F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("finding"), F.col("l_linenumber").alias("seed"),
    ).agg(F.avg("l_discount").alias("drop_v"), F.avg("l_tax").alias("added"))


@query("attribute_summary", f"""WITH {PANEL_SQL} SELECT attribute, {r('avg(drop_v)', 'mean_drop_v')}, {r('quantile_cont(drop_v, 0.5)', 'median_drop_v')},
 {r('stddev_samp(drop_v)', 'std_drop_v')}, count(drop_v) AS n_obs FROM panel GROUP BY attribute""")
def attribute_summary(spark, sf):
    return summary.summarize(panel(spark, sf), ["attribute"], "drop_v")


@query("seed_average", f"""WITH {PANEL_SQL}, s AS (SELECT model, finding, seed, avg(drop_v) AS d FROM panel GROUP BY ALL)
SELECT model, finding, {r('avg(d)', 'd_mean')}, {r('stddev_pop(d)', 'd_std')}, count(d) AS n_seeds FROM s GROUP BY ALL""")
def seed_average(spark, sf):
    s = panel(spark, sf).groupBy("model", "finding", "seed").agg(F.avg("drop_v").alias("d"))
    return summary.over_seeds(s, ["model", "finding"], "d")


@query("overall_row", f"""WITH {PANEL_SQL}, s AS (SELECT model, finding, seed, avg(drop_v) AS v FROM panel GROUP BY ALL
 UNION ALL SELECT model, 'MEAN', seed, avg(drop_v) FROM panel GROUP BY model, seed)
SELECT model, finding, {r('avg(v)', 'drop_v_mean')}, {r('stddev_pop(v)', 'drop_v_std')}, count(v) AS n_seeds FROM s GROUP BY ALL""")
def overall_row(spark, sf):
    return summary.with_overall(panel(spark, sf), ["model"], "finding", "seed", "drop_v")


@query("condition_summary", """WITH m AS (SELECT avg(l_discount) AS a, avg(l_tax) AS b, avg(l_discount * l_tax) AS c FROM lineitem),
l AS (SELECT 'l_discount' AS condition, a AS v, a AS base FROM m UNION ALL SELECT 'l_tax', b, a FROM m UNION ALL SELECT 'both', c, a FROM m)
SELECT condition, round(v, 6) AS mean_gap, (SELECT count(*) FROM lineitem) AS n_cells, round(base - v, 6) + 0.0::DOUBLE AS gap_reduction, round((base - v) / greatest(base, 1e-9) * 100, 6) + 0.0::DOUBLE AS pct_reduction FROM l""")
def condition_summary(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("both", F.col("l_discount") * F.col("l_tax"))
    return summary.condition_summary(li, ["l_discount", "l_tax", "both"], "l_discount")


_G36 = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a in (0.02, 0.03, 0.04, 0.05) for b in (0.03, 0.05, 0.07) for c in (0.06, 0.08, 0.1))


@query("confounding_grid", f"""WITH {PANEL_SQL}, g(a, b, c) AS (VALUES {_G36}),
k AS (SELECT a, b, c, CASE WHEN drop_v < a AND added > b THEN 'g' WHEN drop_v >= c OR added < 0.03::DOUBLE THEN 'h' ELSE 'p' END AS k FROM panel, g)
SELECT a AS genuine_max_drop, b AS genuine_min_added, c AS heavy_min_drop, count(*) FILTER (WHERE k='g') AS genuine, count(*) FILTER (WHERE k='p') AS partially_confounded,
 count(*) FILTER (WHERE k='h') AS heavily_confounded, 0::BIGINT AS unknown FROM k GROUP BY ALL""")
def confounding_grid(spark, sf):
    return summary.confounding_grid(panel(spark, sf), "drop_v", "added")


ENC_SQL = """enc AS (SELECT l_suppkey AS attribute, CASE WHEN l_suppkey % 2 = 0 THEN 'auroc' ELSE 'r2' END AS encoding_metric,
 CASE WHEN l_suppkey % 2 = 0 THEN 0.6 + 4 * (avg(l_discount) - 0.045) ELSE 10 * (avg(l_tax) - 0.03) END AS encoding_value,
 abs(avg(l_discount * l_tax) - 0.002) * 8 AS dependence FROM lineitem GROUP BY l_suppkey)"""


def encodings(spark, sf):
    a = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("attribute")).agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg(F.col("l_discount") * F.col("l_tax")).alias("dt")
    )
    even = F.col("attribute") % 2 == 0
    return a.select(
        "attribute", F.when(even, "auroc").otherwise("r2").alias("encoding_metric"),
        F.when(even, 0.6 + 4 * (F.col("d") - 0.045)).otherwise(10 * (F.col("t") - 0.03)).alias("encoding_value"),
        (F.abs(F.col("dt") - 0.002) * 8).alias("dependence"),
    )


def _pattern(a, r2, d):
    enc = f"encoding_value > CASE WHEN encoding_metric = 'auroc' THEN {a} ELSE {r2} END"
    return (f"CASE WHEN {enc} AND NOT dependence > {d} THEN 'ORTHOGONAL' WHEN {enc} THEN 'Entangled' "
            f"WHEN dependence > {d} THEN 'Hidden conf.' ELSE 'Irrelevant' END")


_ENC, _DEP = summary.ENCODING_SWEEP, summary.DEPENDENCE_SWEEP
_SWEEP = ", ".join([f"('encoding', {a}::DOUBLE, {b}::DOUBLE, 0.005::DOUBLE)" for a, b in _ENC] + [f"('dependence', 0.7::DOUBLE, 0.1::DOUBLE, {d}::DOUBLE)" for d in _DEP])


@query("pattern_sweep", f"""WITH {ENC_SQL}, g(sweep, a, b, d) AS (VALUES {_SWEEP}),
k AS (SELECT sweep, a, b, d, {_pattern('a', 'b', 'd')} AS p, {_pattern('0.7::DOUBLE', '0.1::DOUBLE', '0.005::DOUBLE')} AS ref FROM enc, g)
SELECT sweep, a AS auroc_cut, b AS r2_cut, d AS dependence_cut, count(*) FILTER (WHERE p = 'ORTHOGONAL') AS n_orthogonal, count(*) FILTER (WHERE p = 'Entangled') AS n_entangled,
 count(*) FILTER (WHERE p = 'Hidden conf.') AS n_hidden, count(*) FILTER (WHERE p = 'Irrelevant') AS n_irrelevant, count(*) FILTER (WHERE p <> ref) AS n_changed FROM k GROUP BY ALL""")
def pattern_sweep(spark, sf):
    return summary.pattern_sweep(encodings(spark, sf))


_BOTH = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for a, b in _ENC for d in _DEP)


@query("pattern_stability", f"""WITH {ENC_SQL}, g(a, b, d) AS (VALUES {_BOTH}),
k AS (SELECT attribute, {_pattern('a', 'b', 'd')} AS p, {_pattern('0.7::DOUBLE', '0.1::DOUBLE', '0.005::DOUBLE')} AS ref FROM enc, g),
n AS (SELECT attribute, p, count(*) AS c FROM k GROUP BY ALL), m AS (SELECT attribute, p FROM n QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY c DESC, p) = 1)
SELECT attribute, max(ref) AS reference_pattern, {r('avg((k.p = ref)::INT)', 'stability')}, max(m.p) AS most_common_pattern, count(*) AS n_combinations FROM k JOIN m USING (attribute) GROUP BY attribute""")
def pattern_stability(spark, sf):
    return summary.pattern_stability(encodings(spark, sf))


@query("top_k_per_group", """SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3""")
def top_k_per_group(spark, sf):
    p = read(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return summary.top_k_per_group(p, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3)


@query("rank_differences", f"""WITH {ENC_SQL}, e AS (SELECT attribute, round(encoding_value, 9) AS encoding_value, round(dependence, 9) AS dependence FROM enc)
SELECT attribute, {r('encoding_value', 'encoding_value')}, {r('dependence', 'dependence')},
 rank() OVER (ORDER BY encoding_value DESC) + (count(*) OVER (PARTITION BY encoding_value) - 1) / 2.0::DOUBLE AS encoding_value_rank,
 rank() OVER (ORDER BY dependence DESC) + (count(*) OVER (PARTITION BY dependence) - 1) / 2.0::DOUBLE AS dependence_rank,
 dependence_rank - encoding_value_rank AS rank_gap FROM e""")
def rank_differences(spark, sf):
    e = encodings(spark, sf).select("attribute", F.round("encoding_value", 9).alias("encoding_value"), F.round("dependence", 9).alias("dependence"))
    return summary.rank_differences(e, "encoding_value", "dependence")


@query("best_under_constraint", """WITH c AS (SELECT p_brand, p_partkey, p_size, p_retailprice, p_size <= 10 AS ok FROM part),
b AS (SELECT p_brand, p_partkey FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) = 1),
f AS (SELECT p_brand, p_partkey FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1)
SELECT f.p_brand, coalesce(b.p_partkey, f.p_partkey) AS p_partkey FROM f LEFT JOIN b USING (p_brand)""")
def best_under_constraint(spark, sf):
    return summary.best_under_constraint(read(spark, sf, "part"), ["p_brand"], F.col("p_size") <= 10, "p_retailprice", "p_size", "p_partkey")


@query("histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 30) + 1, 30)::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def histogram(spark, sf):
    return summary.histogram(read(spark, sf, "lineitem"), "l_extendedprice")


@query("quality_gate", f"""{S}, k AS ({midrank_sql('scores', 'model, finding')}), a AS (SELECT {auroc_expr()} AS auroc FROM k GROUP BY model, finding)
SELECT {r('avg(auroc)', 'mean_auroc')}, count(auroc) AS n_findings, CASE WHEN avg(auroc) >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a""")
def quality_gate(spark, sf):
    return summary.quality_gate(ranking.auroc(scores(spark, sf), CELL))


@query("redundancy", f"""WITH c AS (SELECT l_suppkey AS cell, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_discount + l_tax) / 1.5 AS j FROM lineitem GROUP BY 1)
SELECT cell, {r('a', 'a')}, {r('b', 'b')}, {r('j', 'j')}, {r('a + b', 'sum_individual')}, {r('a + b - j', 'redundancy')}, {r('(a + b - j) / (a + b) * 100', 'redundancy_pct')}, {r('a / j', 'ratio')} FROM c""")
def redundancy(spark, sf):
    c = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(
        F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), (F.avg(F.col("l_discount") + F.col("l_tax")) / 1.5).alias("j")
    )
    return summary.redundancy(c, ["a", "b"], "j").withColumn("ratio", summary.gap_drop_ratio(F.col("a"), F.col("j")))


@query("fdr_by_family", f"""WITH t AS (SELECT event_type AS family, event_id AS test_id, round(exp(-value / 10), 9) AS p_value FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY family) AS n FROM t),
a AS (SELECT *, least(min(p_value * n / rk) OVER (PARTITION BY family ORDER BY rk DESC), 1.0) AS adj FROM k)
SELECT family, test_id, {r('p_value', 'p_value')}, {r('adj', 'p_adjusted')}, adj < 0.05 AS rejected FROM a""")
def fdr(spark, sf):
    t = read(spark, sf, "events").select(
        F.col("event_type").alias("family"), F.col("event_id").alias("test_id"), F.round(F.exp(-F.col("value") / 10), 9).alias("p_value")
    )
    return summary.benjamini_hochberg(t, ["family"])


@query("significant_counts", f"""WITH t AS (SELECT event_type AS family, round(exp(-value / 10), 9) AS p_value FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY family) AS n FROM t),
a AS (SELECT *, least(min(p_value * n / rk) OVER (PARTITION BY family ORDER BY rk DESC), 1.0) AS adj FROM k)
SELECT family, sum((adj < 0.05)::BIGINT)::BIGINT AS n_significant, count(*) AS n_cells FROM a GROUP BY family""")
def significant(spark, sf):
    return summary.significant_counts(fdr(spark, sf), ["family"], "rejected")
