"""Correlation and regression queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from attraudit.operators import odds, panel as P
from attraudit.operators.cohort import one_per_entity_patterns

from .base import BINARY, COUNTS_SQL, FINDINGS, UNITS_SQL, labelled, labelled_sql, pairs_sql, query, r, read
from .fairness_queries import ENC_SQL, PANEL_SQL, encodings, panel


def lines(spark, sf):
    return read(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("z"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("cluster"),
        F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"),
    )


L = """l AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_discount * 100 AS z, l_returnflag AS flag, l_linestatus AS status,
 l_suppkey AS cluster, l_linenumber AS line, l_orderkey AS ok, l_partkey AS pk FROM lineitem)"""


@query("ols_simple", f"""WITH {L} SELECT flag, status, count(*) AS n, {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')}, {r('regr_r2(y, x)', 'r2')} FROM l GROUP BY ALL""")
def ols_simple(spark, sf):
    return P.simple_ols(lines(spark, sf), ["flag", "status"], "x", "y").drop("p_value")


@query("ols_simple_p_values")
def ols_simple_p(spark, sf):
    return P.simple_ols(lines(spark, sf), ["flag"], "z", "y")


_TWO = """d AS (SELECT count(*) AS n, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(y) AS yy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM l),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM d),
e AS (SELECT *, (b1 * xy + b2 * zy) / yy AS r2, n * (yy - b1 * xy - b2 * zy) AS ssr FROM b)"""


@query("ols_two_terms", f"""WITH {L}, {_TWO}
SELECT 'x' AS term, {r('b1', 'beta')}, {r('sqrt(ssr / (n - 3) / n * zz / (xx * zz - xz * xz))', 'se')}, n, {r('r2', 'r2')}, {r('1 - (1 - r2) * (n - 1) / (n - 3)', 'adj_r2')} FROM e
UNION ALL SELECT 'z', {r('b2', 'b')}, {r('sqrt(ssr / (n - 3) / n * xx / (xx * zz - xz * xz))', 's')}, n, {r('r2', 'r')}, {r('1 - (1 - r2) * (n - 1) / (n - 3)', 'a')} FROM e
UNION ALL SELECT '(Intercept)', {r('my - b1 * mx - b2 * mz', 'b')}, {r('sqrt(ssr / (n - 3) / n * (1 + (mx*mx*zz + mz*mz*xx - 2*mx*mz*xz) / (xx * zz - xz * xz)))', 's')}, n, {r('r2', 'r')}, {r('1 - (1 - r2) * (n - 1) / (n - 3)', 'a')} FROM e""")
def ols_two_terms(spark, sf):
    f = P.ols(lines(spark, sf), "y", {"m": [P.num("x"), P.num("z")]})
    return f.select("term", "beta", "se", "n", "r2", "adj_r2")


@query("ols_nested", f"""WITH {L}, t AS (SELECT count(*) AS rows_all, var_pop(y) * count(*) AS tss, regr_r2(y, x) AS r1 FROM l),
g AS (SELECT flag, count(*) AS n, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM l GROUP BY flag),
w AS (SELECT 1 - (sum(n * yy) - sum(n * xy) * sum(n * xy) / sum(n * xx)) / max(t.tss) AS r5 FROM g, t)
SELECT 'M1' AS fit, rows_all AS n, 2::INTEGER AS k, {r('r1', 'r2')}, 0.0::DOUBLE AS delta_r2 FROM t
UNION ALL SELECT 'M5', rows_all, 4, {r('r5', 'a')}, {r('r5 - r1', 'd')} FROM t, w""")
def ols_nested(spark, sf):
    fits = {"M1": [P.num("x")], "M5": [P.num("x"), P.cat("flag")]}
    return P.fit_table(P.ols(lines(spark, sf), "y", fits), base="M1").select("fit", "n", "k", "r2", "delta_r2")


@query("ols_fit_statistics")
def ols_fit_statistics(spark, sf):
    fits = {
        "M1": [P.num("x")], "M2": [P.num("x"), P.num("z")], "M3": [P.num("x"), P.num("z"), P.inter("x", "z")],
        "M8": [P.num("x"), P.cat("flag"), P.cat("line")],
    }
    return P.fit_table(P.ols(lines(spark, sf), "y", fits, by=["status"]), ["status"], base="M1")


@query("residual_summary", f"""WITH {L}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), e AS (SELECT y - a - b * x AS e FROM l, f),
m AS (SELECT count(*) AS n, avg(e) AS mean, stddev_pop(e) AS sd FROM e),
k AS (SELECT max(n) AS n, max(m.mean) AS mean, max(sd) AS sd, avg(((e - m.mean) / sd) ** 3) AS skew, avg(((e - m.mean) / sd) ** 4) - 3 AS kurt FROM e, m)
SELECT n, {r('mean', 'mean')}, {r('sd', 'sd')}, {r('skew', 'skew')}, {r('kurt', 'kurt')}, round(n / 6.0::DOUBLE * (skew * skew + kurt * kurt / 4), 4) AS jarque_bera FROM k""")
def residual_summary(spark, sf):
    return P.residual_summary(lines(spark, sf), "y", ["x"]).drop("jb_p_value").withColumn("jarque_bera", F.round("jarque_bera", 4))


@query("breusch_pagan", f"""WITH {L}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), e AS (SELECT x, (y - a - b * x) ** 2 AS e2 FROM l, f)
SELECT count(*) AS n, round(count(*) * regr_r2(e2, x), 3) AS lm FROM e""")
def breusch_pagan(spark, sf):
    return P.breusch_pagan(lines(spark, sf), "y", ["x"]).select("n", F.round("lm", 3).alias("lm"))


@query("cooks_distance", f"""WITH {L}, f AS (SELECT flag, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM l GROUP BY flag),
e AS (SELECT l.flag, n, y - a - b * x AS e, 1.0::DOUBLE / n + (x - mx) ** 2 / sxx AS h FROM l JOIN f USING (flag)),
s AS (SELECT flag, sum(e * e) / (max(n) - 2) AS s2 FROM e GROUP BY flag),
c AS (SELECT e.flag, n, e * e / (2 * s2) * h / ((1 - h) * (1 - h)) AS c FROM e JOIN s USING (flag))
SELECT flag, count(*) AS n, {r('max(c)', 'max_cooks_d')}, count(*) FILTER (WHERE c > 4.0::DOUBLE / n) AS n_above_4_over_n, count(*) FILTER (WHERE c > 1) AS n_above_1 FROM c GROUP BY flag""")
def cooks_distance(spark, sf):
    return P.influence_counts(P.influence(lines(spark, sf), "y", ["x"], ["flag"]), ["flag"])


@query("cooks_top5", f"""WITH {PANEL_SQL}, f AS (SELECT count(*) AS n, regr_slope(drop_v, added) AS b, regr_intercept(drop_v, added) AS a, avg(added) AS mx, regr_sxx(drop_v, added) AS sxx FROM panel),
e AS (SELECT p.*, n, drop_v - a - b * added AS e, 1.0::DOUBLE / n + (added - mx) ** 2 / sxx AS h FROM panel p, f), s AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM e),
c AS (SELECT *, e * e / (2 * s2) * h / ((1 - h) * (1 - h)) AS c FROM e, s)
SELECT attribute, model, finding, seed, {r('c', 'cooks_d')}, {r('h', 'leverage')} FROM c ORDER BY c DESC LIMIT 5""")
def cooks_top5(spark, sf):
    from attraudit.operators.summary import top_k

    e = panel(spark, sf).select("attribute", "model", "finding", "seed", "drop_v", "added")
    return top_k(P.influence(e, "drop_v", ["added"]), F.col("cooks_d"), 5).select("attribute", "model", "finding", "seed", "cooks_d", "leverage")


@query("cluster_robust", f"""WITH {L}, f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) * (1 - regr_r2(y, x)) AS ssr FROM l),
s AS (SELECT cluster, sum((x - mx) * (y - a - b * x)) AS s FROM l, f GROUP BY cluster), g AS (SELECT count(*) AS g, sum(s * s) AS m FROM s)
SELECT 'x' AS term, {r('b', 'beta')}, {r('sqrt(ssr / (n - 2) / sxx)', 'se_ols')}, {r('sqrt(g / (g - 1.0::DOUBLE) * (n - 1.0::DOUBLE) / (n - 2) * m) / sxx', 'se_cluster')}, n, g AS n_clusters FROM f, g""")
def cluster_robust(spark, sf):
    c = P.cluster_robust(lines(spark, sf), "y", ["x"], "cluster")
    return c.where("term = 'x'").select("term", "beta", "se_ols", "se_cluster", "n", "n_clusters")


@query("cluster_robust_strata", f"""WITH {L}, f AS (SELECT flag, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM l GROUP BY flag),
s AS (SELECT l.flag, cluster, sum((x - mx) * (y - a - b * x)) AS s FROM l JOIN f USING (flag) GROUP BY ALL), g AS (SELECT flag, count(*) AS g, sum(s * s) AS m FROM s GROUP BY flag)
SELECT flag, {r('b', 'beta')}, {r('sqrt(g / (g - 1.0::DOUBLE) * (n - 1.0::DOUBLE) / (n - 2) * m) / sxx', 'se_cluster')}, n, g AS n_clusters FROM f JOIN g USING (flag)""")
def cluster_robust_strata(spark, sf):
    c = P.cluster_robust(lines(spark, sf), "y", ["x"], "cluster", by=["flag"])
    return c.where("term = 'x'").select("flag", "beta", "se_cluster", "n", "n_clusters")


@query("slope_difference", f"""WITH {L} SELECT {r("regr_slope(y, x) FILTER (WHERE status = 'O') - regr_slope(y, x) FILTER (WHERE status <> 'O')", 'beta')}, count(*) AS n, count(DISTINCT cluster) AS n_clusters FROM l""")
def slope_difference(spark, sf):
    rows = lines(spark, sf).withColumn("open", F.col("status").isin("O"))
    return P.slope_difference(rows, "y", "x", "open", "cluster").select("beta", "n", "n_clusters")


@query("leave_one_group_out", f"""WITH {L}, k AS (SELECT DISTINCT line FROM l)
SELECT k.line, count(*) AS n, {r('regr_r2(y, x)', 'r2')} FROM k JOIN l ON l.line <> k.line GROUP BY k.line""")
def leave_one_group_out(spark, sf):
    return P.leave_one_group_out(lines(spark, sf), "y", ["x"], "line")


@query("spearman_by_flag", f"""WITH {L}, k AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2.0::DOUBLE AS b FROM l)
SELECT flag, count(*) AS n, {r('corr(a, b)', 'rho')} FROM k GROUP BY flag""")
def spearman_by_flag(spark, sf):
    return P.spearman(lines(spark, sf), ["flag"], "x", "y").select("flag", "n", "rho")


@query("pearson_by_flag", f"""WITH {L} SELECT flag, count(*) AS n, {r('corr(x, y)', 'r')} FROM l GROUP BY flag""")
def pearson_by_flag(spark, sf):
    return P.pearson(lines(spark, sf), ["flag"], "x", "y").select("flag", "n", "r")


@query("kendall_w", f"""WITH {PANEL_SQL}, c AS (SELECT attribute, seed, round(avg(drop_v), 9) AS v FROM panel GROUP BY ALL),
k AS (SELECT attribute, rank() OVER (PARTITION BY seed ORDER BY v DESC) + (count(*) OVER (PARTITION BY seed, v) - 1) / 2.0::DOUBLE AS rk FROM c),
t AS (SELECT attribute, sum(rk) AS total, count(*) AS m FROM k GROUP BY attribute)
SELECT count(*) AS n_subjects, max(m) AS n_judges, {r('12 * var_pop(total) * count(*) / (max(m) ** 2 * (count(*) ** 3 - count(*)))', 'kendall_w')} FROM t""")
def kendall_w(spark, sf):
    c = panel(spark, sf).groupBy("attribute", "seed").agg(F.round(F.avg("drop_v"), 9).alias("v"))
    return P.kendall_w(c, "attribute", "seed", "v")


@query("rank_agreement", f"""WITH {PANEL_SQL}, a AS (SELECT attribute, round(avg(drop_v), 9) AS va, round(avg(added), 9) AS vb FROM panel GROUP BY attribute),
k AS (SELECT rank() OVER (ORDER BY va) + (count(*) OVER (PARTITION BY va) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY vb) + (count(*) OVER (PARTITION BY vb) - 1) / 2.0::DOUBLE AS y FROM a)
SELECT count(*) AS n, {r('corr(x, y)', 'rho')} FROM k""")
def rank_agreement(spark, sf):
    a = panel(spark, sf).groupBy("attribute").agg(F.round(F.avg("drop_v"), 9).alias("va"), F.round(F.avg("added"), 9).alias("vb"))
    return P.rank_agreement(a, a, "attribute", "va", "vb").select("n", "rho")


@query("encoding_dependence", f"""WITH {ENC_SQL}, s AS (SELECT 'all' AS subset, encoding_value AS x, dependence AS y FROM enc
 UNION ALL SELECT CASE encoding_metric WHEN 'auroc' THEN 'binary' ELSE 'continuous' END, encoding_value, dependence FROM enc),
k AS (SELECT subset, x, y, rank() OVER (PARTITION BY subset ORDER BY x) + (count(*) OVER (PARTITION BY subset, x) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY subset ORDER BY y) + (count(*) OVER (PARTITION BY subset, y) - 1) / 2.0::DOUBLE AS b FROM s)
SELECT subset, count(*) AS n, {r('corr(a, b)', 'spearman_rho')}, {r('corr(x, y)', 'pearson_r')} FROM k GROUP BY subset""")
def encoding_dependence(spark, sf):
    return P.encoding_dependence(encodings(spark, sf), "encoding_metric", "encoding_value", "dependence").select(
        "subset", "n", "spearman_rho", "pearson_r"
    )


@query("one_sample_t", """SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_tax - 0.04), 6) + 0.0 AS mean, round(stddev_samp(l_tax - 0.04), 6) AS sd,
 round(avg(l_tax - 0.04) / (stddev_samp(l_tax - 0.04) / sqrt(count(*))), 5) AS t FROM lineitem GROUP BY 1""")
def one_sample_t(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_tax") - 0.04).alias("v"))
    return P.one_sample_t(li, ["flag"], "v").drop("p_value").withColumn("t", F.round("t", 5))


@query("minimum_detectable", """SELECT l_returnflag AS flag, count(*) AS n, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(l_discount) / sqrt(count(*)), 6) AS mde FROM lineitem GROUP BY 1""")
def minimum_detectable(spark, sf):
    return P.minimum_detectable(read(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_discount")


@query("random_intercept")
def random_intercept(spark, sf):
    m = P.random_intercept(lines(spark, sf), "y", ["x"], "cluster")
    return spark.createDataFrame([(m["group_variance"], m["residual_variance"], m["icc"], m["n"])], "group_variance double, residual_variance double, icc double, n long")


@query("huber_regression")
def huber_regression(spark, sf):
    m = P.huber(lines(spark, sf), "y", ["x"])
    return spark.createDataFrame(
        [(t, m["beta"][i], m["se"][i], m["ols_beta"][i], m["scale"]) for i, t in enumerate(["(Intercept)", "x"])],
        "term string, beta double, se double, ols_beta double, scale double",
    )


ZERO = "(CASE WHEN least(tp, fp, fn, tn) = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"


@query("seed_stability", f"""WITH {UNITS_SQL}, {labelled_sql('blank_dropped', 'lab0')},
lab AS (SELECT * FROM lab0, (SELECT unnest(range(100)) AS seed) QUALIFY row_number() OVER (PARTITION BY seed, entity_id ORDER BY md5(seed || ':' || unit_id)) = 1),
{pairs_sql(extra=', seed')}, c AS (SELECT seed, attribute, finding, {COUNTS_SQL} FROM pairs GROUP BY ALL),
o AS (SELECT seed, attribute, finding, abs(ln((tp + {ZERO}) * (tn + {ZERO})::DOUBLE / ((fp + {ZERO}) * (fn + {ZERO})))) AS l, (tp + fn) / (tp + fp + fn + tn)::DOUBLE AS v FROM c)
SELECT seed, count(*) AS n, {r('regr_slope(v, l)', 'slope')}, {r('regr_r2(v, l)', 'r2')} FROM o GROUP BY seed""")
def seed_stability(spark, sf):
    u = one_per_entity_patterns(labelled(spark, sf, "blank_dropped"), "entity_id", "unit_id", [*BINARY, *FINDINGS], range(100))
    o = odds.odds_ratio(odds.contingency(u, BINARY, FINDINGS, by=["seed"], weight="n"), "zero_cell")
    o = o.withColumn("v", (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    s = P.simple_ols(o, ["seed"], "abs_log_or", "v")
    return s.select(F.col("seed").cast("bigint").alias("seed"), "n", "slope", "r2")
