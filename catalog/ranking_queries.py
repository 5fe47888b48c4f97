"""Ranking, calibration, threshold and DeLong queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from attraudit.functions.tails import p_normal
from attraudit.operators import ranking
from attraudit.operators.running import midranks, rank_rows

from .base import LINES_SQL, SCORES_SQL, auroc_expr, line_scores, midrank_sql, query, r, read, scores

S = f"WITH {SCORES_SQL}"
CELL = ["model", "finding"]


@query("auroc_grouped", f"""{S}, k AS ({midrank_sql('scores', 'model, finding')})
SELECT model, finding, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos, {r(auroc_expr(), 'auroc')} FROM k GROUP BY ALL""")
def auroc_grouped(spark, sf):
    return ranking.auroc(scores(spark, sf), CELL)


@query("auroc_lines", f"""WITH {LINES_SQL}, k AS ({midrank_sql('lines', 'finding, grp')})
SELECT finding, grp, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos, {r(auroc_expr(), 'auroc')} FROM k GROUP BY ALL""")
def auroc_lines(spark, sf):
    return ranking.auroc(line_scores(spark, sf), ["finding", "grp"])


AP_SQL = """t AS (SELECT {k}, p, count(*) FILTER (WHERE y=1) AS pos, count(*) AS m FROM {src} GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC) AS tp, sum(m) OVER (PARTITION BY {k} ORDER BY p DESC) AS called,
 sum(pos) OVER (PARTITION BY {k}) AS n_pos, sum(m) OVER (PARTITION BY {k}) AS n FROM t)"""


@query("auprc_grouped", f"""{S}, {AP_SQL.format(k='model, finding', src='scores')}
SELECT model, finding, max(n)::BIGINT AS n, max(n_pos)::BIGINT AS n_pos, {r('sum(pos / n_pos::DOUBLE * tp / called)', 'auprc')} FROM c GROUP BY ALL""")
def auprc_grouped(spark, sf):
    return ranking.auprc(scores(spark, sf), CELL)


@query("youden_roc", f"""{S}, {AP_SQL.format(k='model, finding', src='scores')},
j AS (SELECT model, finding, p, tp / n_pos::DOUBLE - (called - tp) / (n - n_pos)::DOUBLE AS j FROM c),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY model, finding ORDER BY j DESC, p DESC) = 1)
SELECT model, finding, {r('CASE WHEN j > 0 THEN p END', 'threshold')}, {r('greatest(j, 0)', 'youden_j')} FROM b""")
def youden_roc(spark, sf):
    return ranking.youden_roc(scores(spark, sf), CELL)


@query("ranking_bundle", f"""WITH {LINES_SQL}, {AP_SQL.format(k='finding, entity_id', src='lines')},
j AS (SELECT finding, entity_id, n, n_pos, p, pos, tp, called, tp / nullif(n_pos, 0)::DOUBLE - (called - tp) / nullif(n - n_pos, 0)::DOUBLE AS j FROM c),
a AS (SELECT finding, entity_id, max(n)::BIGINT AS n, max(n_pos)::BIGINT AS n_pos,
 sum(pos * (n - n_pos - (called - tp) + (called - tp - lag_fp) / 2.0::DOUBLE)) / nullif(max(n_pos * (n - n_pos)), 0) AS auroc,
 sum(pos / nullif(n_pos, 0)::DOUBLE * tp / called) AS auprc, max(j) AS mj
 FROM (SELECT *, coalesce(lag(called - tp) OVER (PARTITION BY finding, entity_id ORDER BY p DESC), 0) AS lag_fp FROM j) GROUP BY ALL),
b AS (SELECT finding, entity_id, p FROM j QUALIFY row_number() OVER (PARTITION BY finding, entity_id ORDER BY j DESC NULLS LAST, p DESC) = 1)
SELECT finding, entity_id, n, n_pos, {r('auroc', 'auroc')}, {r('auprc', 'auprc')}, {r('CASE WHEN mj > 0 THEN p END', 'threshold')} FROM a JOIN b USING (finding, entity_id)""")
def ranking_bundle(spark, sf):
    return ranking.ranking_metrics(line_scores(spark, sf), ["finding", "entity_id"])


@query("midranks", f"""WITH k AS (SELECT lang, n_chars, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rank,
 count(*) OVER (PARTITION BY lang, n_chars) AS n, count(*) OVER (PARTITION BY lang) AS n_total FROM documents)
SELECT DISTINCT lang, n_chars, n, n_total, rank FROM k""")
def midranks_q(spark, sf):
    return midranks(read(spark, sf, "documents"), ["lang"], "n_chars", "rank")


@query("rank_descending", """SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS rank FROM part""")
def rank_descending(spark, sf):
    return rank_rows(read(spark, sf, "part").select("p_partkey", "p_retailprice"), [], "p_retailprice", "rank", descending=True)


@query("ovr_auroc", f"""WITH b AS (SELECT l_linestatus AS cell, l_returnflag AS c, l_quantity AS pa, l_discount AS pn, l_tax AS pr FROM lineitem),
x AS (SELECT cell, 'A' AS class, pa AS p, (c = 'A')::INT AS y FROM b UNION ALL SELECT cell, 'N', pn, (c = 'N')::INT FROM b UNION ALL SELECT cell, 'R', pr, (c = 'R')::INT FROM b),
k AS ({midrank_sql('x', 'cell, class')}), a AS (SELECT cell, class, {auroc_expr()} AS auroc FROM k GROUP BY ALL)
SELECT cell, {r('avg(auroc)', 'macro_auroc')}, {r("max(auroc) FILTER (WHERE class='A')", '"auroc_A"')}, {r("max(auroc) FILTER (WHERE class='N')", '"auroc_N"')},
 {r("max(auroc) FILTER (WHERE class='R')", '"auroc_R"')} FROM a GROUP BY cell""")
def ovr_auroc(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("cell"), "l_returnflag", "l_quantity", "l_discount", "l_tax")
    return ranking.ovr_auroc(li, ["cell"], "l_returnflag", {"A": "l_quantity", "N": "l_discount", "R": "l_tax"})


@query("mae_r2", """SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae,
 round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 4) AS r2 FROM lineitem GROUP BY 1""", digits=4)
def mae_r2(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return ranking.regression_metrics(li, ["l_returnflag"], "l_extendedprice", "p")


def _ece_sql(closed: bool) -> str:
    edges = " + ".join(f"(p >= {i * 0.1!r}::DOUBLE)::INT" for i in range(10))
    inside = "p >= 0 AND p <= 1" if closed else "p >= 0 AND p < 1"
    return f"""WITH {LINES_SQL}, b AS (SELECT finding, grp, y, p, CASE WHEN {inside} THEN {edges} - 1 END AS b FROM lines),
g AS (SELECT finding, grp, b, count(*) AS n, sum(y) AS sy, sum(p) AS sp, sum((p - y) * (p - y)) AS se FROM b GROUP BY ALL)
SELECT finding, grp, sum(n)::BIGINT AS n, {r('sum(CASE WHEN b IS NOT NULL THEN abs(sy - sp) ELSE 0 END) / sum(n)', 'ece')}, {r('sum(se) / sum(n)', 'brier')},
 {r('sum(sp) / sum(n)', 'mean_p')}, {r('sum(sy) / sum(n)::DOUBLE', 'prevalence')} FROM g GROUP BY finding, grp"""


@query("calibration_ece_open", _ece_sql(False))
def ece_open(spark, sf):
    return ranking.calibration(line_scores(spark, sf), ["finding", "grp"], closed_last=False)


@query("calibration_ece_closed", _ece_sql(True))
def ece_closed(spark, sf):
    return ranking.calibration(line_scores(spark, sf), ["finding", "grp"], closed_last=True)


@query("threshold_rates", f"""{S}, c AS (SELECT model, finding, count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
 count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM scores GROUP BY ALL)
SELECT *, {r('tp / nullif(tp + fn, 0)::DOUBLE', 'sensitivity')}, {r('tn / nullif(tn + fp, 0)::DOUBLE', 'specificity')},
 {r('1 - tn / nullif(tn + fp, 0)::DOUBLE', 'fpr')}, {r('1 - tp / nullif(tp + fn, 0)::DOUBLE', 'fnr')} FROM c""")
def threshold_rates(spark, sf):
    return ranking.rates(ranking.confusion(scores(spark, sf), CELL, F.lit(0.5)))


def _grid_sql(grid):
    return "g AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in grid) + "]) AS t)"


@query("youden_grid", f"""{S}, {_grid_sql(ranking.YOUDEN_GRID)},
c AS (SELECT model, finding, t, count(*) FILTER (WHERE p >= t AND y=1) AS tp, count(*) FILTER (WHERE p >= t AND y=0) AS fp,
 count(*) FILTER (WHERE y=1) AS np, count(*) FILTER (WHERE y=0) AS nn FROM scores, g GROUP BY ALL),
j AS (SELECT model, finding, t, CASE WHEN tp + fp > 0 AND tp + fp < np + nn THEN tp / np::DOUBLE - fp / nn::DOUBLE END AS j FROM c)
SELECT model, finding, {r('t', 'threshold')}, {r('j', 'youden_j')} FROM j QUALIFY row_number() OVER (PARTITION BY model, finding ORDER BY j DESC NULLS LAST, t) = 1""")
def youden_grid(spark, sf):
    return ranking.youden_grid(scores(spark, sf), CELL)


_MCC = "CASE WHEN (tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp::DOUBLE*tn - fp::DOUBLE*fn) / sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END"


@query("mcc_best_threshold", f"""{S}, {_grid_sql(ranking.MCC_GRID)},
c AS (SELECT model, finding, split, t, count(*) FILTER (WHERE p >= t AND y=1) AS tp, count(*) FILTER (WHERE p >= t AND y=0) AS fp,
 count(*) FILTER (WHERE p < t AND y=1) AS fn, count(*) FILTER (WHERE p < t AND y=0) AS tn FROM scores, g GROUP BY ALL),
m AS (SELECT model, finding, split, t, {_MCC} AS m FROM c),
b AS (SELECT a.model, a.finding, a.t, a.m AS mt, e.m AS me FROM m a JOIN m e ON a.model=e.model AND a.finding=e.finding AND a.t=e.t AND a.split='train' AND e.split='test')
SELECT model, finding, {r('t', 'threshold')}, {r('mt', 'mcc_train')}, {r('me', 'mcc')} FROM b QUALIFY row_number() OVER (PARTITION BY model, finding ORDER BY mt DESC, t) = 1""")
def mcc_best_threshold(spark, sf):
    return ranking.best_mcc(scores(spark, sf), CELL)


def _delong_sql(ties: str) -> str:
    half = "0.5::DOUBLE" if ties == "half" else "0.0::DOUBLE"
    return f"""{S}, t AS (SELECT model, finding, p, count(*) FILTER (WHERE y=1) AS pos, count(*) FILTER (WHERE y=0) AS neg FROM scores GROUP BY ALL),
q AS (SELECT *, sum(pos) OVER w - pos AS pb, sum(neg) OVER w - neg AS nb, sum(pos) OVER (PARTITION BY model, finding) AS np, sum(neg) OVER (PARTITION BY model, finding) AS nn
 FROM t WINDOW w AS (PARTITION BY model, finding ORDER BY p)),
v AS (SELECT s.finding, s.unit_id, s.model, s.y, CASE WHEN y=1 THEN (nb + {half} * neg) / nn ELSE (np - pb - (1 - {half}) * pos) / np END AS v,
 CASE WHEN y=1 THEN (nb + 0.5::DOUBLE * neg) / nn END AS u FROM scores s JOIN q ON s.model=q.model AND s.finding=q.finding AND s.p=q.p),
w AS (SELECT a.finding, a.y, a.v AS va, b.v AS vb, a.u AS ua, b.u AS ub FROM v a JOIN v b ON a.unit_id=b.unit_id AND a.finding=b.finding WHERE a.model='a' AND b.model='b'),
g AS (SELECT finding, avg(ua) AS aa, avg(ub) AS ab,
 (var_samp(va) FILTER (WHERE y=1) + var_samp(vb) FILTER (WHERE y=1) - 2 * covar_samp(va, vb) FILTER (WHERE y=1)) / count(*) FILTER (WHERE y=1)
 + (var_samp(va) FILTER (WHERE y=0) + var_samp(vb) FILTER (WHERE y=0) - 2 * covar_samp(va, vb) FILTER (WHERE y=0)) / count(*) FILTER (WHERE y=0) AS var FROM w GROUP BY finding)
SELECT finding, 'a' AS model_a, 'b' AS model_b, {r('aa', 'auroc_a')}, {r('ab', 'auroc_b')}, {r('(aa - ab) / sqrt(var)', 'z', 5)} FROM g"""


def _delong(spark, sf, ties):
    d = ranking.delong(scores(spark, sf), ["finding"], "unit_id", "model", ["a", "b"], ties)
    return d.select("finding", "model_a", "model_b", "auroc_a", "auroc_b", F.round("z", 5).alias("z"))


query("delong_pairs", _delong_sql("half"))(lambda spark, sf: _delong(spark, sf, "half"))
query("delong_strict_ties", _delong_sql("strict"))(lambda spark, sf: _delong(spark, sf, "strict"))


@query("delong_p_values")
def delong_p(spark, sf):
    d = ranking.delong(scores(spark, sf), ["finding"], "unit_id", "model", ["a", "b"])
    return d.withColumn("p_value", p_normal(F.col("z")))
