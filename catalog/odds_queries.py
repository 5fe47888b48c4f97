"""Contingency and odds-ratio queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from attraudit.operators import cohort, odds
from attraudit.operators.summary import top_k

from .base import BINARY, COUNTS_SQL, FINDINGS, UNITS_SQL, labelled, labelled_sql, pairs_sql, query, r


def _base(policy):
    return f"WITH {UNITS_SQL}, {labelled_sql(policy)}, {pairs_sql()}"


def _or_cols(add: str) -> str:
    ratio = f"(tp + {add}) * (tn + {add})::DOUBLE / nullif((fp + {add}) * (fn + {add}), 0)"
    return f"{r(ratio, 'odds_ratio')}, {r(f'ln(nullif({ratio}, 0))', 'log_or')}, {r(f'abs(ln(nullif({ratio}, 0)))', 'abs_log_or')}"


ZERO = "(CASE WHEN least(tp, fp, fn, tn) = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"
ALWAYS = "0.5::DOUBLE"
HALF = "(CASE WHEN least(tp, fp, fn, tn) < 0.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"


@query("or_all_pairs", f"""{_base('blank_dropped')}, c AS (SELECT attribute, finding, {COUNTS_SQL} FROM pairs GROUP BY ALL)
SELECT attribute, finding, tp, fp, fn, tn, {_or_cols(ZERO)} FROM c WHERE tp + fp + fn + tn >= 100""")
def or_all_pairs(spark, sf):
    t = odds.contingency(labelled(spark, sf, "blank_dropped"), BINARY, FINDINGS)
    return odds.odds_ratio(t, "zero_cell", min_n=100)


@query("or_always", f"""{_base('ignore')}, c AS (SELECT attribute, finding, {COUNTS_SQL} FROM pairs GROUP BY ALL)
SELECT attribute, finding, tp, fp, fn, tn, {_or_cols(ALWAYS)} FROM c WHERE tp + fp >= 20 AND fn + tn >= 20""")
def or_always(spark, sf):
    t = odds.contingency(labelled(spark, sf, "ignore"), BINARY, FINDINGS)
    return odds.odds_ratio(t, "always", min_side=20)


@query("or_weighted", f"""{_base('blank_dropped')}, s AS (SELECT entity_id, 1.0::DOUBLE / count(*) AS w FROM units GROUP BY entity_id),
j AS (SELECT * FROM pairs JOIN s USING (entity_id)),
c AS (SELECT attribute, finding, coalesce(sum(w) FILTER (WHERE a=1 AND y=1), 0) AS tp, coalesce(sum(w) FILTER (WHERE a=1 AND y=0), 0) AS fp,
 coalesce(sum(w) FILTER (WHERE a=0 AND y=1), 0) AS fn, coalesce(sum(w) FILTER (WHERE a=0 AND y=0), 0) AS tn FROM j GROUP BY ALL)
SELECT attribute, finding, {r('tp', 'tp')}, {r('fp', 'fp')}, {r('fn', 'fn')}, {r('tn', 'tn')}, {_or_cols(HALF)} FROM c""")
def or_weighted(spark, sf):
    t = odds.entity_weighted_contingency(labelled(spark, sf, "blank_dropped"), BINARY, FINDINGS, "entity_id")
    return odds.odds_ratio(t, "lt_half")


_STRATA = f"{_base('blank_dropped')}, c AS (SELECT stratum, attribute, finding, {COUNTS_SQL} FROM pairs GROUP BY ALL)"


@query("or_mantel_haenszel", f"""{_STRATA}, k AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c WHERE tp + fp + fn + tn >= 50),
g AS (SELECT attribute, finding, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, count(*) AS n_strata,
 CASE WHEN sum(fp * fn / n) > 0 THEN sum(tp * tn / n) / sum(fp * fn / n) END AS mh FROM k GROUP BY ALL HAVING count(*) >= 2),
h AS (SELECT *, (tp + {ZERO}) * (tn + {ZERO})::DOUBLE / ((fp + {ZERO}) * (fn + {ZERO})) AS o FROM g)
SELECT attribute, finding, n_strata, {r('o', 'or_crude')}, {r('abs(ln(o))', 'abs_log_or_crude')}, {r('mh', 'or_mh')},
 {r('abs(ln(nullif(mh, 0)))', 'abs_log_or_mh')} FROM h""")
def or_mh(spark, sf):
    return odds.mantel_haenszel(labelled(spark, sf, "blank_dropped"), BINARY, FINDINGS, "stratum")


@query("or_by_stratum", f"""{_STRATA} SELECT stratum, attribute, finding, tp, fp, fn, tn, {_or_cols(ZERO)} FROM c WHERE tp + fp + fn + tn >= 50""")
def or_by_stratum(spark, sf):
    return odds.stratum_odds(labelled(spark, sf, "blank_dropped"), BINARY, FINDINGS, "stratum")


@query("or_one_per_entity", f"""WITH {UNITS_SQL}, {labelled_sql('blank_dropped', 'lab0')},
lab AS (SELECT * FROM lab0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY md5('42:' || unit_id)) = 1), {pairs_sql()},
c AS (SELECT attribute, finding, {COUNTS_SQL} FROM pairs GROUP BY ALL)
SELECT attribute, finding, tp, fp, fn, tn, {_or_cols(ZERO)} FROM c WHERE tp + fp + fn + tn >= 10""")
def or_one_per_entity(spark, sf):
    u = cohort.one_per_entity(labelled(spark, sf, "blank_dropped"), "entity_id", "unit_id")
    return odds.odds_ratio(odds.contingency(u, BINARY, FINDINGS), "zero_cell", min_n=10)


SEEDS = list(range(100))


@query("or_seed_sweep", f"""WITH {UNITS_SQL}, {labelled_sql('blank_dropped', 'lab0')},
lab AS (SELECT * FROM lab0, (SELECT unnest(range(100)) AS seed) QUALIFY row_number() OVER (PARTITION BY seed, entity_id ORDER BY md5(seed || ':' || unit_id)) = 1),
{pairs_sql(extra=', seed')}, c AS (SELECT seed, attribute, finding, {COUNTS_SQL} FROM pairs GROUP BY ALL),
o AS (SELECT attribute, finding, abs(ln((tp + {ZERO}) * (tn + {ZERO})::DOUBLE / ((fp + {ZERO}) * (fn + {ZERO})))) AS l FROM c)
SELECT attribute, finding, count(*) AS n_seeds, {r('avg(l)', 'mean_abs_log_or')}, {r('quantile_cont(l, 0.025)', 'lo')}, {r('quantile_cont(l, 0.975)', 'hi')} FROM o GROUP BY ALL""")
def or_seed_sweep(spark, sf):
    u = cohort.one_per_entity_patterns(labelled(spark, sf, "blank_dropped"), "entity_id", "unit_id", [*BINARY, *FINDINGS], SEEDS)
    o = odds.odds_ratio(odds.contingency(u, BINARY, FINDINGS, by=["seed"], weight="n"), "zero_cell")
    return o.groupBy("attribute", "finding").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("abs_log_or").alias("mean_abs_log_or"),
        F.percentile("abs_log_or", 0.025).alias("lo"), F.percentile("abs_log_or", 0.975).alias("hi"),
    )


def _policy_counts(policy, tag):
    pairs = pairs_sql(f"lab_{tag}", name=f"pairs_{tag}").replace("attrs", f"attrs_{tag}")
    return (f"{labelled_sql(policy, f'lab_{tag}')}, {pairs}, "
            f"c_{tag} AS (SELECT attribute, finding, {COUNTS_SQL} FROM pairs_{tag} GROUP BY ALL)")


def _ln(tag):
    return f"ln(({tag}.tp + 0.5::DOUBLE) * ({tag}.tn + 0.5) / (({tag}.fp + 0.5) * ({tag}.fn + 0.5)))"


@query("or_label_policy", f"""WITH {UNITS_SQL}, {_policy_counts('ignore', 'i')}, {_policy_counts('zero', 'z')}
SELECT i.attribute, i.finding, {r(_ln('i'), 'log_or_ignore')}, {r(_ln('z'), 'log_or_zero')}
FROM c_i i JOIN c_z z ON i.attribute = z.attribute AND i.finding = z.finding""")
def or_label_policy(spark, sf):
    parts = []
    for policy in ("ignore", "zero"):
        t = odds.odds_ratio(odds.contingency(labelled(spark, sf, policy), BINARY, FINDINGS), "always")
        parts.append(t.select("attribute", "finding", F.lit(policy).alias("policy"), "log_or"))
    wide = parts[0].unionByName(parts[1]).groupBy("attribute", "finding").pivot("policy", ["ignore", "zero"]).agg(F.max("log_or"))
    return wide.select("attribute", "finding", F.col("ignore").alias("log_or_ignore"), F.col("zero").alias("log_or_zero"))


@query("or_top_changes", f"""{_base('blank_dropped')}, s AS (SELECT entity_id, 1.0::DOUBLE / count(*) AS w FROM units GROUP BY entity_id),
j AS (SELECT * FROM pairs JOIN s USING (entity_id)),
c AS (SELECT attribute, finding, {COUNTS_SQL}, sum(w) FILTER (WHERE a=1 AND y=1) AS wtp, sum(w) FILTER (WHERE a=1 AND y=0) AS wfp,
 sum(w) FILTER (WHERE a=0 AND y=1) AS wfn, sum(w) FILTER (WHERE a=0 AND y=0) AS wtn FROM j GROUP BY ALL),
d AS (SELECT attribute, finding, tp * tn::DOUBLE / (fp * fn) AS u, wtp * wtn / (wfp * wfn) AS w FROM c)
SELECT attribute, finding, {r('u', 'or_unweighted')}, {r('abs(ln(u))', 'abs_log_or_unweighted')}, {r('w', 'or_weighted')}, {r('abs(ln(w))', 'abs_log_or_weighted')},
 {r('abs(ln(w)) - abs(ln(u))', 'or_change')} FROM d ORDER BY abs(abs(ln(w)) - abs(ln(u))) DESC LIMIT 5""")
def or_top_changes(spark, sf):
    df = labelled(spark, sf, "blank_dropped")
    plain = odds.odds_ratio(odds.contingency(df, BINARY, FINDINGS), "zero_cell")
    weighted = odds.odds_ratio(odds.entity_weighted_contingency(df, BINARY, FINDINGS, "entity_id"), "lt_half")
    return top_k(odds.compare_variants(plain, weighted, ("unweighted", "weighted")), F.abs("or_change"), 5)
