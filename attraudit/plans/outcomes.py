"""Studies on score tables, odds ratios and result panels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify_pattern
from ..functions.labels import apply_policy
from ..operators import cohort, fairness, odds, panel, ranking, resample, summary
from ..session import together


def subgroup_bias_study(scores: DataFrame, cell: Sequence[str], unit: str, group: str = "grp", b: int = 1000, q: float = 0.05) -> dict[str, DataFrame]:
    """Subgroup metrics, gaps with intervals and permutation p values, equalized odds, FDR (Q4)."""
    cell = list(cell)
    metrics = fairness.subgroup_metrics(scores, cell, group)
    enough = metrics.where("sufficient_data").select(*cell, group)
    valid = scores.join(enough, [*cell, group], "left_semi")
    cut = ranking.youden_grid(scores, cell).select(*cell, "threshold")
    odds_gap = fairness.equalized_odds(valid.join(cut, cell), cell, F.col("threshold"), group)
    gaps = resample.bootstrap_gap(valid, cell, group, b=b)
    tested = resample.permutation_gap(valid, cell, unit, group, b=b).select(*cell, "p_value")
    out = gaps.join(tested, cell, "left").join(odds_gap.drop("n_groups"), cell, "left")
    return {"metrics": metrics, "gaps": summary.benjamini_hochberg(out, [], q=q, small=True)}


def subgroup_intervals(scores: DataFrame, cell: Sequence[str], unit: str, group: str = "grp", b: int = 1000) -> DataFrame:
    """AUROC and average precision of every group with their bootstrap intervals."""
    keys = [*cell, group]
    parts = [resample.bootstrap_ci(scores.where(F.col(group).isNotNull()), keys, m, b=b, unit=unit).withColumn("metric", F.lit(m)) for m in ("auroc", "auprc")]
    return parts[0].unionByName(parts[1])


def multimetric_study(scores: DataFrame, cell: Sequence[str], group: str = "grp", fit_split: str | None = "train", b: int = 1000, min_n: int = 30, min_side: int = 5) -> dict[str, DataFrame]:
    """Gaps of AUROC, sensitivity, specificity, FPR, FNR and ECE at the Youden threshold (Q19).

    The threshold is chosen on `fit_split`; None chooses it on the scored rows
    themselves.
    """
    if b < 51:
        raise ValueError("the interval of the gap needs 51 valid draws")
    cell = list(cell)
    test = scores.where("split = 'test'")
    fit = test if fit_split is None else scores.where(F.col("split") == fit_split)
    cut = ranking.youden_roc(fit, cell).select(*cell, "threshold")
    with_cut = test.join(cut, cell)
    per = fairness.group_rates(with_cut, cell, F.col("threshold"), group)
    pos, n = F.col("n_pos"), F.col("n")
    per = per.where((n >= min_n) & (pos >= min_side) & (n - pos >= min_side))
    metrics = ["auroc", "sensitivity", "specificity", "fpr", "fnr", "ece"]
    gaps = fairness.gap_any_metric(per, cell, metrics, group)
    valid = test.join(per.select(*cell, group), [*cell, group], "left_semi")
    ci = resample.bootstrap_gap(valid, cell, group, b=b, min_side=3, drop_draw=False, min_valid=51)
    return {"groups": per, "gaps": gaps, "auroc_gap": ci}


def calibration_study(scores: DataFrame, cell: Sequence[str], group: str = "grp") -> dict[str, DataFrame]:
    """Base rates, calibration per group and rank correlation with prevalence (Q24)."""
    cal = fairness.calibration_by_group(scores, cell, group)
    return {
        "base_rates": fairness.base_rates(scores, cell, group), "spread": fairness.base_rate_spread(scores, cell, group),
        "calibration": cal, "correlation": panel.spearman(cal, ["model"], "auroc", "prevalence", small=True),
    }


def odds_study(units: DataFrame, attributes: Sequence[str], findings: Sequence[str], policy: str = "blank_dropped") -> DataFrame:
    """Odds ratios of all pairs under a label policy (part of Q8)."""
    df = units
    for f in findings:
        df = df.withColumn(f, apply_policy(F.col(f), policy))
    return odds.odds_ratio(odds.contingency(df, attributes, findings), "zero_cell", min_n=100)


def odds_panel(cells: DataFrame, odds_table: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """Dependence cells with their odds ratio and model geometry."""
    out = cells.join(odds_table.select("attribute", "finding", "log_or", "abs_log_or"), ["attribute", "finding"], "left")
    if geometry is not None:
        g = geometry.select("model", F.ln("effective_rank").alias("log_erank"), (F.col("effective_rank") / F.col("ambient_dim")).alias("norm_erank"))
        out = out.join(g, "model", "left")
    return out


def panel_regression(cells: DataFrame, y: str = "auroc_drop", x: str = "abs_log_or", geometry: str | None = "log_erank") -> dict[str, DataFrame]:
    """Nested regressions of dependence, per-model fits, concordance and outliers (Q8, Q9)."""
    num, cat, inter = panel.num, panel.cat, panel.inter
    by_model = [num(x), cat("model"), cat("finding")]
    fits = {
        "M1": [num(x)], "M5": [num(x), cat("finding")], "M6b": by_model, "M7b": [*by_model, panel.inter_cat(x, "model")],
        "M8": [num(x), cat("finding"), cat("attribute")],
    }
    if geometry:
        fits |= {
            "M2": [num(x), num(geometry)], "M6a": [num(x), num(geometry), cat("finding")],
            "M7a": [num(x), num(geometry), inter(x, geometry), cat("finding")],
        }
    fitted = panel.ols(cells, y, fits)
    residuals, _ = panel.predictions(cells, y, [x])
    return {
        "fits": panel.fit_table(fitted, base="M1"), "terms": fitted.drop("bread"),
        "per_model": panel.simple_ols(cells, ["model"], x, y), "rank_correlation": panel.spearman(cells, ["model"], x, y, small=True),
        "concordance": panel.kendall_w(cells, "attribute", "model", y),
        "underpredicted": summary.top_k(residuals, F.col("residual"), 10),
        "leave_one_finding_out": panel.leave_one_group_out(cells, y, [x], "finding"),
        "leave_one_attribute_out": panel.leave_one_group_out(cells, y, [x], "attribute"),
    }


def two_factor(cells: DataFrame, y: str = "auroc_drop", x: str = "abs_log_or", geometry: str = "log_erank") -> DataFrame:
    """Fits on the standardized odds ratio, the standardized geometry, both, and their product."""
    every = F.lit(True)
    z = cohort.zscore(cohort.zscore(cells.dropna(subset=[x, geometry, y]), x, every, "x_z"), geometry, every, "g_z")
    xz, gz = panel.num("x_z"), panel.num("g_z")
    return panel.ols(z, y, {"odds": [xz], "geometry": [gz], "both": [xz, gz], "product": [xz, gz, panel.inter("x_z", "g_z")]})


def extend_panel(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Panel rows of further attributes under the same columns."""
    return base.unionByName(extra.select(*[c for c in base.columns if c in extra.columns]), allowMissingColumns=True)


def timing_study(cells: DataFrame, flagged: Sequence[str], y: str = "auroc_drop", x: str = "abs_log_or") -> dict[str, DataFrame]:
    """Slope with errors clustered by attribute and by finding, in two strata, and their difference (Q15)."""
    c = cells.withColumn("flag", F.col("attribute").isin(*flagged))
    name = F.when(F.col("flag"), "flagged").otherwise("other")
    strata = c.withColumn("stratum", F.explode(F.array(F.lit("all"), name)))
    out = {}
    for cluster in ("attribute", "finding"):
        out[f"by_{cluster}"] = panel.cluster_robust(strata, y, [x], cluster, by=["stratum"]).where(F.col("term") == x)
    out["difference"] = panel.slope_difference(c, y, x, "flag", "attribute")
    return out


def diagnostics_study(cells: DataFrame, y: str = "auroc_drop", x: str = "abs_log_or", b: int = 2000) -> dict:
    """Residual shape, heteroscedasticity, influence, variance parts, robust and bootstrap slopes (Q16)."""
    unit = cells.withColumn("cell", F.concat_ws("|", "model", "attribute", "finding"))
    cook = panel.influence(unit, y, [x])
    mixed, robust = together(lambda: panel.random_intercept(cells, y, [x], "finding"), lambda: panel.huber(cells, y, [x]))
    return {
        "ols": panel.simple_ols(cells, [], x, y), "residuals": panel.residual_summary(cells, y, [x]),
        "normality": panel.residual_normality(cells, y, [x]), "breusch_pagan": panel.breusch_pagan(cells, y, [x]),
        "influence": panel.influence_counts(cook), "top_influence": cook.orderBy(F.col("cooks_d").desc(), "cell").limit(5),
        "mixed": mixed, "huber": robust, "bootstrap": resample.bootstrap_slope(unit, [], x, y, "cell", b=b),
    }


def entity_odds_study(units: DataFrame, attributes: Sequence[str], findings: Sequence[str], cells: DataFrame, seeds: Sequence[int] = range(100), policy: str = "blank_dropped") -> dict[str, DataFrame]:
    """One unit per entity: odds ratios, agreement with all units, slope stability over seeds."""
    df = units
    for f in findings:
        df = df.withColumn(f, apply_policy(F.col(f), policy))
    full = odds.odds_ratio(odds.contingency(df, attributes, findings), "zero_cell", min_n=100)
    one = odds.odds_ratio(odds.contingency(cohort.one_per_entity(df, "entity_id", "unit_id"), attributes, findings), "zero_cell", min_n=10)
    both = odds.compare_variants(full, one, ("all_units", "one_per_entity"))
    sweep = odds.odds_ratio(odds.contingency(cohort.one_per_entity_patterns(df, "entity_id", "unit_id", [*attributes, *findings], list(seeds)), attributes, findings, by=["seed"], weight="n"), "zero_cell", min_n=10)
    j = sweep.select("seed", "attribute", "finding", "abs_log_or").join(cells.select("attribute", "finding", "auroc_drop"), ["attribute", "finding"])
    fits = panel.simple_ols(j, ["seed"], "abs_log_or", "auroc_drop")
    stability = fits.agg(
        F.avg("r2").alias("mean_r2"), F.percentile("r2", 0.025).alias("r2_low"), F.percentile("r2", 0.975).alias("r2_high"), F.count("r2").alias("n_seeds")
    )
    return {"odds": both, "check": panel.pearson(both, [], "abs_log_or_all_units", "abs_log_or_one_per_entity"), "seeds": fits, "stability": stability}


def weighted_odds_study(units: DataFrame, attributes: Sequence[str], findings: Sequence[str], cells: DataFrame, policy: str = "blank_dropped") -> dict[str, DataFrame]:
    """Odds ratios weighted by 1 / rows of the entity, and the slopes under both (Q11)."""
    df = units
    for f in findings:
        df = df.withColumn(f, apply_policy(F.col(f), policy))
    plain = odds.odds_ratio(odds.contingency(df, attributes, findings), "zero_cell", min_n=100)
    weighted = odds.odds_ratio(odds.entity_weighted_contingency(df, attributes, findings, "entity_id"), "lt_half")
    both = odds.compare_variants(plain, weighted, ("unweighted", "weighted"))
    return _variant_slopes(both, cells, ("unweighted", "weighted"))


def stratified_odds_study(units: DataFrame, attributes: Sequence[str], findings: Sequence[str], cells: DataFrame, stratum: str, policy: str = "blank_dropped") -> dict[str, DataFrame]:
    """Crude against Mantel-Haenszel odds ratios, and the slopes under both (Q12)."""
    df = units
    for f in findings:
        df = df.withColumn(f, apply_policy(F.col(f), policy))
    mh = odds.mantel_haenszel(df, attributes, findings, stratum).withColumn(
        "or_change", F.col("abs_log_or_mh") - F.col("abs_log_or_crude")
    )
    return _variant_slopes(mh, cells, ("crude", "mh"))


def _variant_slopes(both: DataFrame, cells: DataFrame, names: tuple[str, str]) -> dict[str, DataFrame]:
    a, b = names
    j = cells.join(both, ["attribute", "finding"])
    out = {"odds": both, "top_changes": summary.top_k(both, F.abs("or_change"), 10)}
    for n in names:
        out[f"slope_{n}"] = panel.simple_ols(j, [], f"abs_log_or_{n}", "auroc_drop")
    out["rank_agreement"] = panel.rank_agreement(both, both, "attribute", f"abs_log_or_{a}", f"abs_log_or_{b}")
    return out


def label_policy_study(units: DataFrame, attributes: Sequence[str], findings: Sequence[str], policies: tuple[str, str] = ("ignore", "zero")) -> dict[str, DataFrame]:
    """Log odds ratios under two label policies and their rank correlation (Q14)."""
    parts = None
    for policy in policies:
        df = units
        for f in findings:
            df = df.withColumn(f, apply_policy(F.col(f), policy))
        t = odds.odds_ratio(odds.contingency(df, attributes, findings), "always", min_side=20)
        t = t.select("attribute", "finding", F.lit(policy).alias("policy"), "log_or")
        parts = t if parts is None else parts.unionByName(t)
    wide = parts.groupBy("attribute", "finding").pivot("policy", list(policies)).agg(F.max("log_or"))
    return {"odds": wide, "agreement": panel.spearman(wide.dropna(), [], *policies, small=True)}


def pattern_study(cells: DataFrame) -> dict[str, DataFrame]:
    """Encoding-dependence patterns, their stability and correlations (Q17).

    `cells`: attribute, encoding_metric, encoding_value, dependence.
    """
    named = cells.withColumn("pattern", classify_pattern(F.col("encoding_metric"), F.col("encoding_value"), F.col("dependence")))
    return {
        "patterns": named, "sweep": summary.pattern_sweep(cells), "stability": summary.pattern_stability(cells),
        "correlation": panel.encoding_dependence(cells, "encoding_metric", "encoding_value", "dependence"),
        "ranks": summary.rank_differences(cells, "encoding_value", "dependence"),
    }


def external_summary(aurocs: DataFrame, gaps: DataFrame, drops: DataFrame) -> DataFrame:
    """Mean AUROC, gap and drop per model and their ratio on an external cohort."""
    a = aurocs.groupBy("model").agg(F.avg("auroc").alias("mean_auroc"))
    g = gaps.groupBy("model").agg(F.avg("gap").alias("mean_gap"))
    d = drops.groupBy("model").agg(F.avg("auroc_drop").alias("mean_drop"))
    out = a.join(g, "model", "left").join(d, "model", "left")
    return out.withColumn("gap_drop_ratio", summary.gap_drop_ratio(F.col("mean_gap"), F.col("mean_drop")))


def gate_study(scores: DataFrame, cell: Sequence[str], minimum: float = 0.75) -> DataFrame:
    """Label-quality gate: mean AUROC of plain probes against a limit (Q28)."""
    return summary.quality_gate(ranking.auroc(scores, cell), minimum=minimum)


def figure_tables(encoding: DataFrame, cells: DataFrame, changes: DataFrame, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Data of the encoding-dependence scatter, the odds scatter and the gap histogram."""
    aliases = aliases or {"gender_binary": "sex"}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.col("attribute")], F.col("attribute"))
    e = encoding.withColumn("attribute", name).groupBy("attribute").agg(F.avg("encoding_value").alias("encoding"))
    d = cells.withColumn("attribute", name).groupBy("attribute").agg(F.avg("auroc_drop").alias("dependence"))
    return {
        "encoding_dependence": e.join(d, "attribute", "left"), "odds_line": panel.simple_ols(cells, [], "abs_log_or", "auroc_drop"),
        "gap_histogram": summary.histogram(changes, "reduction", 30),
    }
