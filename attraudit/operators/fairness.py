"""Subgroup metrics and max-min gaps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import auroc, calibration, confusion, ranking_metrics, rates


def subgroup_metrics(
    scores: DataFrame, cell: Sequence[str], group: str = "grp", min_n: int = 50, min_pos: int = 15, min_neg: int = 15,
    n_bins: int = 10, closed_last: bool = False,
) -> DataFrame:
    """AUROC, AUPRC, ECE and Brier per group; too small groups keep counts only."""
    keys = [*cell, group]
    rank = ranking_metrics(scores, keys).drop("threshold")
    cal = calibration(scores, keys, n_bins=n_bins, closed_last=closed_last).select(*keys, "ece", "brier")
    both = rank.join(cal, keys)
    ok = (F.col("n") >= min_n) & (F.col("n_pos") >= min_pos) & (F.col("n") - F.col("n_pos") >= min_neg)
    return both.select(
        *keys, "n", "n_pos", (F.col("n_pos") / F.col("n")).alias("prevalence"), ok.alias("sufficient_data"),
        *[F.when(ok, F.col(m)).alias(m) for m in ("auroc", "auprc", "ece", "brier")],
    )


def subgroup_auroc(
    scores: DataFrame, cell: Sequence[str], group: str = "grp", min_n: int = 50, min_pos: int = 15, min_neg: int = 15
) -> DataFrame:
    """AUROC of every large enough group."""
    a = auroc(scores, [*cell, group])
    return a.where(
        (F.col("n") >= min_n) & (F.col("n_pos") >= min_pos) & (F.col("n") - F.col("n_pos") >= min_neg)
    )


def widen(table: DataFrame, cell: Sequence[str], group: str, groups: Sequence[str], metric: str) -> DataFrame:
    """One column per group."""
    return table.groupBy(*cell).pivot(group, list(groups)).agg(F.max(metric))


def gap(table: DataFrame, cell: Sequence[str], group: str = "grp", metric: str = "auroc") -> DataFrame:
    """Max-min gap with the names of both ends; needs two groups.

    Equal values are settled by group name, so the result is the same every run.
    """
    valid = table.where(F.col(metric).isNotNull())
    hi = F.max(F.struct(F.col(metric).alias("v"), F.col(group).alias("g")))
    lo = F.min(F.struct(F.col(metric).alias("v"), F.col(group).alias("g")))
    agg = valid.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_groups"), hi.alias("hi"), lo.alias("lo"))
    return agg.where(F.col("n_groups") >= 2).select(
        *cell, "n_groups", F.col("hi.g").alias("max_group"), F.col("lo.g").alias("min_group"),
        F.col("hi.v").alias("max_value"), F.col("lo.v").alias("min_value"),
        (F.col("hi.v") - F.col("lo.v")).alias("gap"),
    )


def gap_any_metric(table: DataFrame, cell: Sequence[str], metrics: Sequence[str], group: str = "grp") -> DataFrame:
    """Gap of every per-group metric, one row per metric."""
    long = table.select(*cell, group, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [*cell, group], list(metrics), "metric", "value"
    )
    return gap(long, [*cell, "metric"], group, "value")


def group_rates(
    scores: DataFrame, cell: Sequence[str], threshold: Column, group: str = "grp", closed_last: bool = True
) -> DataFrame:
    """Sensitivity, specificity, FPR, FNR, AUROC and ECE per group at one threshold."""
    keys = [*cell, group]
    r = rates(confusion(scores, keys, threshold)).drop("n")
    a = auroc(scores, keys)
    c = calibration(scores, keys, closed_last=closed_last).select(*keys, "ece")
    return r.join(a, keys).join(c, keys)


def equalized_odds(
    scores: DataFrame, cell: Sequence[str], threshold: Column, group: str = "grp", min_n: int = 10
) -> DataFrame:
    """Largest TPR and FPR differences between groups and their sum."""
    per = rates(confusion(scores, [*cell, group], threshold))
    ok = (F.col("n") >= min_n) & (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    tpr, fpr = F.when(ok, F.col("sensitivity")), F.when(ok, F.col("fp") / (F.col("fp") + F.col("tn")))
    agg = per.groupBy(*cell).agg(
        F.count(tpr).alias("n_groups"), (F.max(tpr) - F.min(tpr)).alias("tpr"), (F.max(fpr) - F.min(fpr)).alias("fpr")
    )
    two = F.col("n_groups") >= 2
    return agg.select(
        *cell, "n_groups", F.when(two, F.col("tpr")).alias("tpr_gap"), F.when(two, F.col("fpr")).alias("fpr_gap"),
        F.when(two, F.col("tpr") + F.col("fpr")).alias("eq_odds_diff"),
    )


def base_rates(rows: DataFrame, cell: Sequence[str], group: str = "grp", y: str = "y", min_n: int = 30) -> DataFrame:
    """Prevalence per finding and group."""
    return (
        rows.where(F.col(y).isNotNull()).groupBy(*cell, group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("n_pos"), F.avg(y).alias("prevalence"))
        .where(F.col("n") >= min_n)
    )


def base_rate_spread(rows: DataFrame, cell: Sequence[str], group: str = "grp", y: str = "y", min_n: int = 30) -> DataFrame:
    return base_rates(rows, cell, group, y, min_n).groupBy(*cell).agg(
        (F.max("prevalence") - F.min("prevalence")).alias("spread"), F.max("prevalence").alias("max_prevalence"),
        F.min("prevalence").alias("min_prevalence"),
    )


def calibration_by_group(scores: DataFrame, cell: Sequence[str], group: str = "grp", min_n: int = 30, min_pos: int = 5) -> DataFrame:
    """AUROC, Brier, mean score, prevalence and their difference per group."""
    keys = [*cell, group]
    a = auroc(scores, keys)
    c = calibration(scores, keys).select(*keys, "brier", "mean_p", "prevalence")
    out = a.join(c, keys).where(
        (F.col("n") >= min_n) & (F.col("n_pos") >= min_pos) & (F.col("n") - F.col("n_pos") >= min_pos)
    )
    return out.withColumn("calibration_gap", F.col("mean_p") - F.col("prevalence"))


def before_after(table: DataFrame, cell: Sequence[str], strategy: str, baseline: str, value: str) -> DataFrame:
    """Change of a value against the baseline strategy of the same cell.

    Conditional aggregation in place of a self-join: one shuffle on the cell.
    """
    pairs = F.collect_list(F.when(F.col(strategy) != baseline, F.struct(strategy, F.col(value))))
    agg = table.groupBy(*cell).agg(
        F.max(F.when(F.col(strategy) == baseline, F.col(value))).alias("before"), pairs.alias("others")
    )
    return agg.select(*cell, "before", F.explode("others").alias("o")).select(
        *cell, F.col(f"o.{strategy}").alias(strategy), "before", F.col(f"o.{value}").alias("after"),
        (F.col("before") - F.col(f"o.{value}")).alias("reduction"),
    )
