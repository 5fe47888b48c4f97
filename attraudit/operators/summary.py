"""Summaries of result tables: averages, threshold grids, rankings, formatting of panels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import PATTERNS, classify_confounding, classify_pattern
from .running import rank_rows, running_totals


def summarize(panel: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median, sample deviation and count per key."""
    v = F.col(value)
    return panel.groupBy(*keys).agg(
        F.avg(v).alias(f"mean_{value}"), F.percentile(v, 0.5).alias(f"median_{value}"),
        F.stddev_samp(v).alias(f"std_{value}"), F.count(v).alias("n_obs"),
    )


def over_seeds(panel: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over seeds."""
    return panel.groupBy(*keys).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"), F.count(value).alias("n_seeds")
    )


def with_overall(panel: DataFrame, keys: Sequence[str], detail: str, seed: str, value: str, label: str = "MEAN") -> DataFrame:
    """Rows per detail level plus an overall row per key.

    The overall row is the mean over seeds of the mean over detail levels.
    """
    both = panel.groupingSets(
        [[*keys, detail, seed], [*keys, seed]], *keys, detail, seed
    ).agg(F.avg(value).alias("v"), F.grouping(detail).alias("g"))
    named = both.withColumn(detail, F.when(F.col("g") == 1, F.lit(label)).otherwise(F.col(detail)))
    return named.groupBy(*keys, detail).agg(
        F.avg("v").alias(f"{value}_mean"), F.stddev_pop("v").alias(f"{value}_std"), F.count("v").alias("n_seeds")
    )


def condition_summary(panel: DataFrame, conditions: Sequence[str], baseline: str) -> DataFrame:
    """Mean of each condition column, reduction against the baseline and percent."""
    long = panel.select(*[F.col(c).cast("double").alias(c) for c in conditions]).unpivot([], list(conditions), "condition", "v")
    agg = long.groupBy("condition").agg(F.avg("v").alias("mean_gap"), F.count("v").alias("n_cells"))
    base = F.max(F.when(F.col("condition") == baseline, F.col("mean_gap"))).over(W.partitionBy())
    out = agg.withColumn("gap_reduction", base - F.col("mean_gap"))
    return out.withColumn(
        "pct_reduction", F.col("gap_reduction") / F.greatest(F.col("gap_reduction") + F.col("mean_gap"), F.lit(1e-9)) * 100
    )


def redundancy(panel: DataFrame, singles: Sequence[str], joint: str) -> DataFrame:
    """Sum of single drops against the joint drop."""
    total = sum((F.col(c) for c in singles), F.lit(0.0))
    out = panel.withColumn("sum_individual", total).withColumn("redundancy", F.col("sum_individual") - F.col(joint))
    return out.withColumn(
        "redundancy_pct",
        F.when(F.col("sum_individual") > 0, F.col("redundancy") / F.col("sum_individual") * 100).otherwise(0.0),
    )


def gap_drop_ratio(gap: Column, drop: Column, floor: float | None = None) -> Column:
    """Gap over drop; null when the drop is not positive, or floored at `floor`."""
    if floor is not None:
        return gap / F.greatest(drop, F.lit(floor))
    return F.when(drop > 0, gap / drop)


def confounding_grid(
    cells: DataFrame, drop: str, added: str,
    genuine_drops=(0.02, 0.03, 0.04, 0.05), genuine_added=(0.03, 0.05, 0.07), heavy_drops=(0.06, 0.08, 0.10),
) -> DataFrame:
    """Class counts under a grid of cutoffs (A31, J14, P18); the default cutoffs are fixed values of the study."""
    grid = F.array(*[
        F.struct(F.lit(a).alias("genuine_max_drop"), F.lit(b).alias("genuine_min_added"), F.lit(c).alias("heavy_min_drop"))
        for a in genuine_drops for b in genuine_added for c in heavy_drops
    ])
    rows = cells.select(drop, added, F.explode(grid).alias("g")).select(drop, added, "g.*")
    cls = classify_confounding(
        F.col(drop), F.col(added), F.col("genuine_max_drop"), F.col("genuine_min_added"), F.col("heavy_min_drop")
    )
    names = ("genuine", "partially_confounded", "heavily_confounded", "unknown")
    keys = ["genuine_max_drop", "genuine_min_added", "heavy_min_drop"]
    return rows.withColumn("c", cls).groupBy(*keys).agg(*[F.count_if(F.col("c") == n).alias(n) for n in names])


# The sweep of encoding and dependence cutoffs.
ENCODING_SWEEP = ((0.60, 0.05), (0.65, 0.10), (0.70, 0.15), (0.75, 0.20), (0.80, 0.30))
DEPENDENCE_SWEEP = (0.002, 0.003, 0.005, 0.007, 0.010)


def _patterns_over(cells: DataFrame, grid: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    g = F.array(*[
        F.struct(F.lit(s).alias("sweep"), F.lit(a).alias("auroc_cut"), F.lit(r).alias("r2_cut"), F.lit(d).alias("dependence_cut"))
        for s, a, r, d in grid
    ])
    rows = cells.select("*", F.explode(g).alias("g")).select(*cells.columns, "g.*")
    m, e, d = F.col("encoding_metric"), F.col("encoding_value"), F.col("dependence")
    return rows.withColumn("reference", classify_pattern(m, e, d)).withColumn(
        "pattern", classify_pattern(m, e, d, F.col("auroc_cut"), F.col("r2_cut"), F.col("dependence_cut"))
    )


def pattern_sweep(cells: DataFrame) -> DataFrame:
    """Pattern counts and changes while one cutoff moves."""
    grid = [("encoding", a, r, 0.005) for a, r in ENCODING_SWEEP]
    grid += [("dependence", 0.70, 0.10, d) for d in DEPENDENCE_SWEEP]
    names = ("n_orthogonal", "n_entangled", "n_hidden", "n_irrelevant")
    return _patterns_over(cells, grid).groupBy("sweep", "auroc_cut", "r2_cut", "dependence_cut").agg(
        *[F.count_if(F.col("pattern") == p).alias(n) for p, n in zip(PATTERNS, names)],
        F.count_if(F.col("pattern") != F.col("reference")).alias("n_changed"),
    )


def pattern_stability(cells: DataFrame, keys: Sequence[str] = ("attribute",)) -> DataFrame:
    """Share of cutoff pairs that keep the reference pattern, and the commonest."""
    grid = [("both", a, r, d) for a, r in ENCODING_SWEEP for d in DEPENDENCE_SWEEP]
    return _patterns_over(cells, grid).groupBy(*keys).agg(
        F.max("reference").alias("reference_pattern"),
        F.avg((F.col("pattern") == F.col("reference")).cast("double")).alias("stability"),
        F.mode("pattern", True).alias("most_common_pattern"), F.count(F.lit(1)).alias("n_combinations"),
    )


def top_k(panel: DataFrame, by: Column, k: int) -> DataFrame:
    """The k rows with the largest value."""
    return panel.orderBy(by.desc()).limit(k)


def top_k_per_group(panel: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of every group (L4); Spark prunes to k per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return panel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_differences(panel: DataFrame, a: str, b: str) -> DataFrame:
    """Descending average ranks of two columns and their difference."""
    r = rank_rows(panel, [], a, f"{a}_rank", descending=True)
    r = rank_rows(r, [], b, f"{b}_rank", descending=True)
    return r.withColumn("rank_gap", F.col(f"{b}_rank") - F.col(f"{a}_rank"))


def best_under_constraint(panel: DataFrame, keys: Sequence[str], ok: Column, score: str, fallback: str, pick: str) -> DataFrame:
    """Best-scoring candidate that meets a constraint, else the lowest fallback value."""
    return panel.groupBy(*keys).agg(
        F.coalesce(
            F.max_by(F.col(pick), F.when(ok, F.struct(F.col(score), F.col(pick)))),
            F.min_by(F.col(pick), F.struct(F.col(fallback), F.col(pick))),
        ).alias(pick)
    )


def histogram(panel: DataFrame, value: str, n_bins: int = 30) -> DataFrame:
    """Equal-width histogram between the extremes."""
    ends = panel.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e")).scalar()
    lo, hi = F.col("__e.lo"), F.col("__e.hi")
    raw = F.when(F.col(value) == hi, F.lit(n_bins)).otherwise(F.width_bucket(F.col(value), lo, hi, F.lit(n_bins)))
    known = panel.where(F.col(value).isNotNull()).withColumn("__e", ends)
    return known.groupBy(raw.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quality_gate(aurocs: DataFrame, value: str = "auroc", minimum: float = 0.75) -> DataFrame:
    """Pass or fail on the mean AUROC."""
    mean = F.avg(value)
    return aurocs.agg(
        mean.alias("mean_auroc"), F.count(value).alias("n_findings"),
        F.when(mean >= minimum, "PASS").otherwise("FAIL").alias("verdict"),
    )


def benjamini_hochberg(
    tests: DataFrame, family: Sequence[str], p: str = "p_value", q: float = 0.05, small: bool = False
) -> DataFrame:
    """Step-up FDR adjustment inside each family; null p values stay null.

    Ranks come from running counts over distinct p values, so a family may be
    larger than one task can sort; the adjusted value is joined back by p, so the
    table of tests must be a stored one. `small` is for a panel of computed
    tests, one row per cell: plain windows and no join.
    """
    fam = list(family)
    if small:
        known = F.col(p).isNotNull()
        part = [*fam, known]
        upto = F.count(F.lit(1)).over(W.partitionBy(*part).orderBy(p))
        raw = tests.withColumn("__raw", F.col(p) * F.count(F.lit(1)).over(W.partitionBy(*part)) / upto)
        adj = F.min("__raw").over(W.partitionBy(*part).orderBy(F.col(p).desc()))
        out = raw.withColumn("p_adjusted", F.when(known, F.least(adj, F.lit(1.0)))).drop("__raw")
        return out.withColumn("rejected", F.coalesce(F.col("p_adjusted") < q, F.lit(False)))
    counts = tests.where(F.col(p).isNotNull()).groupBy(*fam, F.col(p).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    edges = tests.select(F.col(p).cast("double").alias("__p")).where(F.col("__p").isNotNull())
    ranked = running_totals(counts, fam, "__p", {"n": "below"}, edges_from=edges)
    raw = ranked.withColumn("__adj", F.col("__p") * F.col("all_below") / (F.col("below") + F.col("n")))
    low = running_totals(raw.select(*fam, "__p", "__adj"), fam, "__p", {}, {"__adj": "__min"}, edges_from=edges)
    adj = low.select(*[F.col(c).alias(f"__f_{c}") for c in fam], "__p", F.least("__min", F.lit(1.0)).alias("p_adjusted"))
    cond = [tests[c].eqNullSafe(F.col(f"__f_{c}")) for c in fam] + [tests[p].cast("double") == F.col("__p")]
    return tests.join(adj, cond, "left").select(
        *[tests[c] for c in tests.columns], "p_adjusted", F.coalesce(F.col("p_adjusted") < q, F.lit(False)).alias("rejected")
    )


def significant_counts(tests: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Number of significant cells per key."""
    return tests.groupBy(*keys).agg(F.sum(F.col(flag).cast("bigint")).alias("n_significant"), F.count(F.lit(1)).alias("n_cells"))
