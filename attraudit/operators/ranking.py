"""Ranking, calibration and threshold metrics for any number of cells at once.

The contract is a score table: one row per (cell..., unit) with y in {0, 1} and
a score p. A cell is a list of key columns; rows with a null key are left out.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import BUCKET, default_buckets, running_totals, with_buckets

ROWS_A_TASK = 1 << 19  # score rows that a task sorts at once where the number of rows is known


def ranked(
    scores: DataFrame, cell: Sequence[str], p: str = "p", y: str = "y", weight: str | None = None,
    edges_from: DataFrame | None = None,
) -> DataFrame:
    """Distinct scores per cell with counts at and below them.

    `edges_from` holds the same scores without replicates, to place the buckets.
    """
    w = F.col(weight) if weight else F.lit(1)
    known = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    counts = (
        known.groupBy(*cell, F.col(p).cast("double").alias("s"))
        .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
             F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"))
    )
    edges = (known if edges_from is None else edges_from).select(F.col(p).cast("double").alias("s"))
    run = running_totals(counts, cell, "s", {"pos": "pos_below", "neg": "neg_below"}, edges_from=edges)
    return run.withColumnRenamed("all_pos_below", "n_pos").withColumnRenamed("all_neg_below", "n_neg")


def _area() -> Column:
    return F.try_divide(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)), F.max(F.col("n_pos") * F.col("n_neg"))
    )


def _precision_area() -> Column:
    hit = F.col("n_pos") - F.col("pos_below")
    called = hit + F.col("n_neg") - F.col("neg_below")
    return F.sum(F.col("pos") / F.col("n_pos") * F.try_divide(hit, called))


def _counts() -> list[Column]:
    return [
        F.max(F.col("n_pos") + F.col("n_neg")).cast("bigint").alias("n"),
        F.max("n_pos").cast("bigint").alias("n_pos"),
    ]


def auroc(
    scores: DataFrame, cell: Sequence[str], p: str = "p", y: str = "y", weight: str | None = None,
    edges_from: DataFrame | None = None,
) -> DataFrame:
    """Area under the ROC curve, ties at one half; null for one-class cells."""
    return ranked(scores, cell, p, y, weight, edges_from).groupBy(*cell).agg(*_counts(), _area().alias("auroc"))


def auroc_by_size(
    scores: DataFrame, cell: Sequence[str], rows: int, p: str = "p", y: str = "y", attributes: Sequence[str] = (), rows_a_task: int = ROWS_A_TASK,
) -> DataFrame:
    """`auroc` of about `rows` score rows in tasks whose memory doesn't grow with them.

    There are as many buckets and tasks as the rows fill, whatever the session's shuffle partitions are. Rows are
    exchanged once, by cell and bucket; what leaves a bucket is its own area, positives and negatives, and the negatives
    of lower buckets are added to these sums. A value that fills several buckets comes last in its own and is salted.
    `attributes` names columns whose known values `a` are cells of their own, (attribute, a): rows repeat once per
    attribute inside the tasks only.
    """
    cell = list(cell)
    known = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*cell, *attributes, F.col(p).cast("double").alias("s"), F.col(y).alias("__y"))
    edges = known.select("s")
    parts = -(-rows * max(1, len(attributes)) // rows_a_task)
    usual = default_buckets(known)
    cut = with_buckets(known, "s", max(parts, usual), edges, hot="__hot")
    salt = F.when(F.col("__hot"), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(max(parts, usual)))).otherwise(0)
    by = [*cell, BUCKET, "__hot", "__salt"]
    dealt = cut.withColumn("__salt", salt)
    dealt = dealt.repartition(parts, *by) if parts > usual else dealt.repartition(*by)
    if attributes:
        each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("a")) for a in attributes])
        dealt = dealt.select(*by, "s", "__y", F.explode(each).alias("__r")).select(*by, "s", "__y", "__r.*").where(F.col("a").isNotNull())
        cell, by = [*cell, "attribute", "a"], [*by, "attribute", "a"]
    counts = dealt.groupBy(*by, "s").agg(F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") == 0).alias("neg"))
    below = F.sum("neg").over(W.partitionBy(*by).orderBy("s")) - F.col("neg")
    own = F.when(F.col("__hot"), 0.0).otherwise(F.col("pos") * (below + F.col("neg") / 2.0))
    local = counts.withColumn("area", own).groupBy(*cell, BUCKET, "__hot").agg(*[F.sum(c).alias(c) for c in ("area", "pos", "neg")])
    lower = F.sum("neg").over(W.partitionBy(*cell).orderBy(BUCKET, "__hot")) - F.col("neg")
    moved = F.col("area") + F.col("pos") * (lower + F.when(F.col("__hot"), F.col("neg") / 2.0).otherwise(0.0))
    return local.withColumn("area", moved).groupBy(*cell).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"),
        F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auroc"),
    )


def auprc(scores: DataFrame, cell: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Average precision, step-wise."""
    return ranked(scores, cell, p, y).groupBy(*cell).agg(*_counts(), _precision_area().alias("auprc"))


def _youden_point() -> Column:
    hit = (F.col("n_pos") - F.col("pos_below")) / F.col("n_pos")
    false = (F.col("n_neg") - F.col("neg_below")) / F.col("n_neg")
    return F.max(F.struct((hit - false).alias("j"), F.col("s").alias("threshold")))


def youden_roc(scores: DataFrame, cell: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Threshold with the largest TPR - FPR on the full curve; ties take the highest."""
    best = ranked(scores, cell, p, y).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    best = best.groupBy(*cell).agg(_youden_point().alias("b"))
    return best.select(
        *cell, F.when(F.col("b.j") > 0, F.col("b.threshold")).alias("threshold"),
        F.greatest(F.col("b.j"), F.lit(0.0)).alias("youden_j"),
    )


def ranking_metrics(scores: DataFrame, cell: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """AUROC, average precision and the Youden threshold from one ordered pass."""
    r = ranked(scores, cell, p, y).groupBy(*cell).agg(
        *_counts(), _area().alias("auroc"), _precision_area().alias("auprc"), _youden_point().alias("b")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return r.select(
        *cell, "n", "n_pos", "auroc", F.when(F.col("n_pos") > 0, F.col("auprc")).alias("auprc"),
        F.when(both & (F.col("b.j") > 0), F.col("b.threshold")).alias("threshold"),
    )


def ovr_auroc(scores: DataFrame, cell: Sequence[str], truth: str, class_scores: dict[str, str]) -> DataFrame:
    """One-vs-rest AUROC per class and their mean."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(col).alias("p"), (F.col(truth) == c).cast("int").alias("y"))
        for c, col in class_scores.items()
    ])
    long = scores.select(*cell, F.explode(rows).alias("r")).select(*cell, "r.*")
    per = auroc(long, [*cell, "class"])
    return per.groupBy(*cell).agg(
        F.avg("auroc").alias("macro_auroc"),
        *[F.max(F.when(F.col("class") == c, F.col("auroc"))).alias(f"auroc_{c}") for c in class_scores],
    )


def regression_metrics(rows: DataFrame, cell: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Mean absolute error and R2 (A10)."""
    e = F.col(y) - F.col(p)
    return rows.groupBy(*cell).agg(
        F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def equal_bins(p: Column, n_bins: int = 10, closed_last: bool = True) -> Column:
    """Bin number by comparison with the edges i / n; outside values give null."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    b = F.lit(-1)
    for e in edges[:-1]:
        b = b + (p >= F.lit(e)).cast("int")
    inside = (p >= 0.0) & ((p <= 1.0) if closed_last else (p < 1.0))
    return F.when(inside, b)


def calibration(
    scores: DataFrame, cell: Sequence[str], p: str = "p", y: str = "y", n_bins: int = 10, closed_last: bool = True
) -> DataFrame:
    """ECE, Brier score, mean score and prevalence per cell.

    closed_last=False leaves p = 1 out of the last bin.
    """
    rows = scores.where(F.col(y).isNotNull()).withColumn("__b", equal_bins(F.col(p), n_bins, closed_last))
    bins = rows.groupBy(*cell, "__b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"),
        F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"),
    )
    gap = F.when(F.col("__b").isNotNull(), F.abs(F.col("sy") - F.col("sp"))).otherwise(0.0)
    n = F.sum("n")
    return bins.groupBy(*cell).agg(
        n.alias("n"), (F.sum(gap) / n).alias("ece"), (F.sum("se") / n).alias("brier"),
        (F.sum("sp") / n).alias("mean_p"), (F.sum("sy") / n).alias("prevalence"),
    )


def confusion(scores: DataFrame, cell: Sequence[str], threshold: Column, p: str = "p", y: str = "y") -> DataFrame:
    """tp, fp, fn, tn at `p >= threshold`."""
    called, true = F.col(p) >= threshold, F.col(y) == 1
    rows = scores.where(F.col(y).isNotNull())
    return rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(called & true).alias("tp"), F.count_if(called & ~true).alias("fp"),
        F.count_if(~called & true).alias("fn"), F.count_if(~called & ~true).alias("tn"),
    )


def rates(table: DataFrame) -> DataFrame:
    """Sensitivity, specificity, FPR and FNR from confusion counts."""
    sens = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return (
        table.withColumn("sensitivity", sens).withColumn("specificity", spec)
        .withColumn("fpr", 1 - spec).withColumn("fnr", 1 - sens)
    )


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation, 0 when a margin is empty."""
    tp, fp, fn, tn = [c.cast("double") for c in (tp, fp, fn, tn)]
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)


# Threshold grids the results depend on.
YOUDEN_GRID = [0.1 + 0.05 * i for i in range(17)]
MCC_GRID = [0.05 + 0.05 * i for i in range(19)]


def grid_confusion(
    scores: DataFrame, cell: Sequence[str], grid: Sequence[float], p: str = "p", y: str = "y"
) -> DataFrame:
    """Confusion counts of every cell at every grid threshold.

    Scores are binned by the grid once; rows are never repeated per threshold.
    """
    step = F.lit(0)
    for t in grid:
        step = step + (F.col(p) >= F.lit(float(t))).cast("int")
    bins = (
        scores.where(F.col(y).isNotNull()).groupBy(*cell, step.alias("__step"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    wide = bins.groupBy(*cell).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        *[F.sum(F.when(F.col("__step") > i, F.col("pos")).otherwise(0)).alias(f"tp{i}") for i in range(len(grid))],
        *[F.sum(F.when(F.col("__step") > i, F.col("neg")).otherwise(0)).alias(f"fp{i}") for i in range(len(grid))],
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(grid)
    ])
    long = wide.select(*cell, "n_pos", "n_neg", F.explode(rows).alias("g")).select(*cell, "n_pos", "n_neg", "g.*")
    return long.withColumn("fn", F.col("n_pos") - F.col("tp")).withColumn("tn", F.col("n_neg") - F.col("fp"))


def youden_grid(scores: DataFrame, cell: Sequence[str], grid: Sequence[float] = tuple(YOUDEN_GRID)) -> DataFrame:
    """Best TPR - FPR over a grid; lowest threshold on ties, .5 if all are degenerate."""
    g = grid_confusion(scores, cell, grid)
    called = F.col("tp") + F.col("fp")
    j = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), F.lit(0.0)) - F.coalesce(
        F.try_divide(F.col("fp"), F.col("n_neg")), F.lit(0.0)
    )
    ok = (called > 0) & (called < F.col("n_pos") + F.col("n_neg"))
    best = F.max(F.when(ok, F.struct(j.alias("j"), (-F.col("threshold")).alias("t"))))
    return g.groupBy(*cell).agg(best.alias("b")).select(
        *cell, F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.col("b.j").alias("youden_j")
    )


def best_mcc(
    scores: DataFrame, cell: Sequence[str], split: str = "split", grid: Sequence[float] = tuple(MCC_GRID)
) -> DataFrame:
    """MCC on test rows at the threshold that is best on train rows."""
    g = grid_confusion(scores, [*cell, split], grid)
    g = g.withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    is_train = F.col(split) == "train"
    per = g.groupBy(*cell, "threshold").agg(
        F.max(F.when(is_train, F.col("mcc"))).alias("train"),
        F.max(F.when(F.col(split) == "test", F.col("mcc"))).alias("test"),
    )
    top = F.max(F.struct(F.col("train"), (-F.col("threshold")).alias("t"), F.col("test")))
    return per.where(F.col("train").isNotNull()).groupBy(*cell).agg(top.alias("b")).select(
        *cell, (-F.col("b.t")).alias("threshold"), F.col("b.train").alias("mcc_train"), F.col("b.test").alias("mcc")
    )


def delong(
    scores: DataFrame, cell: Sequence[str], unit: str, model: str, models: Sequence[str], ties: str = "half",
    p: str = "p", y: str = "y",
) -> DataFrame:
    """Paired AUROC test for every model pair of a cell.

    Each row gets its placement among the other class from running counts. The
    placements of one unit are laid out side by side, one column per model, so
    all pair covariances come from a single aggregation without a row self-join.
    ties='strict' counts ties as 0 in the variance parts.
    """
    rank = ranked(scores, [*cell, model], p, y)
    half = 0.5 if ties == "half" else 0.0
    place = rank.select(
        *cell, model, "s",
        ((F.col("neg_below") + half * F.col("neg")) / F.col("n_neg")).alias("v_pos"),
        ((F.col("n_pos") - F.col("pos_below") - (1 - half) * F.col("pos")) / F.col("n_pos")).alias("v_neg"),
        ((F.col("neg_below") + 0.5 * F.col("neg")) / F.col("n_neg")).alias("u_pos"),
    )
    rows = scores.where(F.col(y).isNotNull()).select(*cell, model, unit, F.col(y).alias("y"), F.col(p).cast("double").alias("s"))
    v = rows.join(place, [*cell, model, "s"]).withColumn("v", F.when(F.col("y") == 1, F.col("v_pos")).otherwise(F.col("v_neg")))
    wide = v.groupBy(*cell, unit, "y").agg(
        *[F.max(F.when(F.col(model) == m, F.col("v"))).alias(f"v{i}") for i, m in enumerate(models)],
        *[F.max(F.when((F.col(model) == m) & (F.col("y") == 1), F.col("u_pos"))).alias(f"u{i}") for i, m in enumerate(models)],
    )
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    aggs = [F.avg(f"u{i}").alias(f"a{i}") for i in range(len(models))]
    for name, cls in (("p", 1), ("n", 0)):
        here = F.col("y") == cls
        aggs.append(F.count_if(here).alias(f"m_{name}"))
        for i in range(len(models)):
            aggs.append(F.var_samp(F.when(here, F.col(f"v{i}"))).alias(f"var_{name}{i}"))
        for i, j in pairs:
            aggs.append(
                F.covar_samp(F.when(here, F.col(f"v{i}")), F.when(here, F.col(f"v{j}"))).alias(f"cov_{name}{i}_{j}")
            )
    flat = wide.groupBy(*cell).agg(*aggs)

    def spread(i, j, name):
        var = F.col(f"var_{name}{i}") + F.col(f"var_{name}{j}") - 2 * F.col(f"cov_{name}{i}_{j}")
        return var / F.col(f"m_{name}")

    rows_out = F.array(*[
        F.struct(
            F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"),
            F.col(f"a{i}").alias("auroc_a"), F.col(f"a{j}").alias("auroc_b"),
            (spread(i, j, "p") + spread(i, j, "n")).alias("variance"),
        )
        for i, j in pairs
    ])
    out = flat.select(*cell, F.explode(rows_out).alias("r")).select(*cell, "r.*")
    z = F.when(F.col("variance") > 0, (F.col("auroc_a") - F.col("auroc_b")) / F.sqrt("variance")).otherwise(0.0)
    return out.withColumn("z", z)
