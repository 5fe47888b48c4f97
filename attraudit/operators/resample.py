"""Bootstrap and permutation inference with hash-based draws.

Weights are Poisson(1) per row, which is the large-sample form of n-of-n
resampling and needs no row numbers. A draw depends on the seed, the replicate
and the row only, never on the partitioning. Without a unit column the rows of
a cell first shrink to counts of equal (score, label) pairs and each count draws
one Poisson(count), so the work follows the number of distinct scores.

The weights of a row are one vector over all replicates (`draws`); permutations
deal counts (`permute`). Rows are copied per replicate only for metrics that a
user registers as DataFrame functions.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import poisson_many, poisson_one, uniform
from ..functions.weights import row_hash
from ..session import short
from .draws import auprc_draws, auroc_draws, weighted_sums
from .picks import picked_means, rank_draws
from .fairness import gap
from .panel import spearman
from .permute import shuffled_groups, shuffled_labels
from .ranking import _precision_area, auroc, ranked

MIN_VALID = 10


def _spread(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Even out rows before they are replicated: B times the work follows this shuffle."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, *identity)


def with_replicates(rows: DataFrame, b: int, identity: Sequence[str] = ()) -> DataFrame:
    spread = _spread(rows, identity) if identity else rows
    return spread.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))


def draw(rows: DataFrame, b: int, seed: int, identity: Sequence[str], count: str | None = None) -> DataFrame:
    """Rows of every replicate with a positive weight `w`.

    All weights of a row are drawn in one array, so each hash is computed once
    and rows that a replicate leaves out are never emitted.
    """
    key = [F.col(c) for c in identity]

    def one(rep: Column) -> Column:
        w = poisson_one(uniform(seed, rep, *key)) if count is None else poisson_many(F.col(count), seed, rep, *key)
        return F.struct(rep.alias("rep"), w.alias("w"))

    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), one), lambda x: x["w"] > 0)
    return _spread(rows, identity).select("*", F.inline(drawn))


# ---- metrics over weighted rows: (rows, keys, weight, base) -> (keys, value);
# `base` holds the rows before replication ----

def _auroc(rows, keys, weight, base=None):
    return auroc(rows, keys, weight=weight, edges_from=base).select(*keys, F.col("auroc").alias("value"))


def _auprc(rows, keys, weight, base=None):
    r = ranked(rows, keys, weight=weight, edges_from=base)
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    return r.groupBy(*keys).agg(F.when(both, _precision_area()).alias("value"))


def _weighted(expr: Callable[[Column], Column]):
    def metric(rows, keys, weight, base=None):
        return rows.groupBy(*keys).agg(expr(F.col(weight)).alias("value"))
    return metric


_E = F.col  # short name inside the expressions below

METRICS: dict[str, Callable[..., DataFrame]] = {
    "auroc": _auroc,
    "auprc": _auprc,
    "mae": _weighted(lambda w: F.sum(w * F.abs(_E("y") - _E("p"))) / F.sum(w)),
    "brier": _weighted(lambda w: F.sum(w * (_E("y") - _E("p")) * (_E("y") - _E("p"))) / F.sum(w)),
    "mean": _weighted(lambda w: F.sum(w * _E("y")) / F.sum(w)),
    "r2": _weighted(lambda w: 1 - F.try_divide(
        F.sum(w * (_E("y") - _E("p")) * (_E("y") - _E("p"))),
        F.sum(w * _E("y") * _E("y")) - F.sum(w * _E("y")) * F.sum(w * _E("y")) / F.sum(w))),
}


def _mean_of(feature: Callable[[], Column]):
    """Replicates of a weighted mean."""
    def values(rows, cell, b):
        sums = weighted_sums(rows, cell, {"w": F.lit(1.0), "x": feature()}, b)
        return sums.select(*cell, "rep", F.try_divide("x", "w").alias("value"))
    return values


def _r2_draws(rows, cell, b):
    known = rows.where(F.col("p").isNotNull())
    middle = known.groupBy(*cell).agg(F.avg("y").alias("__c"))  # sums of squares are taken about the mean
    known = _attach(known, short(middle) if cell else middle, cell)
    y, e = F.col("y") - F.col("__c"), F.col("y") - F.col("p")
    s = weighted_sums(known, cell, {"w": F.lit(1.0), "y": y, "yy": y * y, "ee": e * e}, b)
    return s.select(*cell, "rep", (1 - F.try_divide("ee", F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("w")))).alias("value"))


#: metrics whose replicates are computed as vectors: (rows with h and m, cell, b) -> (cell, rep, value)
VECTORS: dict[str, Callable[..., DataFrame]] = {
    "auroc": auroc_draws,
    "auprc": auprc_draws,
    "mae": _mean_of(lambda: F.abs(_E("y") - _E("p"))),
    "brier": _mean_of(lambda: (_E("y") - _E("p")) * (_E("y") - _E("p"))),
    "mean": _mean_of(lambda: _E("y")),
    "r2": _r2_draws,
}


def hashed(rows: DataFrame, seed: int, identity: Sequence[str], count: str | None = None) -> DataFrame:
    """Rows with the hash of their draws and how many equal rows they stand for."""
    return rows.withColumn("h", row_hash(seed, *identity)).withColumn("m", F.col(count) if count else F.lit(1))


def register_metric(name: str, fn: Callable[..., DataFrame]) -> None:
    """Plug in a metric of weighted rows, as a DataFrame function (F1)."""
    METRICS[name] = fn
    VECTORS.pop(name, None)


def interval(reps: DataFrame, cell: Sequence[str], value: str = "value", ci: float = 0.95, min_valid: int = MIN_VALID) -> DataFrame:
    """Percentile interval over replicates; null below `min_valid` valid draws."""
    a = (1 - ci) / 2
    q = F.percentile(F.col(value), F.array(F.lit(a), F.lit(1 - a)))
    ok = F.count(value) >= min_valid
    return reps.groupBy(*cell).agg(
        F.count(value).alias("n_draws"), F.when(ok, q[0]).alias("ci_low"), F.when(ok, q[1]).alias("ci_high")
    )


def _attach(point: DataFrame, ci: DataFrame, cell: Sequence[str]) -> DataFrame:
    if cell:
        return point.join(ci, list(cell), "left")
    one = ci.select(F.struct("*").alias("s")).scalar()
    return point.withColumn("__ci", one).select(*point.columns, "__ci.*")


def bootstrap_ci(
    rows: DataFrame, cell: Sequence[str], metric: str = "auroc", b: int = 1000, ci: float = 0.95, seed: int = 42,
    unit: str | None = None,
) -> DataFrame:
    """Point value and percentile interval of a metric per cell."""
    fn, cell = METRICS[metric], list(cell)
    base = rows.where(F.col("y").isNotNull())
    value_cols = [c for c in ("y", "p") if c in base.columns]
    if unit is None:
        slim = base.groupBy(*cell, *value_cols).agg(F.count(F.lit(1)).alias("m"))
        one, identity, count = slim.withColumn("w", F.col("m")), [*cell, *value_cols], "m"
    else:
        slim = base.select(*cell, *value_cols, unit)
        one, identity, count = slim.withColumn("w", F.lit(1)), [unit], None
    point = fn(one, cell, "w", base).withColumnRenamed("value", "point")
    if metric in VECTORS:
        reps = VECTORS[metric](hashed(slim, seed, identity, count), cell, b)
    else:
        reps = fn(draw(slim, b, seed, identity, count), [*cell, "rep"], "w", base)
    return _attach(point, interval(reps, cell, ci=ci), cell)


def bootstrap_delta(
    rows: DataFrame, cell: Sequence[str], a: str, b_score: str, metric: str = "auroc", b: int = 1000, ci: float = 0.95,
    seed: int = 42, unit: str | None = None, plus_one: bool = False,
) -> DataFrame:
    """Paired difference metric(b) - metric(a), interval and two-sided p value."""
    fn, cell = METRICS[metric], list(cell)
    base = rows.where(F.col("y").isNotNull())
    if unit is None:
        slim = base.groupBy(*cell, "y", a, b_score).agg(F.count(F.lit(1)).alias("m"))
        identity, count = [*cell, "y", a, b_score], "m"
    else:
        slim = base.select(*cell, "y", a, b_score, unit).withColumn("m", F.lit(1))
        identity, count = [unit], None

    def sided(df, *more):
        sides = F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("p")), F.struct(F.lit("b").alias("side"), F.col(b_score).alias("p")))
        return df.select(*cell, "y", *more, F.explode(sides).alias("s")).select(*cell, "y", *more, "s.*")

    def difference(m, keys):
        return m.groupBy(*keys).agg(
            (F.max(F.when(F.col("side") == "b", F.col("value"))) - F.max(F.when(F.col("side") == "a", F.col("value")))).alias("value")
        )

    edges = base.select("y", F.explode(F.array(a, b_score)).alias("p"))
    point = difference(fn(sided(slim.withColumn("w", F.col("m")), "w"), [*cell, "side"], "w", edges), cell).withColumnRenamed("value", "delta")
    if metric in VECTORS:  # both sides of a row share its weights
        per = VECTORS[metric](sided(hashed(slim, seed, identity, count), "h", "m"), [*cell, "side"], b)
    else:
        per = fn(sided(draw(slim, b, seed, identity, count), "rep", "w"), [*cell, "rep", "side"], "w", edges)
    both = difference(per, [*cell, "rep"])
    reps = _attach(both, point, cell) if cell else both.withColumn("delta", point.select("delta").scalar())
    beyond = F.when(F.col("delta") >= 0, F.col("value") < 0).otherwise(F.col("value") > 0)
    extra = 1 if plus_one else 0
    share = (F.count_if(beyond) + extra) / (F.count("value") + extra)
    p = reps.groupBy(*cell).agg(F.least(2 * share, F.lit(1.0)).alias("p_value"), F.count("value").alias("__n"))
    ci_tab = interval(reps, cell, ci=ci)
    out = _attach(_attach(point, ci_tab, cell), p, cell)
    return out.withColumn("p_value", F.when(F.col("__n") >= MIN_VALID, F.col("p_value"))).drop("__n")


def bootstrap_gap(
    rows: DataFrame, cell: Sequence[str], group: str = "grp", b: int = 1000, ci: float = 0.95, seed: int = 42,
    unit: str | None = None, min_n: int = 10, min_side: int = 1, drop_draw: bool = True, min_valid: int = MIN_VALID,
) -> DataFrame:
    """Interval of the max-min AUROC gap between groups.

    drop_draw=True drops a draw with any invalid group (I4). drop_draw=False
    leaves out only the invalid group, as for draws within groups (I5).
    """
    cell = list(cell)
    keys = [*cell, group]
    base = rows.where(F.col("y").isNotNull() & F.col(group).isNotNull())
    if unit is None:
        slim = base.groupBy(*keys, "y", "p").agg(F.count(F.lit(1)).alias("m"))
        drawn = hashed(slim, seed, [*keys, "y", "p"], "m")
    else:
        drawn = hashed(base.select(*keys, "y", "p", unit), seed, [unit])
    ok = (F.col("n") >= min_n) & (F.least(F.col("n_pos"), F.col("n") - F.col("n_pos")) >= min_side)
    once = auroc(base, keys)
    observed = gap(once, cell, group)
    if drop_draw:  # what holds for a draw holds for the data
        valid = once.groupBy(*cell).agg(F.coalesce(F.min(ok & F.col("auroc").isNotNull()), F.lit(False)).alias("__ok"))
        observed = _attach(observed, valid, cell).withColumn("gap", F.when(F.col("__ok"), F.col("gap"))).drop("__ok")
    n_groups = base.groupBy(*cell).agg(F.count_distinct(group).alias("__g"))
    good = auroc_draws(drawn, keys, b).withColumn("v", F.when(ok, F.col("value")))
    reps = good.groupBy(*cell, "rep").agg(
        F.count("v").alias("k"), (F.max("v") - F.min("v")).alias("value")
    )
    reps = _attach(reps, n_groups, cell)
    need = F.col("k") == F.col("__g") if drop_draw else F.col("k") >= 2
    reps = reps.withColumn("value", F.when(need & (F.col("k") >= 2), F.col("value")))
    return _attach(observed.select(*cell, "n_groups", "gap"), interval(reps, cell, ci=ci, min_valid=min_valid), cell)


def bootstrap_mean_exact(panel: DataFrame, keys: Sequence[str], unit: str, value: str, b: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean with an n-of-n bootstrap interval for small result panels.

    Draw i of a replicate picks row floor(u * n) of its group.
    """
    from pyspark.sql import Window as W

    keys = list(keys)
    rows = panel.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("v"), F.row_number().over(W.partitionBy(*keys).orderBy(unit)).alias("i")
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("point"))
    return sizes.select(*keys, "n", "point").join(interval(picked_means(rows, keys, b, seed), keys, ci=ci), keys)


def bootstrap_spearman(rows: DataFrame, cell: Sequence[str], x: str, y: str, unit: str, b: int = 10000, ci: float = 0.95, seed: int = 42, small: bool = False) -> DataFrame:
    """Spearman correlation with a bootstrap interval (I7); `small` takes the ranks of a cell in one task, all replicates at once."""
    cell = list(cell)
    point = spearman(rows, cell, x, y, small=small).select(*cell, F.col("rho").alias("point"))
    if small:
        reps = rank_draws(rows, cell, x, y, unit, b, seed)
    else:
        reps = spearman(draw(rows.select(*cell, x, y, unit), b, seed, [unit]), [*cell, "rep"], x, y, weight="w")
    return _attach(point, interval(reps, cell, "rho", ci), cell)


def bootstrap_slope(rows: DataFrame, cell: Sequence[str], x: str, y: str, unit: str, b: int = 2000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Regression slope with a bootstrap interval from weighted sums (I8)."""
    cell = list(cell)
    base = rows.select(*cell, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), unit).dropna(subset=["x", "y"])

    middle = base.groupBy(*cell).agg(F.avg("x").alias("__x"), F.avg("y").alias("__y"))  # products are taken about the means
    about = _attach(base, short(middle) if cell else middle, cell).withColumns({"x": F.col("x") - F.col("__x"), "y": F.col("y") - F.col("__y")}).drop("__x", "__y")

    def slope():
        sw, sx, sy = F.col("w"), F.col("sx"), F.col("sy")
        return F.try_divide(F.col("sxy") - F.try_divide(sx * sy, sw), F.col("sxx") - F.try_divide(sx * sx, sw))

    x_, y_ = F.col("x"), F.col("y")
    features = {"w": F.lit(1.0), "sx": x_, "sy": y_, "sxy": x_ * y_, "sxx": x_ * x_}
    point = about.groupBy(*cell).agg(*[F.sum(c).alias(n) for n, c in features.items()]).select(*cell, slope().alias("point"))
    reps = weighted_sums(hashed(about, seed, [unit]), cell, features, b).select(*cell, "rep", slope().alias("value"))
    return _attach(point, interval(reps, cell, ci=ci), cell)


def permutation_auroc(rows: DataFrame, cell: Sequence[str], unit: str | None = None, b: int = 1000, seed: int = 42, plus_one: bool = False) -> DataFrame:
    """Permutation test of an AUROC against shuffled labels.

    Ranks never change under a label shuffle; every replicate deals the positives
    to the distinct scores.
    """
    cell = list(cell)
    base = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull()).select(*cell, "y", F.col("p").cast("double").alias("p"))
    observed = auroc(base, cell).where(F.col("auroc").isNotNull())
    null = _attach(shuffled_labels(base, cell, b, seed), observed, cell).where(F.col("auroc").isNotNull())
    p_, n_ = F.col("n_pos"), F.col("n") - F.col("n_pos")
    null = null.select(*cell, "auroc", ((F.col("ranks") - p_ * (p_ + 1) / 2.0) / (p_ * n_)).alias("v"))
    extra = 1 if plus_one else 0
    share = (F.count_if(F.col("v") >= F.col("auroc")) + extra) / (F.count("v") + extra)
    return null.groupBy(*cell).agg(
        F.max("auroc").alias("auroc"), share.alias("p_value"), F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_std")
    )


def permutation_gap(rows: DataFrame, cell: Sequence[str], unit: str | None = None, group: str = "grp", b: int = 1000, seed: int = 42, min_n: int = 20, plus_one: bool = False) -> DataFrame:
    """Permutation test of the max-min AUROC gap under shuffled group labels.

    Every replicate deals the distinct (score, label) counts out to the groups in
    their original sizes. A draw with an invalid group is dropped.
    """
    cell = list(cell)
    known = F.col("y").isNotNull() & F.col(group).isNotNull() & F.col("p").isNotNull()
    base = rows.where(known).select(*cell, group, "y", F.col("p").cast("double").alias("p"))
    by_group = auroc(base, [*cell, group]).withColumn("ok", (F.col("n") >= min_n) & F.col("auroc").isNotNull())
    observed = by_group.groupBy(*cell).agg(
        (F.max("auroc") - F.min("auroc")).alias("gap"), F.min("ok").alias("ok"), F.count(F.lit(1)).alias("n_groups"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col("n")))), lambda x: x["n"]).alias("sizes"),
    ).where(F.col("ok"))
    null = _attach(shuffled_groups(base.drop(group), observed.select(*cell, "sizes"), cell, b, seed, min_n), observed.select(*cell, "gap", "n_groups"), cell)
    extra = 1 if plus_one else 0
    share = (F.count_if(F.col("v") >= F.col("gap")) + extra) / (F.count("v") + extra)
    return null.groupBy(*cell).agg(
        F.max("gap").alias("gap"), F.max("n_groups").alias("n_groups"),
        F.when(F.count("v") >= MIN_VALID, share).alias("p_value"), F.count("v").alias("n_draws"),
    )
