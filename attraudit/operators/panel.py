"""Correlation and regression on result panels and on large tables, from sufficient statistics."""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import f_upper, normal_two_sided, p_chi2, p_student, shapiro_wilk, t_two_sided
from ..session import short
from .gram import mean_shift, gram, sum_arrays
from .running import BUCKET, default_buckets, exact_quantiles, rank_rows, with_buckets


def attach(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics joined to their rows: by key, or one whole-table row as a scalar."""
    if by:
        return rows.join(stats, list(by))
    one = stats.select(F.struct("*").alias("s")).scalar()
    return rows.withColumn("__st", one).select(*rows.columns, "__st.*")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation with n pairs."""
    t = r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r))
    return F.when(n > 2, p_student(t, n - 2))


def pearson(rows: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Pearson correlation with its p value per key."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r")).where(F.col("n") >= min_n)
    return g.withColumn("p_value", correlation_p(F.col("r"), F.col("n")))


def spearman(
    rows: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, small: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Spearman rank correlation with its p value per key.

    `weight` counts a row several times, as a bootstrap draw does. `small` is for
    result panels, see `running_totals`.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = (F.col(weight) if weight else F.lit(1)).cast("bigint")
    if small:
        pairs = both.groupBy(*keys, x, y).agg(F.sum(w).alias("__w")).where(F.col("__w") > 0)
        one = F.lit(0)
        local = _local_ranks(_local_ranks(pairs.withColumns({"__bx": one, "__by": one}), keys, x, "__bx", "__rx"), keys, y, "__by", "__ry")
        g = local.groupBy(*keys).agg(*_rank_sums(F.col("__rx"), F.col("__ry"), F.col("__w")))
    else:
        cells = _rank_cells(both.withColumn("__w", w).where(F.col("__w") > 0), keys, x, y)
        for c in ("x", "y"):
            cells = _with_offset(cells, keys, c)
        g = cells.groupBy(*keys).agg(*_moved_sums(F.col("__ox"), F.col("__oy")))
    g = g.where(F.col("n") >= min_n)
    mean = (F.col("n") + 1) / 2.0
    cov = F.col("sab") - F.col("n") * mean * mean
    va, vb = F.col("saa") - F.col("n") * mean * mean, F.col("sbb") - F.col("n") * mean * mean
    out = g.select(*keys, "n", F.try_divide(cov, F.sqrt(va * vb)).alias("rho"))
    return out.withColumn("p_value", correlation_p(F.col("rho"), F.col("n")))


def _rank_sums(a: Column, b: Column, w: Column) -> list[Column]:
    sums = {"n": w, "sa": w * a, "sb": w * b, "sab": w * a * b, "saa": w * a * a, "sbb": w * b * b}
    return [F.sum(v).alias(k) for k, v in sums.items()]


def _moved_sums(ox: Column, oy: Column) -> list[Column]:
    """The same sums once every rank of a cell has moved by the cell's offsets."""
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    sums = {
        "n": n, "sab": F.col("sab") + ox * sb + oy * sa + n * ox * oy,
        "saa": F.col("saa") + 2 * ox * sa + n * ox * ox, "sbb": F.col("sbb") + 2 * oy * sb + n * oy * oy,
    }
    return [F.sum(v).alias(k) for k, v in sums.items()]


def _local_ranks(rows: DataFrame, keys: Sequence[str], value: str, bucket: str, out: str, *salts: str) -> DataFrame:
    """Midranks among the rows of a (key, bucket)."""
    by = [*keys, bucket, *salts]
    upto = F.sum("__w").over(W.partitionBy(*by).orderBy(value))
    tied = F.sum("__w").over(W.partitionBy(*by, value))
    return rows.withColumn(out, upto - tied + (tied + 1) / 2.0)


def _rank_cells(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Sums of ranks within buckets per (key, bucket of x, bucket of y): two exchanges, no join.

    A value that fills several buckets comes last in its own, so its rows need no
    order: they are salted, have rank 0 here, and get their rank as an offset.
    """
    both = rows.select(*keys, x, y, "__w")
    part = both
    for c, name, other in ((x, "x", y), (y, "y", x)):
        part = with_buckets(part, c, edges_from=both.select(c), hot=f"__h{name}").withColumnRenamed(BUCKET, f"__b{name}")
        spread = F.pmod(F.xxhash64(other) + F.spark_partition_id(), F.lit(default_buckets(rows)))
        part = part.withColumn(f"__s{name}", F.when(F.col(f"__h{name}"), spread).otherwise(0))
    for c, name in ((x, "x"), (y, "y")):
        part = _local_ranks(part, keys, c, f"__b{name}", f"__r{name}", f"__s{name}")
        part = part.withColumn(f"__r{name}", F.when(F.col(f"__h{name}"), 0.0).otherwise(F.col(f"__r{name}")))
    return part.groupBy(*keys, "__bx", "__hx", "__by", "__hy").agg(*_rank_sums(F.col("__rx"), F.col("__ry"), F.col("__w")))


def _with_offset(cells: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """What the ranks in a bucket lack: the rows of all smaller buckets; for a hot value, its whole rank."""
    b, h = f"__b{name}", f"__h{name}"
    at = W.partitionBy(*keys).orderBy(b, h)
    short = cells.groupBy(*keys, b, h).agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(at.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = F.when(F.col(h), before + (F.col("m") + 1) / 2.0).otherwise(before)
    renamed = short.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, b, h])], offset.alias(f"__o{name}"))
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, b, h])]
    return cells.join(renamed, match).drop(*[f"__k{i}" for i in range(len(keys) + 2)])


def rank_agreement(a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str) -> DataFrame:
    """Spearman correlation of per-key means in two tables."""
    x = a.groupBy(key).agg(F.avg(value_a).alias("va"))
    y = b.groupBy(key).agg(F.avg(value_b).alias("vb"))
    return spearman(x.join(y, key), [], "va", "vb", small=True)


def kendall_w(panel: DataFrame, subject: str, judge: str, value: str) -> DataFrame:
    """Kendall's coefficient of concordance of the judges' rankings; 1 is full agreement."""
    cells = panel.groupBy(subject, judge).agg(F.avg(value).alias("v"))
    ranked = rank_rows(cells, [judge], "v", "rk", descending=True)
    totals = ranked.groupBy(subject).agg(F.sum("rk").alias("total"), F.count(F.lit(1)).alias("m"))
    agg = totals.agg(
        F.count(F.lit(1)).alias("n_subjects"), F.max("m").alias("n_judges"), F.var_pop("total").alias("v")
    )
    n, m = F.col("n_subjects"), F.col("n_judges")
    s = F.col("v") * n
    return agg.select("n_subjects", "n_judges", (12 * s / (m * m * (n * n * n - n))).alias("kendall_w"))


def simple_ols(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, R2 and slope p value per key."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("r2")))
    return g.withColumn("p_value", F.when(F.col("n") > 2, p_student(t, F.col("n") - 2)))


# ---- term lists -----------------------------------------------------------

def num(column: str):
    """A numeric term."""
    return ("num", column)


def cat(column: str):
    """A treatment-coded categorical term; the smallest level is the reference."""
    return ("cat", column)


def inter(a: str, b: str):
    """The product of two numeric columns."""
    return ("inter", a, b)


def inter_cat(x: str, column: str):
    """The products of a numeric column with the dummies of a categorical one: a slope of its own per level."""
    return ("inter_cat", x, column)


MAX_LEVELS = 500


def design(rows: DataFrame, terms: Sequence[tuple]) -> tuple[DataFrame, dict[tuple, list[str]]]:
    """Add the design columns of a term list; returns them per term.

    The levels of a categorical term are read once; a term with more than
    MAX_LEVELS levels is refused, since the normal equations grow with its square.
    """
    out, names = rows, {}
    for term in dict.fromkeys(terms):
        if term[0] == "num":
            names[term] = [term[1]]
        elif term[0] == "inter":
            c = f"{term[1]}:{term[2]}"
            out = out.withColumn(c, F.col(term[1]) * F.col(term[2]))
            names[term] = [c]
        else:
            col = term[-1]
            found = rows.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
            levels = sorted(r[0] for r in found)
            if len(levels) > MAX_LEVELS:
                raise ValueError(f"{col} has more than {MAX_LEVELS} levels")
            names[term] = []
            for level in levels[1:]:
                c, dummy = f"{col}[{level}]", (F.col(col) == F.lit(level)).cast("double")
                if term[0] == "inter_cat":
                    c, dummy = f"{term[1]}:{c}", dummy * F.col(term[1])
                out = out.withColumn(c, dummy)
                names[term].append(c)
    return out, names


# ---- least squares from a Gram matrix -------------------------------------

FIT_FIELDS = [
    T.StructField("fit", T.StringType()), T.StructField("term", T.StringType()), T.StructField("beta", T.DoubleType()),
    T.StructField("se", T.DoubleType()), T.StructField("t", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()), T.StructField("f_stat", T.DoubleType()), T.StructField("f_p_value", T.DoubleType()),
    T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()), T.StructField("ssr", T.DoubleType()),
    T.StructField("bread", T.ArrayType(T.DoubleType())),
]


def _solve(g: np.ndarray, n: int, cols: list[int], y: int, shift: np.ndarray, centred: Mapping[int, tuple[int, int]] = {}) -> dict:
    """One fit; `centred` names the products of columns that were taken less their shifts, with their factors."""
    at = [0, *cols]
    a, b = g[np.ix_(at, at)], g[at, y]
    size = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))  # nearly equal columns are told apart at any scale
    inv = np.linalg.pinv(a / np.outer(size, size), rcond=1e-12, hermitian=True) / np.outer(size, size)
    beta = inv @ b
    k = len(at)
    tss = g[y, y] - g[0, y] ** 2 / g[0, 0]
    ssr = max(float(g[y, y] - b @ beta), 0.0)
    move = np.eye(k)
    move[0, 1:] = -shift[[c - 1 for c in cols]]
    for c in cols:
        if c in centred:  # (u - s)(v - t) = uv - t u - s v + st
            u, v = centred[c]
            s, t, j = shift[u - 1], shift[v - 1], at.index(c)
            move[at.index(u), j] -= t
            move[at.index(v), j] -= s
            move[0, j] += s * t
    beta_x = move @ beta
    beta_x[0] += shift[y - 1]
    bread = move @ inv @ move.T
    dof = n - k
    scale = ssr / dof if dof > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(bread), 0) * scale)
    r2 = 1 - ssr / tss if tss > 0 else math.nan
    f = (r2 / (k - 1)) / ((1 - r2) / dof) if k > 1 and dof > 0 and r2 < 1 else math.nan
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else math.nan
    return {
        "beta": beta_x, "se": se, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / dof if dof > 0 else math.nan,
        "f": f, "f_p": f_upper(f, k - 1, dof) if not math.isnan(f) else math.nan, "aic": -2 * ll + 2 * k,
        "bic": -2 * ll + math.log(n) * k, "ssr": ssr, "bread": bread, "k": k, "dof": dof,
    }


def fit_grams(
    grams: DataFrame, columns: Sequence[str], fits: Mapping[str, Sequence[str]], y: str, by: Sequence[str] = (),
    shift: Sequence[float] | None = None, centred: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Ordinary least squares for every key and every named column set (R2).

    All fits of a key are sub-blocks of its one Gram matrix. One row per
    (key, fit, term); `bread` is the flat (X'X)^-1 of the fit. `centred` names the
    products whose factors were shifted before they were multiplied; coefficients
    are those of the plain products.
    """
    columns, by = list(columns), list(by)
    where = {c: i + 1 for i, c in enumerate(columns)}
    moved = np.zeros(len(columns)) if shift is None else np.asarray(shift, float)
    p = len(columns) + 1
    plan = {name: [where[c] for c in cols] for name, cols in fits.items()}
    yi = where[y]
    labels = {i: c for c, i in where.items()}
    products = {where[c]: (where[a], where[b]) for c, (a, b) in (centred or {}).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = [getattr(row, f"k{i}") for i in range(len(by))]
                g = np.asarray(row.g, float).reshape(p, p)
                for name, cols in plan.items():
                    s = _solve(g, int(row.n), cols, yi, moved, products)
                    for j, term in enumerate(["(Intercept)", *[labels[c] for c in cols]]):
                        t = s["beta"][j] / s["se"][j] if s["se"][j] > 0 else math.nan
                        pv = t_two_sided(t, s["dof"]) if not math.isnan(t) else math.nan
                        out.append([*key, name, term, s["beta"][j], s["se"][j], t, pv, int(row.n), s["k"], s["r2"],
                                    s["adj_r2"], s["f"], s["f_p"], s["aic"], s["bic"], s["ssr"], s["bread"].ravel()])
            if out:
                yield pd.DataFrame(out, columns=[*by, *[f.name for f in FIT_FIELDS]])

    picked = grams.select(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], "n", "g")
    schema = T.StructType([f for f in grams.select(*by).schema.fields] + FIT_FIELDS)
    return picked.mapInPandas(run, schema)


def ols(rows: DataFrame, y: str, fits: Mapping[str, Sequence[tuple]], by: Sequence[str] = ()) -> DataFrame:
    """Several term-list regressions of one response from a single scan (R2)."""
    terms = [t for ts in fits.values() for t in ts]
    wide, names = design(rows, terms)
    columns = list(dict.fromkeys(c for t in terms for c in names[t])) + [y]
    shift = mean_shift(wide, columns)
    cols = {name: [c for t in ts for c in names[t]] for name, ts in fits.items()}
    centred = _centred(fits, names)
    if centred:  # products of columns that hardly vary would all but repeat the columns themselves
        mean = dict(zip(columns, shift))
        wide = wide.withColumns({c: (F.col(a) - F.lit(mean[a])) * (F.col(b) - F.lit(mean[b])) for c, (a, b) in centred.items()})
        shift = [0.0 if c in centred else v for c, v in zip(columns, shift)]
    g = gram(wide, columns, by, shift=shift)
    return fit_grams(g, columns, cols, y, by, shift, centred)


def _centred(fits: Mapping[str, Sequence[tuple]], names: Mapping[tuple, list[str]]) -> dict[str, tuple[str, str]]:
    """Products whose factors are terms of every fit that holds them: taken about the means, they span the same space."""
    out = {}
    for t in dict.fromkeys(t for ts in fits.values() for t in ts if t[0] == "inter"):
        if t[1] != t[2] and all(num(t[1]) in ts and num(t[2]) in ts for ts in fits.values() if t in ts):
            out[names[t][0]] = (t[1], t[2])
    return out


def fit_table(fitted: DataFrame, by: Sequence[str] = (), base: str | None = None) -> DataFrame:
    """One row per fit: R2, adjusted R2, F test, AIC, BIC, and the R2 gain over `base`."""
    cols = ["n", "k", "r2", "adj_r2", "f_stat", "f_p_value", "aic", "bic"]
    out = fitted.where(F.col("term") == "(Intercept)").select(*by, "fit", *cols)
    if base is None:
        return out
    ref = F.max(F.when(F.col("fit") == base, F.col("r2"))).over(W.partitionBy(*by))
    return out.withColumn("delta_r2", F.col("r2") - ref)


def predictions(rows: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with fitted value and residual, and the fit they come from.

    The fit is one short row per key: coefficients b0.., the flat (X'X)^-1, and
    the residual sum of squares.
    """
    columns = [*x, y]
    shift = mean_shift(rows, columns)
    fitted = fit_grams(gram(rows, columns, by, shift=shift), columns, {"m": list(x)}, y, by, shift)
    terms = ["(Intercept)", *x]
    per = fitted.groupBy(*by).agg(
        *[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"b{i}") for i, t in enumerate(terms)],
        F.first("bread").alias("bread"), F.first("ssr").alias("ssr"), F.first("n").alias("n_fit"),
    )
    if by:
        per = short(per)
    full = attach(rows.dropna(subset=columns), per, by)
    hat = F.col("b0")
    for i, c in enumerate(x):
        hat = hat + F.col(f"b{i + 1}") * F.col(c)
    out = full.withColumn("fitted", hat).withColumn("residual", F.col(y) - F.col("fitted"))
    return out, per


def residual_summary(rows: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, skewness, excess kurtosis and Jarque-Bera of the residuals."""
    e = predictions(rows, y, x, by)[0]
    g = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("sd"),
        F.skewness("residual").alias("skew"), F.kurtosis("residual").alias("kurt"),
    )
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    return g.withColumn("jarque_bera", jb).withColumn("jb_p_value", p_chi2(F.col("jarque_bera"), F.lit(2.0)))


def residual_normality(rows: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk test of the residuals, all of them; made for result panels: a key's residuals are sorted in one task."""
    by = list(by)
    e = predictions(rows, y, x, by)[0].select(*by, "residual")
    schema = T.StructType([f for f in e.select(*by).schema.fields] + [
        T.StructField("n", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("p_value", T.DoubleType())
    ])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = (None if math.isnan(v) else v for v in shapiro_wilk(pdf["residual"].to_numpy()))
        return pd.DataFrame([[*key, len(pdf), w, p]], columns=schema.names)

    return e.groupBy(*by).applyInPandas(run, schema)


def breusch_pagan(rows: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Lagrange-multiplier test of constant variance."""
    e = predictions(rows, y, x, by)[0].select(*by, *x, (F.col("residual") * F.col("residual")).alias("__e2"))
    columns = [*x, "__e2"]
    fitted = fit_grams(gram(e, columns, by), columns, {"bp": list(x)}, "__e2", by)
    out = fitted.where(F.col("term") == "(Intercept)").select(*by, "n", (F.col("n") * F.col("r2")).alias("lm"))
    return out.withColumn("p_value", p_chi2(F.col("lm"), F.lit(float(len(x)))))


def influence(rows: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Leverage and Cook's distance of every row."""
    e, _ = predictions(rows, y, x, by)
    k = len(x) + 1
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + F.col("bread")[i * k + j] * cols[i] * cols[j]
    s2 = F.col("ssr") / (F.col("n_fit") - k)
    e = e.withColumn("leverage", h)
    cook = F.col("residual") * F.col("residual") / (k * s2) * F.col("leverage") / (
        (1 - F.col("leverage")) * (1 - F.col("leverage"))
    )
    return e.withColumn("cooks_d", cook).drop("bread", "ssr", *[f"b{i}" for i in range(k)])


def influence_counts(infl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the usual Cook's distance limits."""
    return infl.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("cooks_d").alias("max_cooks_d"),
        F.count_if(F.col("cooks_d") > F.lit(4.0) / F.col("n_fit")).alias("n_above_4_over_n"),
        F.count_if(F.col("cooks_d") > 1).alias("n_above_1"),
    )


def cluster_robust(rows: DataFrame, y: str, x: Sequence[str], cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way cluster-robust standard errors with normal p values.

    Scores are summed per cluster, so a hot cluster is combined map-side; the
    sandwich is formed on one short row per key.
    """
    by = list(by)
    e, per = predictions(rows, y, x, by)
    k = len(x) + 1
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    s = e.groupBy(*by, cluster).agg(*[F.sum(c * F.col("residual")).alias(f"s{i}") for i, c in enumerate(cols)])
    meat = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).alias("meat"),
    )
    joined = attach(meat, per, by)
    terms = ["(Intercept)", *x]
    schema = T.StructType(
        [f for f in joined.select(*by).schema.fields]
        + [T.StructField("term", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("beta", "se_ols", "p_ols", "se_cluster", "z", "p_cluster")]
        + [T.StructField("n", T.LongType()), T.StructField("n_clusters", T.LongType())]
    )
    picked = joined.select(
        *[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], F.array(*[f"b{i}" for i in range(k)]).alias("b"),
        "bread", "meat", "ssr", "n_fit", "n_clusters",
    )

    def sandwich(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = [getattr(r, f"k{i}") for i in range(len(by))]
                bread, m = np.asarray(r.bread).reshape(k, k), np.asarray(r.meat).reshape(k, k)
                n, g = int(r.n_fit), int(r.n_clusters)
                factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 else math.nan
                v = factor * bread @ m @ bread
                for j, term in enumerate(terms):
                    se0 = math.sqrt(max(bread[j, j], 0) * r.ssr / (n - k))
                    se1 = math.sqrt(v[j, j]) if v[j, j] > 0 else math.nan
                    z = r.b[j] / se1 if se1 and se1 > 0 else math.nan
                    out.append([*key, term, r.b[j], se0, t_two_sided(r.b[j] / se0, n - k), se1, z,
                                normal_two_sided(z) if not math.isnan(z) else math.nan, n, g])
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return picked.mapInPandas(sandwich, schema)


def slope_difference(rows: DataFrame, y: str, x: str, flag: str, cluster: str) -> DataFrame:
    """Equality of slopes in two subsets by a pooled interaction."""
    w = rows.withColumn("__f", F.col(flag).cast("double")).withColumn("__fx", F.col("__f") * F.col(x))
    c = cluster_robust(w, y, [x, "__f", "__fx"], cluster)
    return c.where(F.col("term") == "__fx").withColumn("term", F.lit(f"{x}:{flag}"))


def leave_one_group_out(rows: DataFrame, y: str, x: Sequence[str], group: str) -> DataFrame:
    """R2 of the fit with each group left out (R18): the total Gram less the group's Gram."""
    columns = [*x, y]
    shift = mean_shift(rows, columns)
    per = gram(rows, columns, [group], shift=shift)
    total = sum_arrays(per.select("n", "g"), []).select(F.struct(F.col("n").alias("tn"), F.col("g").alias("tg")).alias("t")).scalar()
    rest = per.withColumn("t", total).select(
        group, (F.col("t.tn") - F.col("n")).alias("n"), F.zip_with("t.tg", "g", lambda a, b: a - b).alias("g")
    )
    fitted = fit_grams(rest, columns, {"loo": list(x)}, y, [group], shift)
    return fitted.where(F.col("term") == "(Intercept)").select(group, "n", "r2")


def random_intercept(rows: DataFrame, y: str, x: Sequence[str], group: str, rounds: int = 6, points: int = 25) -> dict:
    """Random-intercept model by restricted likelihood: variance parts and ICC.

    Groups shrink to their sums once. Each search round scores a grid of
    variance ratios in one aggregation over the groups.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    q = len(cols)
    ij = [(i, j) for i in range(q) for j in range(i, q)]
    per = rows.dropna(subset=[*x, y, group]).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.sum(cols[i] * cols[j]).alias(f"q{i}_{j}") for i, j in ij],
    ).persist()
    try:
        n = per.agg(F.sum("n")).first()[0]
        lo, hi, best = -8.0, 4.0, None
        for _ in range(rounds):
            grid = np.linspace(lo, hi, points)
            t = F.explode(F.array(*[F.lit(float(10.0**v)) for v in grid])).alias("theta")
            g = per.select("*", t)
            shrink = F.col("theta") / (1 + F.col("n") * F.col("theta"))
            sums = g.groupBy("theta").agg(
                F.sum(F.log1p(F.col("n") * F.col("theta"))).alias("ld"),
                *[F.sum(F.col(f"q{i}_{j}") - shrink * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"a{i}_{j}") for i, j in ij],
            ).collect()
            scored = []
            for r in sums:
                a = np.zeros((q, q))
                for i, j in ij:
                    a[i, j] = a[j, i] = r[f"a{i}_{j}"]
                p = q - 1
                beta = np.linalg.solve(a[:p, :p], a[:p, p])
                rss = a[p, p] - a[:p, p] @ beta
                s2 = rss / (n - p)
                crit = r["ld"] + np.linalg.slogdet(a[:p, :p])[1] + (n - p) * math.log(s2)
                scored.append((crit, math.log10(r["theta"]), s2, beta))
            best = min(scored, key=lambda v: v[0])
            step = grid[1] - grid[0]
            lo, hi = best[1] - step, best[1] + step
    finally:
        per.unpersist()
    theta = 10.0 ** best[1]
    su2, se2 = float(theta * best[2]), float(best[2])
    return {"group_variance": su2, "residual_variance": se2, "icc": su2 / (su2 + se2), "beta": [float(b) for b in best[3]], "n": int(n)}


HUBER_T = 1.345
MAD_TO_SD = 0.6744897501960817


def huber(rows: DataFrame, y: str, x: Sequence[str], max_iter: int = 500, tol: float = 1e-8) -> dict:
    """Huber M-estimate with a MAD scale by reweighted least squares.

    Each round is one exact median of |residual| and one weighted Gram pass.
    """
    columns = [*x, y]
    base = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().persist()
    try:
        shift = mean_shift(base, columns)
        k = len(x) + 1

        def solve(df, weight=None):
            row = gram(df, columns, (), weight, shift).first()
            return _solve(np.asarray(row["g"]).reshape(k + 1, k + 1), int(row["n"]), list(range(1, k)), k, np.asarray(shift))

        def residual(beta):
            e = F.col(y) - F.lit(float(beta[0]))
            for b, c in zip(beta[1:], x):
                e = e - F.lit(float(b)) * F.col(c)
            return e

        fit = solve(base)
        beta, scale, rounds = fit["beta"], None, 0
        for rounds in range(1, max_iter + 1):
            e = base.withColumn("__e", residual(beta)).withColumn("__ae", F.abs("__e"))
            scale = exact_quantiles(e, [], "__ae", {"m": 0.5}).first()[0] / MAD_TO_SD
            u = F.col("__ae") / F.lit(max(scale, 1e-300))
            new = solve(e.withColumn("__w", F.when(u <= HUBER_T, 1.0).otherwise(HUBER_T / u)), "__w")["beta"]
            moved = float(np.max(np.abs(new - beta)))
            beta = new
            if moved < tol * max(1.0, float(np.max(np.abs(beta)))):
                break
        else:
            raise RuntimeError(f"no convergence in {max_iter} rounds, the last of which moved a coefficient by {moved}")
        u = residual(beta) / F.lit(max(scale, 1e-300))
        inside = (F.abs(u) <= HUBER_T).cast("double")
        psi = F.greatest(F.least(u, F.lit(HUBER_T)), F.lit(-HUBER_T))
        st = base.agg(F.count(F.lit(1)).alias("n"), F.sum(psi * psi).alias("pp"), F.avg(inside).alias("m"), F.var_pop(inside).alias("v")).first()
        factor = 1 + k / st["n"] * st["v"] / st["m"] ** 2
        cov = factor**2 * (st["pp"] * scale**2 / (st["n"] - k)) / st["m"] ** 2 * fit["bread"]
        return {
            "beta": [float(b) for b in beta], "se": [float(v) for v in np.sqrt(np.diag(cov))], "scale": float(scale),
            "rounds": rounds, "ols_beta": [float(b) for b in fit["beta"]],
        }
    finally:
        base.unpersist()


def one_sample_t(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """t test of a zero mean."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return g.withColumn("t", t).withColumn("p_value", p_student(F.col("t"), F.col("n") - 1))


# Normal quantiles for a two-sided 5 % test and 80 % power.
Z_TEST, Z_POWER = 1.959963984540054, 0.8416212335729143


def minimum_detectable(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest mean change a paired design of this size finds with 80 % power."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), (F.lit(Z_TEST + Z_POWER) * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("mde")
    )


def encoding_dependence(cells: DataFrame, metric: str, encoding: str, dependence: str) -> DataFrame:
    """Rank and linear correlation of encoding and dependence over all, binary and continuous."""
    subset = F.array(F.lit("all"), F.when(F.col(metric) == "auroc", "binary").otherwise("continuous"))
    long = cells.select("*", F.explode(subset).alias("subset"))
    s = spearman(long, ["subset"], encoding, dependence, small=True)
    p = pearson(long, ["subset"], encoding, dependence)
    return s.select("subset", "n", F.col("rho").alias("spearman_rho"), F.col("p_value").alias("spearman_p")).join(
        p.select("subset", F.col("r").alias("pearson_r"), F.col("p_value").alias("pearson_p")), "subset"
    )
