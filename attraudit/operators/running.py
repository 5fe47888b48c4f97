"""Running totals over an ordering without putting a whole group in one task.

A plain window partitioned by the cell sends one hot cell to one task. Here the
ordering axis is cut into buckets first: totals per bucket form a short list per
key, the fine ordering happens inside (key, bucket), and the two are joined on
(key, bucket). Bucket edges are quantiles over all rows, so every
(key, bucket) group holds about 1/n_buckets of the input at most, whatever the
key skew is. The result does not depend on where the edges fall.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = "__bucket"


def default_buckets(df: DataFrame) -> int:
    """As many as there are shuffle partitions, so that a bucket stays one task's work at any size."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def work_parts(df: DataFrame) -> int:
    """Tasks for work that far outweighs its rows, as draws do: several for every core, whatever the size of the rows.

    A repartition by this number is left as it is by AQE, which would join small partitions of much work.
    """
    return max(default_buckets(df), 4 * df.sparkSession.sparkContext.defaultParallelism)


def with_buckets(
    df: DataFrame, order: str, n_buckets: int | None = None, edges_from: DataFrame | None = None, hot: str | None = None
) -> DataFrame:
    """Add a bucket number that never decreases along `order`.

    `hot` names a column that tells the values that fill more than one bucket; in their bucket they come last.

    The edges come from `edges_from` if given: the rows `df` was derived from,
    whose quantiles need no shuffle and no replicates.
    """
    n = n_buckets or default_buckets(df)
    fan = max(2, int(n**0.5))
    fine = [i / n for i in range(1, n)]
    value = F.col(order).cast("double")
    # a one-row aggregate: n - 1 doubles, read as a constant by every task
    cuts = (edges_from if edges_from is not None else df).agg(
        F.coalesce(
            F.percentile_approx(value, fine, max(10000, 4 * n)), F.array().cast("array<double>")
        ).alias("all")
    )
    ends = F.filter("all", lambda e, i: (i % fan) == fan - 1)
    edges = cuts.select(F.struct(F.col("all"), ends.alias("ends")).alias("edges")).scalar()
    # two short scans instead of one long one: whole runs of `fan` edges, then the rest
    runs = F.size(F.filter("__edges.ends", lambda e: e < value))
    inside = F.slice("__edges.all", F.col("__runs") * fan + 1, F.lit(fan))
    rest = F.size(F.filter(inside, lambda e: e < value))
    return (
        df.withColumn("__edges", edges)
        .withColumn("__runs", runs)
        .withColumn(BUCKET, F.coalesce(F.col("__runs") * fan + rest, F.lit(0)))
        .withColumns({} if hot is None else {hot: F.coalesce((F.get("__edges.all", F.col(BUCKET)) == value) & (F.get("__edges.all", F.col(BUCKET) + 1) == value), F.lit(False))})
        .drop("__edges", "__runs")
    )


def hash_buckets(df: DataFrame, order: str, n_buckets: int | None = None) -> DataFrame:
    """Buckets for an ordering by md5 hex text, which is uniform, so no edges are needed."""
    n = n_buckets or default_buckets(df)
    head = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    return df.withColumn(BUCKET, F.coalesce(F.floor(head * n / F.lit(2**32)).cast("int"), F.lit(0)))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, str],
    mins: Mapping[str, str] | None = None,
    hashed: bool = False,
    n_buckets: int | None = None,
    small: bool = False,
    edges_from: DataFrame | None = None,
) -> DataFrame:
    """Add exclusive prefix sums over `order` within `keys`.

    `df` holds one row per (keys, order) value; a null key is a key like any other,
    a null order comes first. `totals` maps a numeric column to
    the name of its sum over strictly smaller order values; `all_<name>` gets the
    sum over the whole key. With `hashed`, `order` is md5 hex text. `mins` maps a column to the name of its minimum over
    this and all larger order values (the step-up minimum of FDR control). `small` is for result panels, whose groups have
    one row per cell: a plain window, with no buckets.
    """
    mins = dict(mins or {})
    keys = list(keys)
    if small:
        w = W.partitionBy(*keys).orderBy(order)
        out = [F.col(c) for c in df.columns]
        for c, name in totals.items():
            out.append(F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(name))
            out.append(F.sum(c).over(W.partitionBy(*keys)).alias(f"all_{name}"))
        out += [F.min(c).over(w.rowsBetween(0, W.unboundedFollowing)).alias(n) for c, n in mins.items()]
        return df.select(*out)
    cut = hash_buckets(df, order, n_buckets) if hashed else with_buckets(df, order, n_buckets, edges_from)
    by = keys + [BUCKET]

    sums = [F.sum(c).alias(f"__t_{c}") for c in totals] + [F.min(c).alias(f"__m_{c}") for c in mins]
    coarse = W.partitionBy(*keys).orderBy(BUCKET)
    before = coarse.rowsBetween(W.unboundedPreceding, -1)
    after = coarse.rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy(*keys)
    offsets = cut.groupBy(*by).agg(*sums).select(
        *[F.col(k).alias(f"__k_{k}") for k in by],
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in totals],
        *[F.sum(f"__t_{c}").over(whole).alias(f"all_{name}") for c, name in totals.items()],
        *[F.min(f"__m_{c}").over(after).alias(f"__a_{c}") for c in mins],
    )
    fine = W.partitionBy(*by).orderBy(order)
    inner_before = fine.rowsBetween(W.unboundedPreceding, -1)
    inner_after = fine.rowsBetween(0, W.unboundedFollowing)
    local = cut
    for c in totals:
        local = local.withColumn(f"__l_{c}", F.coalesce(F.sum(c).over(inner_before), F.lit(0)))
    for c in mins:
        local = local.withColumn(f"__n_{c}", F.min(c).over(inner_after))
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]
    joined = local.join(offsets, match)
    out = [F.col(c) for c in df.columns]
    out += [(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(name) for c, name in totals.items()]
    out += [F.col(f"all_{name}") for name in totals.values()]
    out += [F.least(f"__n_{c}", f"__a_{c}").alias(name) for c, name in mins.items()]
    return joined.select(*out)


def midranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = False, small: bool = False
) -> DataFrame:
    """One row per (keys, value) with its average rank and count.

    Ties share the mean of the ranks they cover.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, keys, value, {"n": "below"}, small=small, edges_from=known.select(value))
    up = F.col("below") + (F.col("n") + 1) / 2.0
    rank = F.col("all_below") + 1 - up if descending else up
    return run.select(*keys, value, "n", F.col("all_below").alias("n_total"), rank.alias(out))


def rank_rows(
    df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = False, small: bool = False
) -> DataFrame:
    """Every row with its average rank."""
    keys = list(keys)
    if small:
        known = F.col(value).isNotNull()
        first = F.rank().over(W.partitionBy(*keys, known).orderBy(F.col(value).desc() if descending else F.col(value)))
        ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
        return df.withColumn(out, F.when(known, first + (ties - 1) / 2.0))
    ranks = midranks(df, keys, value, out, descending).drop("n", "n_total")
    renamed = ranks.select(*[F.col(c).alias(f"__r_{c}") for c in keys + [value]], out)
    cond = [df[c].eqNullSafe(F.col(f"__r_{c}")) for c in keys + [value]]
    return df.join(renamed, cond, "left").select(*[df[c] for c in df.columns], out)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name.

    Order statistics come from running counts, so a group may be of any size.
    """
    keys = list(keys)
    v = f"__v_{value}"
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(v))
    counts = known.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, keys, v, {"n": "below"}, edges_from=known.select(v))
    upto = F.col("below") + F.col("n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("all_below") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when(lo < upto, F.when(lo >= F.col("below"), F.col(v)))).alias(f"__lo_{name}"))
        aggs.append(F.max(F.when(hi < upto, F.when(hi >= F.col("below"), F.col(v)))).alias(f"__hi_{name}"))
        aggs.append(F.max(pos - lo).alias(f"__f_{name}"))
    got = run.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
            for n in probs
        ],
    )
