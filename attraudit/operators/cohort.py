"""Cohorts, entity attributes, leak-free splits and eligibility guards."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.md5 import as_bytes, md5_grid
from ..functions.rand import hash_order
from ..schema import require
from .running import exact_quantiles, running_totals, work_parts


def canonical_units(embeddings: DataFrame, units: DataFrame | None = None, n_models: int | None = None) -> DataFrame:
    """Ids that every model covers, and that the unit table knows.

    One aggregation over (unit, model) pairs instead of one join per model.
    """
    require(embeddings, unit_id="any", model="string")
    pairs = embeddings.select("unit_id", "model").distinct()
    if n_models is None:
        wanted = embeddings.agg(F.count_distinct("model").alias("n")).scalar()
    else:
        wanted = F.lit(n_models)
    ids = pairs.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == wanted).select("unit_id")
    return ids if units is None else ids.join(units.select("unit_id"), "unit_id", "left_semi")


def align(units: DataFrame, embeddings: DataFrame, strict: bool = False) -> DataFrame:
    """Embeddings of the given units (J2, S7); `strict` fails on a unit without one."""
    if strict:
        missing = units.select("unit_id").join(embeddings.select("unit_id"), "unit_id", "left_anti")
        if not missing.isEmpty():
            raise ValueError("some units have no embedding")
    return embeddings.join(units, "unit_id")


def unmatched(units: DataFrame, other: DataFrame, key: str = "unit_id") -> DataFrame:
    """How many units the other table lacks (the report beside J9)."""
    known = other.select(key, F.lit(1).alias("__hit")).dropDuplicates([key])
    return units.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("__hit").isNull()).alias("n_unmatched")
    )


def majority_category(rows: DataFrame, entity: str, category: str, unknown: str = "Unknown") -> DataFrame:
    """Most frequent category per entity; unknown only if nothing is known."""
    known = F.when(F.col(category) != unknown, F.col(category))
    return rows.groupBy(entity).agg(F.coalesce(F.mode(known, True), F.lit(unknown)).alias(category))


def first_known(rows: DataFrame, entity: str, value: str, order: str) -> DataFrame:
    """First non-null value per entity in `order`."""
    return rows.where(F.col(value).isNotNull()).groupBy(entity).agg(F.min_by(value, order).alias(value))


def attach_entity(units: DataFrame, entities: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Entity attribute for each unit: left join with a default, inner without."""
    joined = units.join(entities.select(key, value), key, "left" if default is not None else "inner")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def entity_split(
    entities: DataFrame,
    entity: str,
    stratum: str | None = None,
    cuts: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.85)),
    rest: str = "test",
    seed: int = 42,
) -> DataFrame:
    """Assign every entity to one split, stratified, by hash order.

    Within a stratum the entities are ordered by a seeded md5; the first
    floor(cut * n) go to each part in turn. Returns (entity, stratum, split).
    """
    keys = [stratum] if stratum else []
    one = entities.select(entity, *keys).dropDuplicates([entity])
    ordered = one.withColumn("__h", hash_order(seed, entity)).withColumn("__n", F.lit(1))
    run = running_totals(ordered, keys, "__h", {"__n": "pos"}, hashed=True)
    label = None
    for name, cut in cuts:
        cond = F.col("pos") < F.floor(F.lit(float(cut)) * F.col("all_pos"))
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return run.select(entity, *keys, label.otherwise(rest).alias("split"))


def one_per_entity(units: DataFrame, entity: str, unit: str, seed: int = 42) -> DataFrame:
    """One random unit per entity (W5); hot entities shrink before the shuffle."""
    row = F.struct(*units.columns)
    return units.groupBy(entity).agg(F.min_by(row, hash_order(seed, unit)).alias("r")).select("r.*")


def one_per_entity_sweep(units: DataFrame, entity: str, unit: str, seeds: Sequence[int]) -> DataFrame:
    """One random unit per entity for each seed."""
    grid = units.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    row = F.struct(*units.columns)
    picked = grid.groupBy("seed", entity).agg(F.min_by(row, hash_order(F.col("seed"), unit)).alias("r"))
    return picked.select("seed", "r.*")


def _first_flags(seeds: list[int], bits: int, digits: int):
    """Patterns of each entity's first unit under every seed, counted per task; rows come sorted by entity."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, int]] = {}
        rest: tuple | None = None  # the last entity and its minima: the next batch may go on with it

        def add(least: np.ndarray) -> None:
            got = [np.unique(row, return_counts=True) for row in least & ((1 << bits) - 1)]
            for k, (flags, n) in enumerate(got):
                mine = found.setdefault(k, {})
                for f, c in zip(flags.tolist(), n.tolist()):
                    mine[f] = mine.get(f, 0) + c

        for batch in batches:
            if not len(batch):
                continue
            entity, flags = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), batch.column(2).to_numpy()
            heads = md5_grid([str(s) for s in seeds], as_bytes(batch.column(1).to_pylist())) >> np.uint64(64 - 4 * digits)
            starts = np.flatnonzero(np.concatenate([[True], entity[1:] != entity[:-1]]))
            least = np.minimum.reduceat((heads.astype("i8") << bits) + flags, starts, axis=1)
            if rest is not None:
                if rest[0] == batch.column(0)[0].as_py():
                    least[:, 0] = np.minimum(least[:, 0], rest[1])
                else:
                    add(rest[1][:, None])
            rest = batch.column(0)[len(batch) - 1].as_py(), least[:, -1]
            add(least[:, :-1])
        if rest is not None:
            add(rest[1][:, None])
        rows = [(seeds[k], f, n) for k, mine in found.items() for f, n in mine.items()]
        if rows:
            seed, f, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int32()), pa.array(f, pa.int64()), pa.array(n, pa.int64())], ["seed", "__flags", "n"])

    return count


def one_per_entity_patterns(units: DataFrame, entity: str, unit: str, columns: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """(seed, columns, n): how many entities show each pattern of 0, 1 or null in their one random unit, for each seed.

    Rows come sorted by entity; a task keeps, per entity, a minimum for every seed: the head of the unit's hash, with
    its flags packed behind it. Rows are not copied per seed; a task hands on its counts of patterns only.
    """
    bits = 2 * len(columns)
    digits = (63 - bits) // 4
    if digits < 8:
        raise ValueError("at most 15 columns: the hash needs 32 bits")
    flags = F.lit(0).cast("bigint")
    for c in columns:
        flags = flags * 4 + F.when(F.col(c) == 1, 1).when(F.col(c) == 0, 0).otherwise(2)
    tail = F.coalesce(F.concat(F.lit(":"), F.col(unit).cast("string")), F.lit(""))
    slim = units.select(F.col(entity).alias("__entity"), tail.alias("__unit"), flags.alias("__flags"))
    dealt = slim.repartition(work_parts(units), "__entity").sortWithinPartitions("__entity")
    counts = dealt.mapInArrow(_first_flags([int(s) for s in seeds], bits, digits), "seed int, __flags long, n long").groupBy("seed", "__flags").agg(F.sum("n").alias("n"))
    code = [F.shiftright("__flags", 2 * (len(columns) - 1 - k)).bitwiseAND(3) for k in range(len(columns))]
    return counts.select("seed", *[F.when(x < 2, x.cast("int")).alias(c) for x, c in zip(code, columns)], "n")


def subsample(rows: DataFrame, unit: str, sizes: dict[str, int], split: str = "split", seed: int = 42) -> DataFrame:
    """A random subsample of fixed size of the named splits (M26), to bound what costly steps are fitted on.

    Splits without a size stay whole: what is scored is never sampled.
    """
    ordered = rows.withColumn("__h", hash_order(seed, unit)).withColumn("__n", F.lit(1))
    run = running_totals(ordered, [split], "__h", {"__n": "pos"}, hashed=True)
    limit = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(split)]
    return run.where(limit.isNull() | (F.col("pos") < limit)).select(*rows.columns)


def median_cut(rows: DataFrame, value: str, keys: Sequence[str] = (), out: str = "median") -> DataFrame:
    """Exact median per group (P8, P9, P23): the cut point of a median split."""
    return exact_quantiles(rows, keys, value, {out: 0.5})


def train_stats(rows: DataFrame, value: str, keys: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    """Mean and population deviation per key, for train-fit z-scores."""
    sd = F.stddev_pop(value) + F.lit(eps)
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def _moments(fitted: DataFrame, columns: Sequence[str], eps: float = 0.0) -> Column:
    """Means and population deviations of several columns as one scalar struct: one scan."""
    parts = []
    for c in columns:
        sd = F.stddev_pop(c) + F.lit(eps)
        parts += [F.avg(c).alias(f"m_{c}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"s_{c}")]
    return fitted.agg(*parts).select(F.struct("*").alias("stats")).scalar()


def _medians(fitted: DataFrame, columns: Sequence[str]) -> Column:
    """Exact medians of several columns as one scalar struct, from one pass in long form."""
    long = fitted.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "__c", "__v")
    med = exact_quantiles(long, ["__c"], "__v", {"m": 0.5})
    row = med.agg(*[F.max(F.when(F.col("__c") == c, F.col("m"))).alias(c) for c in columns])
    return row.select(F.struct("*").alias("medians")).scalar()


def zscore(rows: DataFrame, value: str, train: Column, out: str, eps: float = 0.0) -> DataFrame:
    """Standardize one column with the mean and deviation of the train rows."""
    stats = _moments(rows.where(train), [value], eps)
    return (
        rows.withColumn("__s", stats)
        .withColumn(out, (F.col(value) - F.col(f"__s.m_{value}")) / F.col(f"__s.s_{value}"))
        .drop("__s")
    )


def impute_median(rows: DataFrame, value: str, train: Column) -> DataFrame:
    """Fill missing values with the train median."""
    filled = rows.withColumn("__m", _medians(rows.where(train), [value]))
    return filled.withColumn(value, F.coalesce(F.col(value), F.col(f"__m.{value}"))).drop("__m")


def metadata_vector(
    rows: DataFrame, continuous: Sequence[str], binary: Sequence[str], train: Column, out: str = "meta"
) -> DataFrame:
    """Imputed, scaled continuous columns then 0-filled flags, as one array."""
    medians = _medians(rows.where(train), continuous)
    df = rows.withColumn("__m", medians)
    for c in continuous:
        df = df.withColumn(f"__i_{c}", F.coalesce(F.col(c).cast("double"), F.col(f"__m.{c}")))
    imputed = [f"__i_{c}" for c in continuous]
    df = df.withColumn("__s", _moments(df.where(train), imputed))
    parts = [(F.col(c) - F.col(f"__s.m_{c}")) / F.col(f"__s.s_{c}") for c in imputed]
    parts += [F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in binary]
    return df.withColumn(out, F.array(*parts)).drop("__m", "__s", *imputed)


def finding_tiers(
    labels: DataFrame,
    max_prevalence: float = 0.9,
    tier1: tuple[int, int, int] = (100, 30, 30),
    tier2: tuple[int, int, int] = (30, 15, 15),
) -> DataFrame:
    """Eligibility tier per finding from its test labels."""
    require(labels, finding="string", label="numeric")
    agg = labels.groupBy("finding").agg(
        F.count("label").alias("n_valid"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("n_pos")
    )
    n, pos, neg = F.col("n_valid"), F.col("n_pos"), F.col("n_valid") - F.col("n_pos")
    share = F.when(n > 0, pos / n).otherwise(1.0)

    def enough(t):
        return (n >= t[0]) & (pos >= t[1]) & (neg >= t[2])

    tier = (
        F.when((share > max_prevalence) | (1 - share > max_prevalence), "excluded")
        .when(enough(tier1), "tier1")
        .when(enough(tier2), "tier2")
        .otherwise("excluded")
    )
    return agg.select("finding", n, pos, neg.alias("n_neg"), share.alias("prevalence"), tier.alias("tier"))


def probe_targets(
    rows: DataFrame, binary: Sequence[str], continuous: Sequence[str], min_pos=50, min_neg=50, min_rows=200
) -> DataFrame:
    """Attributes with enough rows to be probed."""
    cols = [F.col(c).cast("double").alias(c) for c in [*binary, *continuous]]
    long = rows.select(*cols).unpivot([], [*binary, *continuous], "attribute", "v").where(F.col("v").isNotNull())
    task = F.when(F.col("attribute").isin(*binary), "binary").otherwise("regression") if binary else F.lit("regression")
    agg = long.withColumn("task", task).groupBy("attribute", "task").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")
    )
    ok = F.when(
        F.col("task") == "binary", (F.col("s") >= min_pos) & (F.col("n") - F.col("s") >= min_neg)
    ).otherwise(F.col("n") >= min_rows)
    prevalence = F.when(F.col("task") == "binary", F.col("s") / F.col("n"))
    return agg.where(ok).select("attribute", "task", "n", prevalence.alias("prevalence"))


def cell_guard(
    labels: DataFrame,
    cell: Sequence[str],
    min_train: int = 50,
    min_test: int = 50,
    min_pos: int = 10,
    min_neg: int = 0,
) -> DataFrame:
    """Cells with enough valid train and test rows (P14; P15 with other numbers)."""
    def count(split, y=None):
        cond = (F.col("split") == split) & F.col("label").isNotNull()
        return F.count_if(cond if y is None else cond & (F.col("label") == y))

    agg = labels.groupBy(*cell).agg(
        count("train").alias("n_train"), count("test").alias("n_test"),
        count("train", 1).alias("pos_train"), count("test", 1).alias("pos_test"),
        count("train", 0).alias("neg_train"), count("test", 0).alias("neg_test"),
    )
    ok = (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)
    ok = ok & (F.least("pos_train", "pos_test") >= min_pos) & (F.least("neg_train", "neg_test") >= min_neg)
    return agg.where(ok)


def describe_cohort(units: DataFrame, continuous: Sequence[str], male: str) -> DataFrame:
    """Row count, mean and deviation of continuous columns, male share."""
    aggs = [F.count(F.lit(1)).alias("n_units"), F.count_distinct("entity_id").alias("n_entities")]
    for c in continuous:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return units.agg(*aggs, F.avg(F.col(male).cast("double")).alias("male_share"))


def label_coverage(labels: DataFrame) -> DataFrame:
    """Valid, positive and share counts per finding."""
    return labels.groupBy("finding").agg(
        F.count("label").alias("n_valid"), F.count_if(F.col("label") == 1).alias("n_pos"),
        F.avg("label").alias("prevalence"),
    )


def match_by_stem(index: DataFrame, wanted: DataFrame, path: str = "path") -> DataFrame:
    """Match wanted paths to an index by path without extension.

    The full stem wins; otherwise the stem without its top directory is tried.
    """
    def stem(c):
        return F.regexp_replace(c, r"\.[^./]*$", "")

    def short(c):
        return F.regexp_replace(stem(c), r"^[^/]*/", "")

    full = index.groupBy(stem(F.col(path)).alias("__full")).agg(F.min(path).alias("__hit_full"))
    cut = index.groupBy(short(F.col(path)).alias("__short")).agg(F.min(path).alias("__hit_short"))
    w = wanted.withColumn("__f", stem(F.col(path)))
    out = w.join(full, w["__f"] == full["__full"], "left").join(cut, w["__f"] == cut["__short"], "left")
    return out.select(*wanted.columns, F.coalesce("__hit_full", "__hit_short").alias("matched_path"))
