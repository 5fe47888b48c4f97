"""Permutation nulls by exact dealing of counts: cell, bucket, score, for all replicates at once.

Shuffled labels only change how many positives each distinct score gets, and these numbers follow the
multivariate hypergeometric distribution. They are drawn down a tree: a cell's positives go to its buckets, a
bucket's to its scores. Groups are dealt the same way, as tables of groups x labels. No row is copied or sorted
per replicate; buckets x replicates numbers are all that travels. A generator is keyed by seed, cell and bucket,
so a task that runs again draws the same. Populations stay below 10**9 a cell, the limit of the exact sampler.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import numbers, one_row, replicates, wide, wide_schema
from .running import with_buckets, work_parts


def generator(seed: int, *keys: int) -> np.random.Generator:
    return np.random.default_rng([seed, *[k & (2**64 - 1) for k in keys]])


def dealt(rng: np.random.Generator, left: np.ndarray, count: int) -> np.ndarray:
    """How `count` places are taken from piles of sizes `left` (replicates x piles), without replacement."""
    out = np.zeros(left.shape, "<i8")
    if count == 0:
        return out
    total = left.sum(1)
    if count == 1:
        pile = (rng.random(len(left)) * total >= np.cumsum(left, 1).T).sum(0)
        out[np.arange(len(left)), np.minimum(pile, left.shape[1] - 1)] = 1
        return out
    todo = np.full(len(left), count)
    for g in range(left.shape[1] - 1):
        total = total - left[:, g]
        out[:, g] = rng.hypergeometric(left[:, g], total, todo)
        todo = todo - out[:, g]
    out[:, -1] = todo
    return out


def _flat(counts: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Distinct scores with their counts, their bucket and a hash of their cell."""
    return with_buckets(counts, "s", work_parts(counts)).withColumn("__cell", F.xxhash64(*[F.col(c).cast("string") for c in cell], F.lit(0)))


def _dealt_out(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Buckets in as many tasks as there are buckets a cell."""
    return df.repartition(work_parts(df), *by)


def _deal_labels(by: list[str], b: int, seed: int):
    """Positives of each bucket in every replicate, and the rows below it."""
    def deal(table: pa.Table) -> pa.Table:
        bucket, rows, pos, cell = numbers(table, "__bucket rows pos __cell")
        rng = generator(seed, int(cell[0]))
        left = np.tile(np.array([pos.sum(), (rows - pos).sum()], "<i8"), (b, 1))
        order, got, below, seen = np.argsort(bucket), {}, {}, 0
        for k in order.tolist():
            take = dealt(rng, left, int(rows[k]))
            left, got[k], below[k], seen = left - take, take[:, 0], seen, seen + int(rows[k])
        out = table.select(by)
        out = out.append_column("positives", pa.array([got[k].astype("f8") for k in range(len(rows))], pa.list_(pa.float64())))
        return out.append_column("below", pa.array([np.array([float(below[k])]) for k in range(len(rows))], pa.list_(pa.float64())))

    return deal


def _rank_sums(cell: list[str], b: int, seed: int):
    def sums(table: pa.Table, offset: pa.Table) -> pa.Table:
        s, n, key = numbers(table, "s n __cell")
        rng = generator(seed, int(key[0]), 1 + int(table["__bucket"][0].as_py()))
        pos = wide(offset["positives"])[0].astype("<i8")
        left, below, out = np.stack([pos, int(n.sum()) - pos], 1), float(wide(offset["below"])[0][0]), np.zeros(b)
        for k in np.argsort(s).tolist():
            take = dealt(rng, left, int(n[k]))
            left = left - take
            out += take[:, 0] * (below + (n[k] + 1) / 2)
            below += n[k]
        return one_row(table, cell, {"ranks": out})

    return sums


def _added(cell: list[str]):
    return lambda table: one_row(table, cell, {"ranks": wide(table["ranks"]).sum(0)})


def shuffled_labels(rows: DataFrame, cell: Sequence[str], b: int, seed: int) -> DataFrame:
    """(cell, rep, ranks): the rank sum of the positives under shuffled labels; rows of (cell, y, p)."""
    cell = list(cell)
    counts = rows.groupBy(*cell, F.col("p").cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    cut = _flat(counts, cell)
    by = [*cell, "__bucket"]
    sizes = cut.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("pos"), F.max("__cell").alias("__cell"))
    offsets = sizes.groupBy(*cell).applyInArrow(_deal_labels(by, b, seed), wide_schema(cut, by, ["positives", "below"]))
    parts = _dealt_out(cut, by).groupBy(*by).cogroup(_dealt_out(offsets, by).groupBy(*by)).applyInArrow(_rank_sums(cell, b, seed), wide_schema(cut, cell, ["ranks"]))
    return replicates(parts.groupBy(*cell).applyInArrow(_added(cell), wide_schema(cut, cell, ["ranks"])), cell, ["ranks"])


def _deal_groups(by: list[str], b: int, seed: int):
    """Groups x labels of each bucket in every replicate."""
    def deal(table: pa.Table) -> pa.Table:
        bucket, pos, neg, cell = numbers(table, "__bucket pos neg __cell")
        sizes = np.array(table["sizes"][0].as_py(), "<i8")
        rng, left, got = generator(seed, int(cell[0])), np.tile(sizes, (b, 1)), {}
        for k in np.argsort(bucket).tolist():
            for name, n in (("pos", int(pos[k])), ("neg", int(neg[k]))):
                take = dealt(rng, left, n)
                left, got[k, name] = left - take, take
        out = table.select(by)
        for name in ("pos", "neg"):
            out = out.append_column(name, pa.array([got[k, name].ravel().astype("f8") for k in range(len(bucket))], pa.list_(pa.float64())))
        return out

    return deal


def _group_areas(keys: list[str], b: int, seed: int):
    """Local area, positives and negatives of every group in a bucket."""
    def areas(table: pa.Table, offset: pa.Table) -> pa.Table:
        s, pos, neg, key = numbers(table, "s pos neg __cell")
        rng = generator(seed, int(key[0]), 1 + int(table["__bucket"][0].as_py()))
        left = [wide(offset[c])[0].reshape(b, -1).astype("<i8") for c in ("pos", "neg")]
        all_, below = [x.copy() for x in left], np.zeros(left[0].shape)
        area = np.zeros(left[0].shape)
        for k in np.argsort(s).tolist():
            if neg[k]:
                n = dealt(rng, left[1], int(neg[k]))
                left[1] = left[1] - n
            if pos[k]:
                p = dealt(rng, left[0], int(pos[k]))
                left[0] = left[0] - p
                area += p * (below + n / 2) if neg[k] else p * below
            if neg[k]:
                below += n
        return one_row(table, keys, {"area": area.ravel(), "pos": all_[0].ravel().astype("f8"), "neg": all_[1].ravel().astype("f8")})

    return areas


def _gaps(cell: list[str], b: int, min_n: int):
    """Max-min AUROC of the groups in every replicate; NaN if a group has one class only or too few rows."""
    def gap(table: pa.Table) -> pa.Table:
        area, pos, neg = (wide(table[c]).reshape(table.num_rows, b, -1) for c in ("area", "pos", "neg"))
        total, below = np.zeros(area.shape[1:]), np.zeros(area.shape[1:])
        for k in np.argsort(table["__bucket"].to_numpy()).tolist():
            total += area[k] + pos[k] * below
            below = below + neg[k]
        n_pos = pos.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            auroc = np.where((n_pos > 0) & (below > 0) & (n_pos + below >= min_n), total / (n_pos * below), np.nan)
        return one_row(table, cell, {"gap": auroc.max(1) - auroc.min(1)})

    return gap


def shuffled_groups(rows: DataFrame, sizes: DataFrame, cell: Sequence[str], b: int, seed: int, min_n: int) -> DataFrame:
    """(cell, rep, v): the gap between groups under shuffled group labels; rows of (cell, y, p), sizes of (cell, sizes)."""
    cell = list(cell)
    counts = rows.groupBy(*cell, F.col("p").cast("double").alias("s")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cut = _flat(counts, cell)
    by = [*cell, "__bucket"]
    found = cut.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("__cell").alias("__cell"))
    found = found.join(sizes, cell) if cell else found.withColumn("sizes", sizes.select("sizes").scalar())
    offsets = found.groupBy(*cell).applyInArrow(_deal_groups(by, b, seed), wide_schema(cut, by, ["pos", "neg"]))
    parts = _dealt_out(cut, by).groupBy(*by).cogroup(_dealt_out(offsets, by).groupBy(*by)).applyInArrow(_group_areas(by, b, seed), wide_schema(cut, by, ["area", "pos", "neg"]))
    gaps = replicates(parts.groupBy(*cell).applyInArrow(_gaps(cell, b, min_n), wide_schema(cut, cell, ["gap"])), cell, ["gap"])
    return gaps.select(*cell, "rep", F.when(~F.isnan("gap"), F.col("gap")).alias("v"))
