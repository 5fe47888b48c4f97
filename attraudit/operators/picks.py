"""Bootstrap replicates of result panels: md5 draws of many replicates at once, values handed on as arrays.

The columns of a cell are arrays of numbers, so what is copied per share of the replicates is short, and no
draw is ever a row. Draws are those of `rand.uniform`, which SQL repeats.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.md5 import CHUNK, as_bytes, md5_grid, uniforms
from ..functions.weights import inverted
from .running import work_parts

VALUES = 1 << 20  # values of a cell that a task holds at once
HELD = 1 << 21  # draws that a task holds at once


def _shares(cells: DataFrame, b: int, parts: int) -> DataFrame:
    """Every cell once per share of the replicates, from `lo` up to below `hi`."""
    step = max(1, -(-b // parts))
    shares = cells.withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(step))))
    return shares.withColumn("hi", F.least(F.col("lo") + step, F.lit(b))).repartition(parts)


def _text(keys: Sequence[str]) -> Column:
    """':key:...:' as concat_ws joins them after a seed and a replicate: nulls are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(":"), F.col(k).cast("string")), F.lit("")) for k in keys], F.lit(":"))


def _results(batch: pa.RecordBatch, row: int, keys: list[str], reps: range, values: np.ndarray, name: str) -> pa.RecordBatch:
    at = pa.array(np.full(len(reps), row))
    cols = [batch.column(k).take(at) for k in keys]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(reps.start, reps.stop, dtype="i4")), pa.array(values, from_pandas=True)], names=[*keys, "rep", name])


def picked_means(rows: DataFrame, keys: Sequence[str], b: int, seed: int) -> DataFrame:
    """(keys, rep, value): mean of n picks out of the n rows (keys, i from 1, v); pick d of a replicate is row floor(u * n)."""
    keys, parts = list(keys), work_parts(rows)
    cut = rows.withColumn("__block", F.floor((F.col("i") - 1) / VALUES))
    arrays = cut.groupBy(*keys, "__block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("values"), F.min("i").cast("long").alias("first"),
    )
    sizes = rows.groupBy(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(keys)]
    arrays = arrays.join(sizes, same).withColumn("text", _text(keys)) if keys else arrays.crossJoin(sizes).withColumn("text", F.lit(":"))
    shares = _shares(arrays.select(*keys, "text", "n", "first", "values"), b, parts)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), T.StructField("total", T.DoubleType())])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text, n, first, lo, hi = (batch.column(c)[k].as_py() for c in ("text", "n", "first", "lo", "hi"))
                values = batch.column("values")[k].values.to_numpy(zero_copy_only=False)
                total = np.zeros(hi - lo)
                for d in range(1, n + 1, CHUNK):
                    picks = as_bytes(np.arange(d, min(d + CHUNK, n + 1)))
                    for r in range(lo, hi):
                        at = np.floor(uniforms(md5_grid([f"{seed}:{r}{text}"], picks)[0]) * n).astype("i8") - (first - 1)
                        if len(values) < n:
                            at = at[(at >= 0) & (at < len(values))]
                        total[r - lo] += values[at].sum()
                yield _results(batch, k, keys, range(lo, hi), total / n, "total")

    return shares.mapInArrow(means, schema).groupBy(*keys, "rep").agg(F.sum("total").alias("value"))


def rank_draws(rows: DataFrame, cell: Sequence[str], x: str, y: str, unit: str, b: int, seed: int) -> DataFrame:
    """(cell, rep, rho): Spearman correlation under the Poisson weights of the units, midranks by running counts."""
    cell, parts = list(cell), work_parts(rows)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    tail = F.coalesce(F.concat(F.lit(":"), F.col(unit).cast("string")), F.lit(""))
    row = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), tail.alias("u"))
    arrays = both.groupBy(*cell).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    arrays = arrays.select(*cell, *[F.col(f"rows.{c}").alias(f"__{c}") for c in "xyu"])
    schema = T.StructType([*[rows.schema[k] for k in cell], T.StructField("rep", T.IntegerType()), T.StructField("rho", T.DoubleType())])

    def ranks_of(values: np.ndarray):
        order = np.argsort(values, kind="stable")
        s = values[order]
        ends = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]]))
        group = np.empty(len(s), "i8")
        group[order] = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[-1], ends])))

        def ranks(w: np.ndarray) -> np.ndarray:
            upto = np.cumsum(w[:, order], 1)[:, ends]
            tied = np.diff(upto, axis=1, prepend=0)
            return (upto - tied + (tied + 1) / 2)[:, group]

        return ranks

    def rho(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lo, hi = (batch.column(c)[k].as_py() for c in ("lo", "hi"))
                u = as_bytes(batch.column("__u")[k].values.to_pylist())
                of_x, of_y = (ranks_of(batch.column(f"__{c}")[k].values.to_numpy(zero_copy_only=False)) for c in "xy")
                step, out = max(1, HELD // len(u)), np.full(hi - lo, np.nan)
                for r in range(lo, hi, step):
                    reps = range(r, min(r + step, hi))
                    w = inverted((md5_grid([f"{seed}:{q}" for q in reps], u) >> np.uint64(32)).astype("u4")).astype("f8")
                    n = w.sum(1)
                    a, c = (f(w) - (n[:, None] + 1) / 2 for f in (of_x, of_y))
                    cov, va, vc = ((w * p * q).sum(1) for p, q in ((a, c), (a, a), (c, c)))
                    ok = (n >= 3) & (va > 0) & (vc > 0)
                    out[r - lo:r - lo + len(reps)] = np.where(ok, cov / np.sqrt(np.where(ok, va * vc, 1.0)), np.nan)
                yield _results(batch, k, cell, range(lo, hi), out, "rho")

    return _shares(arrays, b, parts).mapInArrow(rho, schema)
