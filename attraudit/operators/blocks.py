"""Arrow batches as numeric blocks, and distributed sums of matrices over them."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gram import sum_arrays


def matrix(column: pa.Array) -> np.ndarray:
    """A fixed-width list column as a float64 matrix; null elements become NaN."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


@dataclass
class Block:
    """The rows of one model inside one Arrow batch."""

    model: str
    at: np.ndarray
    x: np.ndarray
    f: np.ndarray
    y: np.ndarray


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Split a batch of (model, x, f, y) rows by model; models may differ in width."""
    if batch.num_rows == 0:
        return
    names = np.asarray(batch.column("model").to_pylist(), dtype=object)
    f, y = matrix(batch.column("f")), matrix(batch.column("y"))
    whole = np.arange(batch.num_rows)
    distinct = sorted(set(names.tolist()))
    for m in distinct:
        at = whole if len(distinct) == 1 else np.flatnonzero(names == m)
        col = batch.column("x")
        x = matrix(col if len(distinct) == 1 else col.take(pa.array(at)))
        yield Block(m, at, x, f[at], y[at])


def row_sums(rows: DataFrame, per_block: Callable[[Block], np.ndarray]) -> dict[str, np.ndarray]:
    """Sum one matrix per model over all rows of the table.

    Every task adds up its own blocks and emits the matrix row by row, so the
    final sums are spread over the reducers and only one matrix per model reaches
    the driver.
    """
    schema = T.StructType([
        T.StructField("model", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("g", T.ArrayType(T.DoubleType())),
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        count: dict[str, int] = {}
        for batch in batches:
            for b in blocks(batch):
                part = per_block(b)
                total[b.model] = total[b.model] + part if b.model in total else part
                count[b.model] = count.get(b.model, 0) + len(b.at)
        for m, g in total.items():
            frame = pd.DataFrame({"model": m, "i": np.arange(len(g), dtype=np.int32), "n": count[m], "g": list(g)})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    got = sum_arrays(rows.select("model", "x", "f", "y").mapInArrow(partial, schema), ["model", "i"]).toArrow()
    out: dict[str, list] = {}
    for batch in got.to_batches():
        for m, i, g in zip(batch["model"].to_pylist(), batch["i"].to_pylist(), batch["g"]):
            out.setdefault(m, []).append((i, g.values.to_numpy()))
    return {m: np.array([g for _, g in sorted(v, key=lambda t: t[0])]) for m, v in out.items()}


@dataclass
class Moments:
    """Rows, means, cross products of the first columns with all, and squares of all, both about the means; plain sums of `extra`."""

    n: float
    mean: np.ndarray
    cross: np.ndarray
    squares: np.ndarray
    extra: np.ndarray

    def add(self, o: "Moments") -> "Moments":
        """Moments of both sets of rows; no difference of large sums is taken."""
        n, d = self.n + o.n, o.mean - self.mean
        if not n:
            return self
        f = self.n * o.n / n
        k = len(self.cross)
        return Moments(n, self.mean + d * (o.n / n), self.cross + o.cross + f * np.outer(d[:k], d), self.squares + o.squares + f * d * d, self.extra + o.extra)

    @staticmethod
    def of(z: np.ndarray, k: int, extra: np.ndarray, times: np.ndarray | None = None) -> "Moments":
        """Moments of the rows of z, each taken so many `times` (None: once)."""
        w = np.ones(len(z)) if times is None else times
        n = float(w.sum())
        mean = w @ z / n if n else np.zeros(z.shape[1])
        c = z - mean
        return Moments(n, mean, (c[:, :k] * w[:, None]).T @ c, w @ (c * c), extra)


def row_moments(rows: DataFrame, per_block: Callable[[Block], tuple]) -> dict[str, Moments]:
    """Centred moments of one matrix per model: `per_block` gives (columns, how many of them are crossed, extra sums[, times each row counts]).

    Tasks merge their own blocks and hand on one row per line of the matrix, so
    lines of one model merge in different tasks, one open line a (model, line).
    """
    schema = T.StructType([
        T.StructField("model", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("n", T.DoubleType()),
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "g", "extra")],
    ])

    def lines(total: dict[str, Moments]) -> Iterator[pa.RecordBatch]:
        for m, t in total.items():
            g = [t.squares, *t.cross]
            frame = pd.DataFrame({"model": m, "i": np.arange(-1, len(t.cross), dtype=np.int32), "n": t.n, "mean": [t.mean] * len(g), "g": g, "extra": [t.extra] + [t.extra[:0]] * len(t.cross)})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Moments] = {}
        for batch in batches:
            for b in blocks(batch):
                part = Moments.of(*per_block(b))
                total[b.model] = total[b.model].add(part) if b.model in total else part
        yield from lines(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple] = {}
        for batch in batches:
            for model, i, n, mean, g, extra in zip(*(batch.column(c) for c in ("model", "i", "n", "mean", "g", "extra"))):
                key, n = (model.as_py(), i.as_py()), n.as_py()
                mean, g, extra = (v.values.to_numpy(zero_copy_only=False) for v in (mean, g, extra))
                if key not in seen:
                    seen[key] = (n, mean, g, extra)
                elif n:
                    n0, mean0, g0, extra0 = seen[key]
                    d = mean - mean0
                    own = d if key[1] < 0 else d[key[1]]
                    seen[key] = (n0 + n, mean0 + d * (n / (n0 + n)), g0 + g + n0 * n / (n0 + n) * own * d, extra0 + extra)
        for (model, i), (n, mean, g, extra) in seen.items():
            frame = pd.DataFrame({"model": [model], "i": np.array([i], np.int32), "n": [n], "mean": [mean], "g": [g], "extra": [extra]})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    sums = rows.select("model", "x", "f", "y").mapInArrow(partial, schema)
    found: dict[str, dict[int, tuple]] = {}
    for r in sums.repartition("model", "i").mapInArrow(merge, schema).collect():
        found.setdefault(r["model"], {})[r["i"]] = r
    out = {}
    for m, v in found.items():
        top = v.pop(-1)
        mean = np.array(top["mean"])
        cross = np.array([v[i]["g"] for i in range(len(v))]).reshape(len(v), len(mean))
        out[m] = Moments(top["n"], mean, cross, np.array(top["g"]), np.array(top["extra"]))
    return out


def feature_rows(
    embeddings: DataFrame, units: DataFrame, designs: list[str], targets: list[str], split: str = "split",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(model, unit_id, split, x, f, y, keep...): the layout of all representation operators."""
    def pack(cols):
        if not cols:
            return F.array().cast("array<double>")
        return F.array(*[F.col(c).cast("double") for c in cols])

    side = units.select("unit_id", F.col(split).alias("split"), pack(designs).alias("f"), pack(targets).alias("y"), *keep)
    return embeddings.select("model", "unit_id", F.col("embedding").alias("x")).join(side, "unit_id")
