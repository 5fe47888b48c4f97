"""Metrics of all bootstrap replicates at once: weights are vectors over replicates, rows are never copied.

Rows are (cell..., y, p, h, m): the hash that their weights follow from and how many equal rows they stand for.
The score axis is cut into buckets; one task walks a (cell, bucket) in score order with prefix sums as wide as
there are replicates. Only the sums of buckets, buckets x replicates numbers, travel on. A score that fills
several buckets is dealt to salted groups, whose sums are added as one tie. The shuffle of rows doesn't depend on
the number of replicates.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.weights import poisson_weights
from .running import with_buckets, work_parts

ROWS = 128  # rows whose weights are held at once
SALTS = 16
DENSE = 8  # up to so many cells, a unit's rows are one row of a product
OPEN_CELLS = 64  # cells whose sums a task holds at once
_WIDE = T.ArrayType(T.DoubleType())


def wide_schema(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, _WIDE) for c in columns]])


def one_row(table: pa.Table, keys: Sequence[str], columns: dict[str, np.ndarray]) -> pa.Table:
    """The keys of a group and one wide array per column."""
    out = table.select(list(keys)).slice(0, 1)
    for name, v in columns.items():
        out = out.append_column(name, pa.array([v], pa.list_(pa.float64())))
    return out


def wide(column: pa.ChunkedArray) -> np.ndarray:
    """Rows x replicates."""
    flat = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def numbers(table: pa.Table, names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names.split()]


def by_score(s: np.ndarray, y: np.ndarray, h: np.ndarray, m: np.ndarray, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weights of positives and negatives (scores x b) of ascending distinct scores, some scores at a time."""
    order = np.argsort(s, kind="stable")
    s, y, h, m = s[order], y[order], h[order], m[order]
    pending: tuple[np.ndarray, np.ndarray] | None = None
    for lo in range(0, len(s), ROWS):
        hi = min(lo + ROWS, len(s))
        w = poisson_weights(h[lo:hi], m[lo:hi], b)
        starts = np.flatnonzero(np.concatenate([[True], s[lo + 1:hi] != s[lo:hi - 1]]))
        is_pos = (y[lo:hi] == 1).astype("f8")[:, None]
        pos = w * is_pos
        neg = w - pos
        if len(starts) < hi - lo:
            pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        if pending is not None:
            if s[lo] == s[lo - 1]:
                pos[0] += pending[0][0]
                neg[0] += pending[1][0]
            else:
                yield pending
        yield pos[:-1], neg[:-1]
        pending = pos[-1:], neg[-1:]  # the next rows may have the same score
    if pending is not None:
        yield pending


def _bucket_sums(by: list[str], b: int):
    def sums(table: pa.Table) -> pa.Table:
        s, y, h, m, hot = numbers(table, "s y h m __hot")
        pos, neg, area = np.zeros(b), np.zeros(b), np.zeros(b)
        for p, n in by_score(s, y, h, m, b):
            upto = neg + np.cumsum(n, 0)
            area += (p * (upto - n / 2)).sum(0)
            pos, neg = pos + p.sum(0), upto[-1] if len(upto) else neg
        return one_row(table, by, {"pos": pos, "neg": neg, "area": area})

    return sums


def _ordered(table: pa.Table) -> list[tuple[int, bool, list[int]]]:
    """(bucket, tie, rows) in score order; the salted groups of a tie together, after the rest of their bucket."""
    where: dict[tuple[int, bool], list[int]] = {}
    for k, (x, t) in enumerate(zip(table["__bucket"].to_pylist(), table["__salt"].to_pylist())):
        where.setdefault((x, t > 0), []).append(k)
    return [(x, t, where[x, t]) for x, t in sorted(where)]


def _whole_area(cell: list[str]):
    def area(table: pa.Table) -> pa.Table:
        pos, neg, part = (wide(table[c]) for c in ("pos", "neg", "area"))
        total, below = np.zeros(pos.shape[1]), np.zeros(pos.shape[1])
        for _, tie, rows in _ordered(table):
            p, n = pos[rows].sum(0), neg[rows].sum(0)
            total += p * (below + (n / 2 if tie else 0)) + (0 if tie else part[rows].sum(0))
            below = below + n
        return one_row(table, cell, {"area": total, "pos": pos.sum(0), "neg": below})

    return area


def _bucketed(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    known = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    known = known.select(*cell, F.col("p").cast("double").alias("s"), F.col("y").cast("int").alias("y"), "h", F.col("m").cast("long").alias("m"))
    parts = work_parts(rows)
    cut = with_buckets(known, "s", parts, hot="__hot")
    cut = cut.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.col("h"), F.lit(SALTS)).cast("int") + 1).otherwise(0))
    return cut.repartition(parts, *cell, "__bucket", "__salt")


def replicates(wide_rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide arrays as rows (keys, rep, columns)."""
    zipped = F.arrays_zip(*columns)
    return wide_rows.select(*keys, F.posexplode(zipped).alias("rep", "__v")).select(*keys, "rep", *[F.col(f"__v.{c}").alias(c) for c in columns])


def auroc_draws(rows: DataFrame, cell: Sequence[str], b: int) -> DataFrame:
    """(cell, rep, value, n, n_pos): AUROC of every replicate, ties at one half."""
    cell = list(cell)
    cut = _bucketed(rows, cell)
    by = [*cell, "__bucket", "__salt"]
    sums = cut.groupBy(*by).applyInArrow(_bucket_sums(by, b), wide_schema(cut, by, ["pos", "neg", "area"]))
    whole = sums.groupBy(*cell).applyInArrow(_whole_area(cell), wide_schema(cut, cell, ["area", "pos", "neg"]))
    value = F.try_divide("area", F.col("pos") * F.col("neg"))
    return replicates(whole, cell, ["area", "pos", "neg"]).select(*cell, "rep", value.alias("value"), (F.col("pos") + F.col("neg")).alias("n"), F.col("pos").alias("n_pos"))


def _offsets(cell: list[str], by: list[str]):
    """What lies above each bucket, the totals of the cell, and the share of ties, whose sums are complete here."""
    def above(table: pa.Table) -> pa.Table:
        pos, neg = wide(table["pos"]), wide(table["neg"])
        all_pos = pos.sum(0)
        hit, called = np.zeros(pos.shape[1]), np.zeros(pos.shape[1])
        rows: dict[int, tuple[np.ndarray, ...]] = {}
        for _, tie, at in reversed(_ordered(table)):
            p, n = pos[at].sum(0), neg[at].sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(p > 0, p * (hit + p) / (called + p + n), 0) if tie else np.zeros(len(p))
            rows[at[0]] = hit, called, all_pos, part
            hit, called = hit + p, called + p + n
        keep = sorted(rows)
        out = table.select(by).take(keep)
        for k, name in enumerate(["hit", "called", "all_pos", "part"]):
            out = out.append_column(name, pa.array([rows[r][k] for r in keep], pa.list_(pa.float64())))
        return out.append_column("all_neg", pa.array([neg.sum(0)] * len(keep), pa.list_(pa.float64())))

    return above


def _precision_sums(cell: list[str], b: int):
    """Sum of positives x precision of a bucket, descending, on top of what lies above it."""
    def add(table: pa.Table, offset: pa.Table) -> pa.Table:
        hit, called, all_pos, part, all_neg = (wide(offset[c])[0].copy() for c in ("hit", "called", "all_pos", "part", "all_neg"))
        if not offset["__salt"][0].as_py():
            s, y, h, m = numbers(table, "s y h m")
            parts = list(by_score(-s, y, h, m, b)) if len(s) <= ROWS else by_score(-s, y, h, m, b)
            for p, n in parts:
                hits, calls = hit + np.cumsum(p, 0), called + np.cumsum(p + n, 0)
                if len(p):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        part += np.where(p > 0, p * hits / calls, 0).sum(0)
                    hit, called = hits[-1], calls[-1]
        return one_row(offset, cell, {"part": part, "pos": all_pos, "neg": all_neg})

    return add


def _first_and_sum(cell: list[str]):
    def add(table: pa.Table) -> pa.Table:
        return one_row(table, cell, {"part": wide(table["part"]).sum(0), "pos": wide(table["pos"])[0], "neg": wide(table["neg"])[0]})

    return add


def auprc_draws(rows: DataFrame, cell: Sequence[str], b: int) -> DataFrame:
    """(cell, rep, value): average precision of every replicate; null where a class is absent."""
    cell = list(cell)
    cut = _bucketed(rows, cell)
    by = [*cell, "__bucket", "__salt"]
    sums = cut.groupBy(*by).applyInArrow(_bucket_sums(by, b), wide_schema(cut, by, ["pos", "neg", "area"]))
    names = ["hit", "called", "all_pos", "part", "all_neg"]
    above = sums.groupBy(*cell).applyInArrow(_offsets(cell, by), wide_schema(cut, by, names))
    parts = cut.groupBy(*by).cogroup(above.repartition(work_parts(rows), *by).groupBy(*by)).applyInArrow(
        _when_both(_precision_sums(cell, b), wide_schema(cut, cell, ["part", "pos", "neg"])), wide_schema(cut, cell, ["part", "pos", "neg"]))
    whole = parts.groupBy(*cell).applyInArrow(_first_and_sum(cell), wide_schema(cut, cell, ["part", "pos", "neg"]))
    value = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("part") / F.col("pos"))
    return replicates(whole, cell, ["part", "pos", "neg"]).select(*cell, "rep", value.alias("value"))


def _when_both(fn, schema: T.StructType):
    """Salted groups of a tie but the first have no offset: nothing to add."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right) if right.num_rows else empty

    return both


def _products(cell: list[str], features: list[str], b: int):
    """Sums of a task's rows, which come sorted by hash: rows of one unit share its weights, whatever their cell."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        first: dict[tuple, pa.Table] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, sums in total.items():
                yield from one_row(first[key], cell, {f: sums[k] for k, f in enumerate(features)}).to_batches()
            total.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            x = np.stack([table[f].to_numpy() for f in features], 1)
            h, m = numbers(table, "h m")
            keys, code = [()], np.zeros(len(x), "<i8")
            if cell:
                seen = table.select(cell).to_pandas().groupby(cell, sort=False, dropna=False).ngroup().to_numpy()
                at = np.unique(seen, return_index=True)[1]
                keys, code = [tuple(repr(table[c][int(k)].as_py()) for c in cell) for k in at], seen
                for key, k in zip(keys, at.tolist()):
                    first.setdefault(key, table.slice(k, 1).select(cell))
            else:
                first.setdefault((), table.slice(0, 1).select([]))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
            unit, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            sums = np.zeros((len(keys), len(features), b))
            for lo in range(0, len(starts), ROWS):
                own = starts[lo:lo + ROWS]
                rows = slice(own[0], starts[lo + ROWS] if lo + ROWS < len(starts) else len(x))
                w = poisson_weights(h[own], m[own], b)
                u, c = unit[rows] - lo, code[rows]
                if len(keys) <= DENSE:
                    side = np.zeros((len(own), len(keys), len(features)))
                    np.add.at(side, (u, c), x[rows])
                    sums += (side.reshape(len(own), -1).T @ w).reshape(sums.shape)
                else:
                    for k in np.unique(c).tolist():
                        mine = c == k
                        sums[k] += x[rows][mine].T @ w[u[mine]]
            for k, key in enumerate(keys):
                total[key] = total[key] + sums[k] if key in total else sums[k]
            if len(total) > OPEN_CELLS:
                yield from flush()
        yield from flush()

    return products


def _added(cell: list[str], features: list[str]):
    def add(table: pa.Table) -> pa.Table:
        return one_row(table, cell, {f: wide(table[f]).sum(0) for f in features})

    return add


def weighted_sums(rows: DataFrame, cell: Sequence[str], features: dict[str, Column], b: int) -> DataFrame:
    """(cell, rep, features): the weighted sum of each feature in every replicate, one matrix product a block of rows."""
    cell, names = list(cell), list(features)
    flat = rows.select(*cell, *[c.cast("double").alias(f) for f, c in features.items()], "h", F.col("m").cast("long").alias("m"))
    dealt = flat.repartition(work_parts(rows), "h").sortWithinPartitions("h", "m")
    some = dealt.mapInArrow(_products(cell, names, b), wide_schema(flat, cell, names))
    return replicates(some.groupBy(*cell).applyInArrow(_added(cell, names), wide_schema(flat, cell, names)), cell, names)
