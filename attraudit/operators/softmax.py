"""Multinomial probes for many (model, variant, target) cells trained in shared scans.

A target holds class codes 0 .. K-1; other values and nulls leave the row out. As
in `probes`, every variant is a linear map of the raw row: all classes of all
cells of a model are columns of one matrix product per Arrow block, and one scan
serves one optimizer step of every cell. Only one gradient per (cell, class)
reaches the driver.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks
from .gram import sum_arrays
from .probes import Cell, ProbeTable, _Search


@dataclass
class SoftmaxFit:
    """Trained cells: per cell a (classes x raw row) coefficient matrix."""

    cells: list[Cell]
    n_classes: int
    coef: list[np.ndarray]
    theta: list[np.ndarray]
    rounds: list[int] = field(default_factory=list)


def _usable(y: np.ndarray, f: np.ndarray, needs: Sequence[Sequence[int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count for which cell, and their class codes (0 where they don't)."""
    ok = (y >= 0) & (y < k) & (y == np.floor(y))
    for j, need in enumerate(needs):
        if need:
            ok[:, j] &= ~np.isnan(f[:, need]).any(1)
    return ok, np.where(ok, y, 0).astype(np.int64)


def _log_softmax(z: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """(rows, cells, classes) log probabilities; u stacks the classes of each cell."""
    logit = (z @ u.T).reshape(len(z), -1, k)
    logit -= logit.max(2, keepdims=True)
    return logit - np.log(np.exp(logit).sum(2, keepdims=True))


def class_counts(table: ProbeTable, cells: Sequence[Cell], n_classes: int) -> list[np.ndarray]:
    """Train rows of each class, one vector per cell."""
    needs = list(dict.fromkeys((c.variant.needs, c.target) for c in cells))
    aggs = []
    for i, (need, target) in enumerate(needs):
        ok = F.lit(True)
        for c in need:
            ok = ok & F.col("f")[table.at[c]].isNotNull()
        y = F.col("y")[table.targets.index(target)]
        aggs.append(F.array(*[F.count_if(ok & (y == k)) for k in range(n_classes)]).alias(f"n{i}"))
    got = {r["model"]: r for r in table.train.groupBy("model").agg(*aggs).collect()}
    zero = [0] * n_classes
    return [np.array(got[c.model][f"n{needs.index((c.variant.needs, c.target))}"] if c.model in got else zero, float) for c in cells]


def _evaluate(table: ProbeTable, cells: Sequence[Cell], coefs: Sequence[np.ndarray], k: int) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and raw-row gradients (classes x raw row) of every cell: one scan of the train rows."""
    plan = table._plan(cells)
    for p in plan.values():
        p["u"] = np.vstack([coefs[i] for i in p["cells"]])
    shared, feat = table.rows.sparkSession.sparkContext.broadcast(plan), table._featurize()
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("cls", T.IntegerType()), T.StructField("n", T.DoubleType()),
        T.StructField("g", T.ArrayType(T.DoubleType())),
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for b in blocks(batch):
                p = shared.value.get(b.model)
                if p is None:
                    continue
                z = np.hstack([feat(b.model, b.x, b.f), np.nan_to_num(b.f), np.ones((len(b.at), 1))])
                ok, code = _usable(b.y[:, p["target"]], b.f, p["need"], k)
                logp = _log_softmax(z, p["u"], k)
                true = np.take_along_axis(logp, code[:, :, None], 2)[:, :, 0]
                loss = np.zeros((logp.shape[1], k))
                loss[:, 0] = -(ok * true).sum(0)
                miss = np.exp(logp)
                np.put_along_axis(miss, code[:, :, None], np.take_along_axis(miss, code[:, :, None], 2) - 1, 2)
                miss *= ok[:, :, None]
                part = np.hstack([loss.reshape(-1, 1), miss.reshape(len(z), -1).T @ z])
                total[b.model] = total[b.model] + part if b.model in total else part
        for m, g in total.items():
            at = np.array(shared.value[m]["cells"], np.int32)
            frame = pd.DataFrame({"cell": np.repeat(at, k), "cls": np.tile(np.arange(k, dtype=np.int32), len(at)), "n": g[:, 0], "g": list(g[:, 1:])})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    sums = sum_arrays(table.train.select("model", "x", "f", "y").mapInArrow(partial, schema), ["cell", "cls"]).collect()
    shared.unpersist()
    loss: dict[int, float] = {}
    grad: dict[int, list] = {}
    for r in sums:
        loss[r["cell"]] = loss.get(r["cell"], 0.0) + r["n"]
        grad.setdefault(r["cell"], [None] * k)[r["cls"]] = r["g"]
    return {i: (loss[i], np.array(grad[i])) for i in loss}


def fit_softmax(
    table: ProbeTable, cells: Sequence[Cell], n_classes: int, c: float = 1.0, tol: float = 1e-6, max_rounds: int = 1000
) -> SoftmaxFit:
    """L2 multinomial probes 0.5 |W|^2 - C sum(log p of the true class), free intercepts.

    A class without train rows keeps a vanishing probability. Cells that have
    converged leave the scan; one that hasn't after `max_rounds` is an error.
    """
    cells = list(cells)
    if not cells:
        return SoftmaxFit([], n_classes, [], [])
    table._need_moments([(), *[x.variant.needs for x in cells]])
    maps = [table._map(x.model, x.variant) for x in cells]
    searches, scale = [], []
    for x, mp, n in zip(cells, maps, class_counts(table, cells, n_classes)):
        share = np.maximum(n / max(n.sum(), 1.0), 1e-6)
        share = share / share.sum()
        per_row = 1.0 / max(c * n.sum(), 1e-300)
        theta = np.zeros((n_classes, mp.size + 1))
        theta[:, -1] = np.log(share)
        by_class = [table._preconditioner(table.spectrum(x.model), mp, s * (1 - s), per_row) for s in share]

        def precondition(g: np.ndarray, by_class=by_class) -> np.ndarray:
            return np.concatenate([p(row) for p, row in zip(by_class, g.reshape(n_classes, -1))])

        searches.append(_Search(theta.ravel(), precondition))
        scale.append(per_row)
    for _ in range(max_rounds):
        live = [i for i, s in enumerate(searches) if not s.done]
        if not live:
            break
        trial = {i: searches[i].trial().reshape(n_classes, -1) for i in live}
        coefs = [np.array([maps[i].forward(t) for t in trial[i]]) for i in live]
        got = _evaluate(table, [cells[i] for i in live], coefs, n_classes)
        for j, i in enumerate(live):
            if j not in got:
                searches[i].done = True
                continue
            loss, g = got[j]
            w = trial[i][:, :-1]
            f = scale[i] * (c * loss + 0.5 * (w * w).sum())
            grad = np.array([c * maps[i].back(row) for row in g])
            grad[:, :-1] += w
            searches[i].update(f, (scale[i] * grad).ravel(), tol)
    open_cells = [x for x, s in zip(cells, searches) if not s.done]
    if open_cells:
        raise RuntimeError(f"{len(open_cells)} cells did not converge in {max_rounds} rounds, the first is {open_cells[0]}")
    thetas = [s.theta.reshape(n_classes, -1) for s in searches]
    return SoftmaxFit(cells, n_classes, [np.array([m.forward(t) for t in th]) for m, th in zip(maps, thetas)], thetas, [s.rounds for s in searches])


def score_softmax(table: ProbeTable, fitted: SoftmaxFit, splits: Sequence[str] = ("test",)) -> DataFrame:
    """Long score table (model, variant, target, unit_id, split, keep..., y, p): p lists the class probabilities."""
    k, plan = fitted.n_classes, table._plan(fitted.cells)
    for p in plan.values():
        p["u"] = np.vstack([fitted.coef[i] for i in p["cells"]])
        p["name"] = [(fitted.cells[i].variant.name, fitted.cells[i].target) for i in p["cells"]]
    shared, feat = table.rows.sparkSession.sparkContext.broadcast(plan), table._featurize()
    kept = ["unit_id", "split", *table.keep]
    base = table.rows.where(F.col("split").isin(*splits)).select("model", "x", "f", "y", *kept)
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("model", "variant", "target")] + base.select(*kept).schema.fields
        + [T.StructField("y", T.IntegerType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                p = shared.value.get(b.model)
                if p is None:
                    continue
                z = np.hstack([feat(b.model, b.x, b.f), np.nan_to_num(b.f), np.ones((len(b.at), 1))])
                ok, code = _usable(b.y[:, p["target"]], b.f, p["need"], k)
                prob = np.exp(_log_softmax(z, p["u"], k))
                for j, (variant, target) in enumerate(p["name"]):
                    at = np.flatnonzero(ok[:, j])
                    if not len(at):
                        continue
                    cols = [pa.repeat(pa.scalar(v), len(at)) for v in (b.model, variant, target)]
                    cols += [batch.column(n).take(pa.array(b.at[at])) for n in kept]
                    flat = pa.array(prob[at, j].ravel())
                    cols += [pa.array(code[at, j].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), flat)]
                    yield pa.RecordBatch.from_arrays(cols, names=["model", "variant", "target", *kept, "y", "p"])

    return base.mapInArrow(run, schema)
