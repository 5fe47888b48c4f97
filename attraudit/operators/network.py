"""Two-layer networks for many (model, variant, target) cells trained in shared scans.

p = sigmoid(c + sum_k v_k tanh(w_k . r + b_k)) on the variant r of a representation.
A variant is a linear map of the raw row, so the hidden units of all cells of a
model are columns of one matrix product per Arrow block; the errors go back
through the same block. One scan of the rows serves one step of every cell:
train rows give loss and gradient, validation rows the loss that picks the
weights to keep. What reaches the driver is one gradient per cell and hidden unit.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, blocks
from .gram import sum_arrays
from .probes import Cell, ProbeTable, _Map, _Search, _counter

ACTIVATIONS = 1 << 21  # hidden values of a block that a task holds at once


@dataclass(frozen=True)
class Network:
    """Hidden units, weight decay alpha / (2 n) |weights|^2, scans at most, and scans without a better validation loss."""

    hidden: int = 128
    alpha: float = 1e-4
    max_rounds: int = 80
    patience: int = 10
    tol: float = 1e-5
    seed: int = 42


@dataclass
class NetworkFit:
    """Trained cells: units on the raw row (hidden x raw row), their output weights, and the offset."""

    cells: list[Cell]
    units: list[np.ndarray]
    out: list[np.ndarray]
    offset: list[float]
    rounds: list[int]
    loss: list[float] = field(default_factory=list)  # mean, on validation rows if there are any


def _usable(b_y: np.ndarray, f: np.ndarray, needs: Sequence[Sequence[int]]) -> np.ndarray:
    ok = ~np.isnan(b_y)
    for j, need in enumerate(needs):
        if need:
            ok[:, j] &= ~np.isnan(f[:, need]).any(1)
    return ok


def _hidden(z: np.ndarray, u: np.ndarray, cells: int) -> np.ndarray:
    """(rows, cells, hidden) activations; u stacks the units of each cell."""
    return np.tanh(z @ u.T).reshape(len(z), cells, -1)


def _evaluate(table: ProbeTable, rows: DataFrame, cells: Sequence[Cell], units, outs, offsets, fit_on: str) -> dict[int, dict]:
    """Train loss, its gradient, and validation loss of every cell: one scan."""
    plan = table._plan(cells)
    for p in plan.values():
        at = p["cells"]
        p["u"], p["v"], p["c"] = np.vstack([units[i] for i in at]), np.array([outs[i] for i in at]), np.array([offsets[i] for i in at])
    shared, feat, counts = rows.sparkSession.sparkContext.broadcast(plan), table._featurize(), _counter(len(table.targets))
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("unit", T.IntegerType()), T.StructField("n", T.DoubleType()),
        T.StructField("g", T.ArrayType(T.DoubleType())),
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            train = np.asarray(batch.column("split").to_pylist(), dtype=object) == fit_on
            for b in blocks(batch):
                p = shared.value.get(b.model)
                if p is None:
                    continue
                k, h = p["v"].shape
                step = max(1, ACTIVATIONS // (k * h))
                known, hits = counts(b, p)
                for lo in range(0, len(b.at), step):
                    s = slice(lo, lo + step)
                    x, f, n, y = feat(b.model, b.x[s], b.f[s]), b.f[s], known[s], hits[s]
                    z = np.hstack([x, np.nan_to_num(f), np.ones((len(x), 1))])
                    mine = train[b.at[s]][:, None]
                    act = _hidden(z, p["u"], k)
                    logit = np.einsum("nkh,kh->nk", act, p["v"]) + p["c"]
                    loss = n * np.logaddexp(0, logit) - y * logit
                    miss = mine * (n * (0.5 * (1 + np.tanh(0.5 * logit))) - y)
                    g_out = np.einsum("nkh,nk->kh", act, miss)
                    act *= act
                    np.subtract(1, act, out=act)
                    act *= miss[:, :, None] * p["v"]
                    g_unit = act.reshape(len(z), -1).T @ z
                    head = np.array([(loss * mine).sum(0), (n * mine).sum(0), (loss * ~mine).sum(0), (n * ~mine).sum(0), miss.sum(0)]).T
                    part = (g_unit, g_out, head)
                    total[b.model] = tuple(a + c for a, c in zip(total[b.model], part)) if b.model in total else part
        for m, (g_unit, g_out, head) in total.items():
            at = np.array(shared.value[m]["cells"], np.int32)
            k, h = g_out.shape
            frame = pd.DataFrame({
                "cell": np.concatenate([np.repeat(at, h), at]), "unit": np.concatenate([np.tile(np.arange(h), k), np.full(k, -1)]).astype(np.int32),
                "n": np.concatenate([g_out.ravel(), head[:, 0]]), "g": [*g_unit, *head[:, 1:]],
            })
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    got: dict[int, dict] = {}
    for r in sum_arrays(rows.mapInArrow(partial, schema), ["cell", "unit"]).collect():
        got.setdefault(r["cell"], {})[r["unit"]] = (r["n"], np.array(r["g"]))
    shared.unpersist()
    out = {}
    for i, by_unit in got.items():
        train_loss, (n, val_loss, n_val, g_offset) = by_unit.pop(-1)
        out[i] = {
            "loss": train_loss, "n": n, "val": val_loss, "n_val": n_val, "g_offset": g_offset,
            "g_units": np.array([by_unit[k][1] for k in range(len(by_unit))]), "g_out": np.array([by_unit[k][0] for k in range(len(by_unit))]),
        }
    return out


class _Descent(_Search):
    """Step search whose curvature comes from the last step alone."""

    def __init__(self, theta: np.ndarray):
        super().__init__(theta, self._scaled)

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return g / max(1.0, float(np.linalg.norm(g)))
        _, y, rho = self.pairs[-1]
        return g / (rho * (y @ y))


def unpack(theta: np.ndarray, mp: _Map, hidden: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Flat weights of a cell to its units on the raw row, output weights and offset."""
    w = theta[: hidden * (mp.size + 1)].reshape(hidden, -1)
    return np.array([mp.forward(row) for row in w]), theta[hidden * (mp.size + 1):-1], float(theta[-1])


def start_weights(size: int, net: Network, share: float) -> np.ndarray:
    """Uniform weights scaled by the widths of both layers, the same for every cell of a width."""
    rng = np.random.default_rng([net.seed, size, net.hidden])
    w = np.zeros((net.hidden, size + 1))
    w[:, :-1] = rng.uniform(-1, 1, (net.hidden, size)) * math.sqrt(6 / (size + net.hidden))
    v = rng.uniform(-1, 1, net.hidden) * math.sqrt(6 / (net.hidden + 1))
    return np.concatenate([w.ravel(), v, [math.log(share / (1 - share))]])


def fit_network(table: ProbeTable, cells: Sequence[Cell], net: Network = Network(), fit_on: str = "train", check_on: str = "val") -> NetworkFit:
    """Networks of all cells; each keeps the weights of its lowest loss on `check_on` rows.

    A cell leaves the scans when its gradient vanishes, when `patience` steps in a
    row haven't lowered that loss, or after `max_rounds` scans. Without `check_on`
    rows the last weights stay. A cell without train rows keeps its start weights.
    """
    cells, h = list(cells), net.hidden
    if not cells:
        return NetworkFit([], [], [], [], [])
    table._need_moments([(), *[x.variant.needs for x in cells]])
    counts, needs = table.counts(cells)
    got = {r["model"]: r for r in counts.where(F.col("split") == fit_on).collect()}
    maps = [table._map(x.model, x.variant) for x in cells]
    searches = []
    for x, mp in zip(cells, maps):
        i, r = needs.index((x.variant.needs, x.target)), got.get(x.model)
        n, p = (r[f"n{i}"], r[f"p{i}"]) if r else (0, 0)
        searches.append(_Descent(start_weights(mp.size, net, (p + 0.5) / (n + 1.0))))
    rows = table.groups.where(F.col("split").isin(fit_on, check_on)).select("model", "x", "f", "y", "split")
    best = [(math.inf, s.theta) for s in searches]
    stale, gone = [0] * len(cells), [False] * len(cells)
    for _ in range(net.max_rounds):
        live = [i for i, s in enumerate(searches) if not (s.done or gone[i])]
        if not live:
            break
        trial = {i: searches[i].trial() for i in live}
        parts = [unpack(trial[i], maps[i], h) for i in live]
        seen = _evaluate(table, rows, [cells[i] for i in live], *zip(*parts), fit_on)
        for j, i in enumerate(live):
            s, e = searches[i], seen.get(j)
            if e is None or not e["n"]:
                gone[i] = True
                continue
            theta, n = trial[i], e["n"]
            decay = theta.copy()
            decay[: h * (maps[i].size + 1)].reshape(h, -1)[:, -1] = 0.0
            decay[-1] = 0.0
            g = np.concatenate([np.array([maps[i].back(row) for row in e["g_units"]]).ravel(), e["g_out"], [e["g_offset"]]])
            s.update((e["loss"] + 0.5 * net.alpha * (decay @ decay)) / n, (g + net.alpha * decay) / n, net.tol)
            if not np.array_equal(s.theta, theta):
                continue  # the step was too long and is tried again, shorter
            check = e["val"] / e["n_val"] if e["n_val"] else e["loss"] / n
            if check < best[i][0]:
                best[i], stale[i] = (check, theta), 0
            else:
                stale[i] += 1
                gone[i] = stale[i] >= net.patience
    ends = [unpack(theta, mp, h) for (_, theta), mp in zip(best, maps)]
    return NetworkFit(cells, [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends], [s.rounds for s in searches], [b[0] for b in best])


def network_group_scores(table: ProbeTable, fitted: NetworkFit, splits: Sequence[str] = ("test",)) -> DataFrame:
    """Scores of groups of units with their weights, in the layout of `ProbeTable.group_scores`."""
    plan = table._plan(fitted.cells)
    for p in plan.values():
        at = p["cells"]
        p["u"], p["v"], p["c"] = np.vstack([fitted.units[i] for i in at]), np.array([fitted.out[i] for i in at]), np.array([fitted.offset[i] for i in at])
        p["name"] = [(fitted.cells[i].variant.name, fitted.cells[i].target) for i in at]
    feat = table._featurize()

    def prob(b: Block, p: dict) -> np.ndarray:
        k, h = p["v"].shape
        step, out = max(1, ACTIVATIONS // (k * h)), []
        for lo in range(0, len(b.at), step):
            x, f = feat(b.model, b.x[lo : lo + step], b.f[lo : lo + step]), b.f[lo : lo + step]
            act = _hidden(np.hstack([x, np.nan_to_num(f), np.ones((len(x), 1))]), p["u"], k)
            out.append(0.5 * (1 + np.tanh(0.5 * (np.einsum("nkh,kh->nk", act, p["v"]) + p["c"]))))
        return np.vstack(out)

    return table.scored_groups(plan, prob, splits)


def score_network(table: ProbeTable, fitted: NetworkFit, splits: Sequence[str] = ("test",)) -> DataFrame:
    """Long score table (model, variant, target, unit_id, split, keep..., y, p) in the layout of the linear probes."""
    plan = table._plan(fitted.cells)
    for p in plan.values():
        at = p["cells"]
        p["u"], p["v"], p["c"] = np.vstack([fitted.units[i] for i in at]), np.array([fitted.out[i] for i in at]), np.array([fitted.offset[i] for i in at])
        p["name"] = [(fitted.cells[i].variant.name, fitted.cells[i].target) for i in at]
    shared, feat = table.rows.sparkSession.sparkContext.broadcast(plan), table._featurize()
    kept = ["unit_id", "split", *table.keep]
    base = table.rows.where(F.col("split").isin(*splits)).select("model", "x", "f", "y", *kept)
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("model", "variant", "target")] + base.select(*kept).schema.fields
        + [T.StructField("y", T.IntegerType()), T.StructField("p", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                p = shared.value.get(b.model)
                if p is None:
                    continue
                k, h = p["v"].shape
                step = max(1, ACTIVATIONS // (k * h))
                for lo in range(0, len(b.at), step):
                    s = slice(lo, lo + step)
                    x, f, y = feat(b.model, b.x[s], b.f[s]), b.f[s], b.y[s][:, p["target"]]
                    ok = _usable(y, f, p["need"])
                    act = _hidden(np.hstack([x, np.nan_to_num(f), np.ones((len(x), 1))]), p["u"], k)
                    prob = 0.5 * (1 + np.tanh(0.5 * (np.einsum("nkh,kh->nk", act, p["v"]) + p["c"])))
                    for j, (variant, target) in enumerate(p["name"]):
                        at = np.flatnonzero(ok[:, j])
                        if not len(at):
                            continue
                        cols = [pa.repeat(pa.scalar(v), len(at)) for v in (b.model, variant, target)]
                        cols += [batch.column(n).take(pa.array(b.at[s][at])) for n in kept]
                        cols += [pa.array(y[at, j].astype(np.int32)), pa.array(prob[at, j])]
                        yield pa.RecordBatch.from_arrays(cols, names=["model", "variant", "target", *kept, "y", "p"])

    return base.mapInArrow(run, schema)
