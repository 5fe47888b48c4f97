"""Linear probes for many (model, variant, target) cells trained in shared scans.

A cell asks how well a target is predicted from one variant of a representation:
the plain embedding, the embedding with attributes ridge-residualized out, with
directions projected out, with attributes appended, or the attributes alone.
Every variant is a linear map of the raw row [x, f, 1], so none is ever written
out: the driver folds the map into effective coefficients, the tasks compute
logits and gradients for all cells from the raw row by matrix products, and the
driver pulls the gradients back through the map. One pass over the rows serves
one optimizer step of all cells. Units with the same representation and the same
designs have the same logits, so the passes read them as one row with counts.
"""
from __future__ import annotations

import copy
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, blocks, feature_rows, row_moments, row_sums
from .gram import sum_arrays
from .running import default_buckets


@dataclass(frozen=True)
class Variant:
    """One form of a representation.

    remove: design columns residualized out by ridge with strength alpha.
    append: design columns added as features. use_x=False leaves only those.
    cohort: design columns that must be known, without being used.
    basis: per model, an orthonormal (d x k) set of directions projected out.
    """

    name: str
    remove: tuple[str, ...] = ()
    append: tuple[str, ...] = ()
    cohort: tuple[str, ...] = ()
    use_x: bool = True
    alpha: float = 1.0
    basis: dict | None = field(default=None, compare=False, hash=False)

    @property
    def needs(self) -> tuple[str, ...]:
        return tuple(sorted({*self.remove, *self.append, *self.cohort}))


BASELINE = Variant("baseline")
ROWS_A_TASK = 4096  # groups that are worth a task of their own beyond one for every core


@dataclass(frozen=True)
class Cell:
    model: str
    variant: Variant
    target: str


@dataclass(frozen=True)
class FourierMap:
    """Random Fourier features of the scaled embedding (M17): sqrt(2/m) cos(x W + b)."""

    size: int = 1500
    seed: int = 42
    gamma: float | None = None

    def draw(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, d])
        gamma = 1.0 / d if self.gamma is None else self.gamma
        return rng.normal(scale=math.sqrt(2 * gamma), size=(d, self.size)), rng.uniform(0, 2 * math.pi, self.size)


class _Map:
    """The linear map of one (model, variant): forward on coefficients, back on gradients."""

    def __init__(self, mu, sd, f_cols, variant: Variant, at: dict[str, int], mom: dict, basis):
        self.mu, self.sd, self.k = mu, sd, f_cols
        self.use_x = variant.use_x
        self.rem = [at[c] for c in variant.remove]
        self.app = [at[c] for c in variant.append]
        d = len(mu) if self.use_x else 0
        self.d = d
        self.size = d + len(self.app)
        self.q = basis
        self.x0 = np.zeros(d)
        self.w = np.zeros((len(self.rem), d))
        self.f0 = mom["f_mean"]
        if self.rem and self.use_x:
            n = mom["n"]
            i = [mom["pos"][c] for c in variant.remove]
            sx, dx = mom["x_sum"] / sd, mom["fx"][i] / sd
            dd = mom["ff"][np.ix_(i, i)] - np.outer(mom["f_sum"][i], mom["f_sum"][i]) / n
            cross = dx - np.outer(mom["f_sum"][i], sx) / n
            system = dd + variant.alpha * np.eye(len(i))
            self.w = np.linalg.solve(system, cross) if variant.alpha > 0 else np.linalg.pinv(system) @ cross
            self.x0 = sx / n
        self.rem_mean = np.array([mom["f_mean"][c] for c in variant.remove])
        self.app_mean = np.array([mom["f_mean"][c] for c in variant.append])
        j = [mom["pos"][c] for c in variant.append]
        n = max(mom["n"], 1)
        self.app_var = np.diag(mom["ff"])[j] / n - (mom["f_sum"][j] / n) ** 2 if j else np.zeros(0)

    def forward(self, theta: np.ndarray) -> np.ndarray:
        """theta = [w_x, w_append, b] to coefficients on [x, f, 1]."""
        wx, wa, b = theta[: self.d], theta[self.d : self.size], theta[-1]
        out_f = np.zeros(self.k)
        out_x = np.zeros(len(self.mu))
        if self.use_x:
            if self.q is not None and self.q.size:
                wx = wx - self.q @ (self.q.T @ wx)
            out_x = wx / self.sd
            b = b - wx @ self.x0 - out_x @ self.mu
            if self.rem:
                v = self.w @ wx
                out_f[self.rem] -= v
                b = b + v @ self.rem_mean
        if self.app:
            out_f[self.app] += wa
            b = b - wa @ self.app_mean
        return np.concatenate([out_x, out_f, [b]])

    def back(self, g: np.ndarray) -> np.ndarray:
        """Gradient on [x, f, 1] to the gradient on theta."""
        d = len(self.mu)
        gx, gf, g1 = g[:d], g[d : d + self.k], g[-1]
        parts = []
        if self.use_x:
            r = (gx - self.mu * g1) / self.sd - self.x0 * g1
            if self.rem:
                r = r - self.w.T @ (gf[self.rem] - self.rem_mean * g1)
            if self.q is not None and self.q.size:
                r = r - self.q @ (self.q.T @ r)
            parts.append(r)
        if self.app:
            parts.append(gf[self.app] - self.app_mean * g1)
        return np.concatenate([*parts, [g1]])


class _Search:
    """L-BFGS with a fixed preconditioner and step halving for one cell."""

    MEMORY = 8

    def __init__(self, theta, precondition):
        self.theta, self.pre = theta, precondition
        self.f = self.g = self.step = None
        self.t, self.pairs, self.done, self.rounds = 1.0, [], False, 0

    def direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            q -= a * y
            kept.append(a)
        q = self.pre(q)
        for (s, y, rho), a in zip(self.pairs, reversed(kept)):
            q += s * (a - rho * (y @ q))
        return -q

    def trial(self) -> np.ndarray:
        return self.theta if self.step is None else self.theta + self.t * self.step

    def update(self, f: float, g: np.ndarray, tol: float) -> None:
        self.rounds += 1
        if self.step is not None:
            slope = self.g @ self.step
            if not (f <= self.f + 1e-4 * self.t * slope + 1e-12 * abs(self.f)):
                self.t *= 0.5
                self.done = self.t < 1e-8
                return
            s, y = self.t * self.step, g - self.g
            if s @ y > 1e-14:
                self.pairs = (self.pairs + [(s, y, 1.0 / (s @ y))])[-self.MEMORY:]
            self.theta = self.theta + s
        self.f, self.g, self.t = f, g, 1.0
        if np.max(np.abs(g)) <= tol:
            self.done = True
            return
        self.step = self.direction()
        if self.g @ self.step >= 0:
            self.pairs, self.step = [], -self.pre(self.g)


def _counter(targets: int):
    """Function (block, plan) -> units with a known label and sums of the labels per cell, zero where a needed design is missing.

    Blocks of groups hold these numbers; in blocks of single units each row counts once.
    """
    def counts(b: Block, p: dict) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(p["target"], int)
        if b.y.shape[1] == targets:
            known, hits = (~np.isnan(b.y[:, at])).astype(float), np.nan_to_num(b.y[:, at])
        else:
            known, hits = b.y[:, 1 + at], b.y[:, 1 + targets + at]
        for j, need in enumerate(p["need"]):
            if need:
                gone = np.isnan(b.f[:, need]).any(1)
                known[gone, j] = hits[gone, j] = 0.0
        return known, hits

    return counts


@dataclass
class Fitted:
    """Trained cells: effective coefficients on the raw row, and training counts."""

    cells: list[Cell]
    coef: list[np.ndarray]
    theta: list[np.ndarray]
    rounds: list[int]
    gradient: list[float] = field(default_factory=list)  # largest component at the end; above tol where rounding stopped the search

    def only(self, cells: Sequence[Cell]) -> "Fitted":
        """The part of these cells, in their order; cells that are not there are left out."""
        at = [self.cells.index(c) for c in cells if c in self.cells]
        return Fitted(*[[v[i] for i in at] for v in self._parts()])

    def joined(self, other: "Fitted") -> "Fitted":
        return Fitted(*[[*a, *b] for a, b in zip(self._parts(), other._parts())])

    def _parts(self) -> tuple[list, ...]:
        return self.cells, self.coef, self.theta, self.rounds, self.gradient


class ProbeTable:
    """Embeddings joined to split, designs and targets, cached for the optimizer's scans.

    Use as a context manager so the cache is released:

        with ProbeTable(embeddings, units, designs, targets) as t:
            fitted = t.fit(t.cells([BASELINE, Variant("age", remove=("age",))], ["edema"]))
            scores = t.score(fitted)
    """

    def __init__(
        self, embeddings: DataFrame, units: DataFrame, designs: Sequence[str], targets: Sequence[str],
        split: str = "split", keep: Sequence[str] = (), feature_map: FourierMap | None = None,
        before: Variant | None = None, fit_on: str = "train",
    ):
        """`feature_map` expands the scaled embedding, or its residual after `before`."""
        self.designs, self.targets, self.keep = list(designs), list(targets), list(keep)
        self.at = {c: i for i, c in enumerate(self.designs)}
        self.rows = feature_rows(embeddings, units, self.designs, self.targets, split, tuple(keep)).persist()
        self.train = self.rows.where(F.col("split") == fit_on)
        self.map, self.before = None, before
        self._scale: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._middle: dict[str, np.ndarray] = {}  # means of the designs, about which their products are taken
        self._moments: dict = {}
        self._fourier: dict[str, tuple] = {}
        self._shared = None
        self._spectra: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._groups: DataFrame | None = None
        self._counted: dict[tuple, dict] = {}  # also of mapped tables: they have the same rows
        self._fit_on = fit_on
        self._fit_scaler()
        if feature_map is not None:
            self._expand(feature_map)

    def __enter__(self) -> "ProbeTable":
        return self

    def __exit__(self, *_exc) -> None:
        self.close()

    def close(self) -> None:
        self.rows.unpersist()
        if self._groups is not None:
            self._groups.unpersist()

    @property
    def groups(self) -> DataFrame:
        """Units of one split that share representation and designs as one row (model, split, x, f, y).

        y holds the number of units, then of each target the units with a known
        label, then the sums of the labels.
        """
        if self._groups is None:
            y = [F.get("y", F.lit(i)) for i in range(len(self.targets))]
            sums = [F.count(F.lit(1)), *[F.count(c) for c in y], *[F.coalesce(F.sum(c), F.lit(0.0)) for c in y]]
            names = [f"__y{i}" for i in range(len(sums))]
            grouped = self.rows.groupBy("model", "split", "x", "f").agg(*[c.cast("double").alias(n) for c, n in zip(sums, names)])
            grouped = grouped.select("model", "split", "x", "f", F.array(*names).alias("y")).persist()
            cores = self.rows.sparkSession.sparkContext.defaultParallelism
            self._n_groups = grouped.count()
            parts = max(cores, min(default_buckets(self.rows), self._n_groups // ROWS_A_TASK))
            self._groups = grouped.repartition(parts).persist()  # dealt by number: the work far outweighs the rows
            self._groups.count()
            grouped.unpersist()
        return self._groups

    def mapped(self, feature_map: FourierMap, before: Variant | None = None) -> "ProbeTable":
        """The same rows, cached once, under a feature map; closed with this table."""
        self.groups
        t = copy.copy(self)
        t.before, t._scale, t._moments, t._fourier, t._shared, t._spectra = before, dict(self._scale), dict(self._moments), {}, None, {}
        t._expand(feature_map)
        return t

    @property
    def train_groups(self) -> DataFrame:
        return self.groups.where(F.col("split") == self._fit_on)

    # ---- first passes: scaler, counts, cross products ----------------------

    def _fit_scaler(self) -> None:
        """Mean and population deviation per model on the train rows; zero deviation becomes 1 (M3)."""
        def sums(b: Block) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
            known, n = ~np.isnan(b.f), b.y[:, 0]
            return b.x, 0, np.concatenate([n @ known, n @ np.where(known, b.f, 0.0)]), n

        for m, t in row_moments(self.train_groups, sums).items():
            sd = np.sqrt(t.squares / t.n)
            self._scale[m] = (t.mean, np.where(sd > 1e-12 * (1 + np.abs(t.mean)), sd, 1.0))
            n, s = t.extra.reshape(2, -1)
            self._middle[m] = s / np.maximum(n, 1)

    def _expand(self, feature_map: FourierMap) -> None:
        """Replace the features by their Fourier expansion."""
        maps = {}
        if self.before is not None:
            self._need_moments([(), self.before.needs])
            maps = {m: self._map(m, self.before) for m in self.models}
        for m, (mu, sd) in list(self._scale.items()):
            mp = maps.get(m)  # as plain values: tasks unpickle a broadcast without this package on their path
            self._fourier[m] = (mu, sd, *feature_map.draw(len(mu)), None if mp is None else (mp.x0, mp.rem, mp.rem_mean, mp.w))
            self._scale[m] = (np.zeros(feature_map.size), np.ones(feature_map.size))
        self._moments, self._spectra, self.map = {}, {}, feature_map

    @property
    def models(self) -> list[str]:
        return sorted(self._scale)

    def _featurize(self):
        """Function (model, x, f) -> feature matrix used inside the tasks."""
        if self.map is None:
            return lambda model, x, f: x
        if self._shared is None:
            self._shared = self.rows.sparkSession.sparkContext.broadcast(self._fourier)
        shared, size = self._shared, self.map.size

        def apply(model, x, f):
            mu, sd, w, b, first = shared.value[model]
            z = (x - mu) / sd
            if first is not None:
                x0, rem, mean, lift = first
                z = z - x0 - (np.nan_to_num(f[:, rem]) - mean) @ lift
            return math.sqrt(2.0 / size) * np.cos(z @ w + b)

        return apply

    def _need_moments(self, needs: Sequence[tuple[str, ...]]) -> None:
        """Cross products of [x] with [1, f], about the train means of both, over the rows where the needed designs are known."""
        todo = [s for s in dict.fromkeys(needs) if s not in self._moments]
        if not todo:
            return
        at, feat = self.at, self._featurize()
        sets = [[at[c] for c in s] for s in todo]
        with_xx = "xx" not in self._moments
        about = {m: (mu, self._middle[m]) for m, (mu, _) in self._scale.items()}

        def cross(b: Block) -> np.ndarray:
            mu, middle = about[b.model]
            x = feat(b.model, b.x, b.f) - mu
            side = []
            for cols in sets:
                f = b.f[:, cols] - middle[cols]
                known = ~np.isnan(f).any(1) if cols else np.ones(len(x), bool)
                side.append(known[:, None].astype(float))
                side.append(np.where(known[:, None], np.nan_to_num(f), 0.0))
            s = np.hstack(side)
            left = np.hstack([s, x]) if with_xx else s
            return (left * b.y[:, :1]).T @ np.hstack([x, s])

        # a task hands on a matrix as large as width^2: it gets more rows as that has lines
        rows, width = self.train_groups, max(len(mu) for mu, _ in self._scale.values())
        for m, g in row_sums(rows.coalesce(max(1, self._n_groups // (2 * width))), cross).items():
            width = sum(1 + len(s) for s in sets)
            d = g.shape[1] - width
            if with_xx:
                self._moments.setdefault("xx", {})[m] = g[width:, :d]
            start = 0
            for key, cols in zip(todo, sets):
                k = len(cols)
                one, cs = start, slice(start + 1, start + 1 + k)
                n = g[one, d + one]
                f_sum = g[one, d + start + 1 : d + start + 1 + k]
                mean = {c: self._middle[m][at[c]] + (f_sum[j] / n if n else 0.0) for j, c in enumerate(key)}
                self._moments.setdefault(key, {})[m] = {
                    "n": n, "x_sum": g[one, :d], "f_sum": f_sum, "fx": g[cs, :d],
                    "ff": g[cs, d + start + 1 : d + start + 1 + k], "f_mean": mean, "pos": {c: j for j, c in enumerate(key)},
                }
                start += 1 + k

    def second_moment(self, model: str) -> np.ndarray:
        """Train correlation-scale second moment of the scaled features."""
        self._need_moments([()])
        _, sd = self._scale[model]
        n = self._moments[()][model]["n"]
        return self._moments["xx"][model] / n / np.outer(sd, sd)

    def spectrum(self, model: str) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of the second moment, kept for all fits of the table."""
        if model not in self._spectra:
            self._spectra[model] = np.linalg.eigh(self.second_moment(model))
        return self._spectra[model]

    def residual_r2(self, variant: Variant) -> dict[str, float]:
        """Share of the embedding variance that the removed designs explain, all dimensions pooled (A10, M5)."""
        self._need_moments([variant.needs])
        out = {}
        for m in self.models:
            mp, mom = self._map(m, variant), self._moments[variant.needs][m]
            i = [mom["pos"][c] for c in variant.remove]
            n, (mu, sd) = mom["n"], self._scale[m]
            dd = mom["ff"][np.ix_(i, i)] - np.outer(mom["f_sum"][i], mom["f_sum"][i]) / n
            dx = (mom["fx"][i] - np.outer(mom["f_sum"][i], mom["x_sum"]) / n) / sd
            # raw-scale sums: undo the division by sd
            total = float(np.trace(self.second_moment(m) * np.outer(sd, sd)) * self._moments[()][m]["n"])
            gain = (2 * (mp.w * dx) - mp.w * (dd @ mp.w)).sum(0) * sd * sd
            out[m] = float(gain.sum() / total)
        return out

    # ---- training ----------------------------------------------------------

    def _map(self, model: str, v: Variant) -> _Map:
        mu, sd = self._scale[model]
        basis = v.basis.get(model) if v.basis else None
        return _Map(mu, sd, len(self.designs), v, self.at, self._moments[v.needs][model], basis)

    def cells(self, variants: Sequence[Variant], targets: Sequence[str], models: Sequence[str] | None = None) -> list[Cell]:
        return [Cell(m, v, t) for m in (models or self.models) for v in variants for t in targets]

    def counts(self, cells: Sequence[Cell]) -> DataFrame:
        """Valid and positive rows per cell and split, for the guards."""
        needs = list(dict.fromkeys((c.variant.needs, c.target) for c in cells))
        aggs = []
        for i, (need, target) in enumerate(needs):
            y = F.col("y")[self.targets.index(target)]
            ok = y.isNotNull()
            for c in need:
                ok = ok & F.col("f")[self.at[c]].isNotNull()
            aggs += [F.count_if(ok).alias(f"n{i}"), F.count_if(ok & (y == 1)).alias(f"p{i}")]
        return self.rows.groupBy("model", "split").agg(*aggs), needs

    def _count(self, cells: Sequence[Cell]) -> dict[tuple, dict]:
        """Valid and positive rows as {(needs, target): {(model, split): (n, p)}}; the rows are read for new keys only."""
        new = [c for c in cells if (c.variant.needs, c.target) not in self._counted]
        if new:
            table, needs = self.counts(new)
            got = table.collect()
            for i, key in enumerate(needs):
                self._counted[key] = {(r["model"], r["split"]): (r[f"n{i}"], r[f"p{i}"]) for r in got}
        return self._counted

    def guard(self, cells: Sequence[Cell], min_train=50, min_test=50, min_pos=10, min_neg=0, test: str = "test", train: str = "train") -> list[Cell]:
        """Cells with enough rows and positives in both splits."""
        counted = self._count(cells)
        kept = []
        for c in cells:
            got = counted[c.variant.needs, c.target]
            ok = True
            for split, least in ((train, min_train), (test, min_test)):
                n, p = got.get((c.model, split), (0, 0))
                ok = ok and n >= least and p >= min_pos and n - p >= max(min_neg, 1)
            if ok:
                kept.append(c)
        return kept

    def _plan(self, cells: Sequence[Cell]) -> dict:
        """Per model: indices of the cells, their target columns and their row conditions."""
        plan: dict = {}
        for i, c in enumerate(cells):
            p = plan.setdefault(c.model, {"cells": [], "target": [], "need": []})
            p["cells"].append(i)
            p["target"].append(self.targets.index(c.target))
            p["need"].append([self.at[n] for n in c.variant.needs])
        return plan

    def _evaluate(self, cells: Sequence[Cell], coefs: Sequence[np.ndarray], pos_weight: Sequence[float]):
        """Loss and raw-row gradient of every cell: one scan of the groups of train rows."""
        sc = self.rows.sparkSession.sparkContext
        plan = self._plan(cells)
        for m, p in plan.items():
            p["u"] = np.array([coefs[i] for i in p["cells"]])
            p["pw"] = np.array([pos_weight[i] for i in p["cells"]])
        shared, feat, counts = sc.broadcast(plan), self._featurize(), _counter(len(self.targets))
        schema = T.StructType([
            T.StructField("cell", T.IntegerType()), T.StructField("n", T.DoubleType()), T.StructField("g", T.ArrayType(T.DoubleType())),
        ])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for batch in batches:
                for b in blocks(batch):
                    p = shared.value.get(b.model)
                    if p is None:
                        continue
                    x = feat(b.model, b.x, b.f)
                    z = np.hstack([x, np.nan_to_num(b.f), np.ones((len(x), 1))])
                    known, hits = counts(b, p)
                    hits = hits * p["pw"]
                    w = known + hits * (1 - 1 / p["pw"])
                    logit = z @ p["u"].T
                    loss = (w * np.logaddexp(0, logit) - hits * logit).sum(0)
                    grad = (w * (0.5 * (1 + np.tanh(0.5 * logit))) - hits).T @ z
                    part = np.hstack([loss[:, None], grad])
                    total[b.model] = total[b.model] + part if b.model in total else part
            for m, g in total.items():
                frame = pd.DataFrame({"cell": np.array(shared.value[m]["cells"], np.int32), "n": g[:, 0], "g": list(g[:, 1:])})
                yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("cell", pa.int32()), ("n", pa.float64()), ("g", pa.list_(pa.float64()))]), preserve_index=False)

        sums = sum_arrays(self.train_groups.select("model", "x", "f", "y").mapInArrow(partial, schema), ["cell"]).collect()
        shared.unpersist()
        return {r["cell"]: (r["n"], np.array(r["g"])) for r in sums}

    def fit(
        self, cells: Sequence[Cell], c: float = 1.0, balanced: bool = False, tol: float = 1e-6, max_rounds: int = 1000,
        start: Sequence[np.ndarray | None] | None = None,
    ) -> Fitted:
        """L2 logistic probes 0.5 |w|^2 + C sum(loss) with free intercepts.

        Cells that have converged leave the scan; one that hasn't after `max_rounds`
        evaluations is an error. `balanced` weighs positives by
        negatives / positives, kept within [0.1, 10] (M24, X9). `start` gives
        coefficients to begin with, one entry per cell (None: the intercept only).
        """
        cells = list(cells)
        if not cells:
            return Fitted([], [], [], [])
        self._need_moments([(), *[x.variant.needs for x in cells]])
        counted = self._count(cells)
        maps = [self._map(x.model, x.variant) for x in cells]
        searches, scale, weight = [], [], []
        for x, mp, first in zip(cells, maps, start or [None] * len(cells)):
            n, p = counted[x.variant.needs, x.target][x.model, self._fit_on]
            pw = min(max((n - p) / p, 0.1), 10.0) if balanced and p else 1.0
            mass = n - p + pw * p
            share = min(max(pw * p / mass, 1e-6), 1 - 1e-6) if mass else 0.5
            theta = np.zeros(mp.size + 1)
            theta[-1] = math.log(share / (1 - share))
            theta = theta if first is None else np.array(first, float)
            curve = share * (1 - share)
            searches.append(_Search(theta, self._preconditioner(self.spectrum(x.model), mp, curve, 1.0 / max(c * mass, 1e-300))))
            scale.append(1.0 / max(c * mass, 1e-300))
            weight.append(pw)
        for _ in range(max_rounds):
            live = [i for i, s in enumerate(searches) if not s.done]
            if not live:
                break
            trial = {i: searches[i].trial() for i in live}
            got = self._evaluate([cells[i] for i in live], [maps[i].forward(trial[i]) for i in live], [weight[i] for i in live])
            for j, i in enumerate(live):
                if j not in got:
                    searches[i].done = True
                    continue
                loss, g = got[j]
                w = trial[i][:-1]
                f = c * scale[i] * loss + 0.5 * scale[i] * (w @ w)
                grad = c * scale[i] * maps[i].back(g)
                grad[:-1] += scale[i] * w
                searches[i].update(f, grad, tol)
        thetas = [s.theta for s in searches]
        open_cells = [x for x, s in zip(cells, searches) if not s.done]
        if open_cells:
            raise RuntimeError(f"{len(open_cells)} cells did not converge in {max_rounds} rounds, the first is {open_cells[0]}")
        ends = [0.0 if s.g is None else float(np.max(np.abs(s.g))) for s in searches]
        return Fitted(cells, [m.forward(t) for m, t in zip(maps, thetas)], thetas, [s.rounds for s in searches], ends)

    @staticmethod
    def _preconditioner(eig, mp: _Map, curve: float, ridge: float):
        values, vectors = eig
        inv = 1.0 / (curve * np.maximum(values, 0) + ridge)
        d, size = mp.d, mp.size
        # the inverse on what is left after directions q were projected out: M - Mq (q'Mq)^-1 q'M
        mq = small = None
        if d and mp.q is not None and mp.q.size:
            mq = vectors @ (inv[:, None] * (vectors.T @ mp.q))
            small = np.linalg.inv(mp.q.T @ mq)

        def apply(g: np.ndarray) -> np.ndarray:
            out = g / max(curve + ridge, 1e-12)
            if d:
                out[:d] = vectors @ (inv * (vectors.T @ g[:d]))
                if mq is not None:
                    out[:d] -= mq @ (small @ (mq.T @ g[:d]))
            out[d:size] = g[d:size] / (curve * np.maximum(mp.app_var, 0) + ridge)
            out[size] = g[size] / max(curve, 1e-12)
            return out

        return apply

    # ---- scoring -----------------------------------------------------------

    def score(self, fitted: Fitted, splits: Sequence[str] = ("test",)) -> DataFrame:
        """Long score table (model, variant, target, unit_id, split, y, p, keep...)."""
        sc = self.rows.sparkSession.sparkContext
        plan = self._plan(fitted.cells)
        for m, p in plan.items():
            p["u"] = np.array([fitted.coef[i] for i in p["cells"]])
            p["variant"] = [fitted.cells[i].variant.name for i in p["cells"]]
            p["name"] = [fitted.cells[i].target for i in p["cells"]]
        shared, feat, keep = sc.broadcast(plan), self._featurize(), self.keep
        base = self.rows.where(F.col("split").isin(*splits)).select("model", "x", "f", "y", "unit_id", "split", *keep)
        kept = [f for f in base.select("unit_id", "split", *keep).schema.fields]
        schema = T.StructType(
            [T.StructField(n, T.StringType()) for n in ("model", "variant", "target")] + kept
            + [T.StructField("y", T.IntegerType()), T.StructField("p", T.DoubleType())]
        )
        names = [f.name for f in kept]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in blocks(batch):
                    p = shared.value.get(b.model)
                    if p is None:
                        continue
                    z = np.hstack([feat(b.model, b.x, b.f), np.nan_to_num(b.f), np.ones((len(b.at), 1))])
                    prob = 0.5 * (1 + np.tanh(0.5 * (z @ p["u"].T)))
                    for j in range(len(p["cells"])):
                        y = b.y[:, p["target"][j]]
                        ok = ~np.isnan(y)
                        if p["need"][j]:
                            ok &= ~np.isnan(b.f[:, p["need"][j]]).any(1)
                        at = np.flatnonzero(ok)
                        if not len(at):
                            continue
                        rows = pa.array(b.at[at])
                        cols = [pa.repeat(pa.scalar(v), len(at)) for v in (b.model, p["variant"][j], p["name"][j])]
                        cols += [batch.column(n).take(rows) for n in names]
                        cols += [pa.array(y[at].astype(np.int32)), pa.array(prob[at, j])]
                        yield pa.RecordBatch.from_arrays(cols, names=["model", "variant", "target", *names, "y", "p"])

        return base.mapInArrow(run, schema)

    def group_scores(self, fitted: Fitted, splits: Sequence[str] = ("test",)) -> DataFrame:
        """Scores of the groups (model, variant, target, split, y, p, w): w units with label y; for metrics that take weights."""
        plan = self._plan(fitted.cells)
        for p in plan.values():
            p["u"] = np.array([fitted.coef[i] for i in p["cells"]])
            p["name"] = [(fitted.cells[i].variant.name, fitted.cells[i].target) for i in p["cells"]]
        feat = self._featurize()

        def prob(b: Block, p: dict) -> np.ndarray:
            z = np.hstack([feat(b.model, b.x, b.f), np.nan_to_num(b.f), np.ones((len(b.at), 1))])
            return 0.5 * (1 + np.tanh(0.5 * (z @ p["u"].T)))

        return self.scored_groups(plan, prob, splits)

    def scored_groups(self, plan: dict, prob, splits: Sequence[str]) -> DataFrame:
        """Rows of `group_scores` for `prob`, which gives (groups x cells) probabilities of a block."""
        shared, counts = self.rows.sparkSession.sparkContext.broadcast(plan), _counter(len(self.targets))
        base = self.groups.where(F.col("split").isin(*splits)).select("model", "x", "f", "y", "split")
        schema = "model string, variant string, target string, split string, y int, p double, w long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in blocks(batch):
                    p = shared.value.get(b.model)
                    if p is None:
                        continue
                    (known, hits), got = counts(b, p), prob(b, p)
                    for j, (variant, target) in enumerate(p["name"]):
                        for label, w in ((0, known[:, j] - hits[:, j]), (1, hits[:, j])):
                            at = np.flatnonzero(w > 0)
                            if not len(at):
                                continue
                            cols = [pa.repeat(pa.scalar(v), len(at)) for v in (b.model, variant, target)]
                            cols += [batch.column("split").take(pa.array(b.at[at])), pa.repeat(pa.scalar(label, pa.int32()), len(at))]
                            cols += [pa.array(got[at, j]), pa.array(np.rint(w[at]).astype(np.int64))]
                            yield pa.RecordBatch.from_arrays(cols, names=["model", "variant", "target", "split", "y", "p", "w"])

        return base.mapInArrow(run, schema)

    def coefficients(self, fitted: Fitted) -> DataFrame:
        """Coefficients on the raw row, one row per cell."""
        rows = [(x.model, x.variant.name, x.target, [float(v) for v in u], r) for x, u, r in zip(fitted.cells, fitted.coef, fitted.rounds)]
        return self.rows.sparkSession.createDataFrame(
            rows, "model string, variant string, target string, coef array<double>, rounds int"
        )


def ridge_probe(
    embeddings: DataFrame, units: DataFrame, target: str, split: str = "split", alpha: float = 1.0, fit_on: str = "train",
    splits: Sequence[str] = ("test",),
) -> DataFrame:
    """Ridge probe of a continuous target: scores (model, unit_id, y, p) (M9).

    One cross-product pass per table; rows with a null target are left out.
    """
    rows = feature_rows(embeddings, units.where(F.col(target).isNotNull()), [], [target], split)
    train = rows.where(F.col("split") == fit_on)

    def columns(b: Block) -> tuple[np.ndarray, int, np.ndarray]:
        return np.hstack([b.x, b.y]), b.x.shape[1], np.zeros(0)

    weights = {}
    for m, t in row_moments(train, columns).items():
        d, mu, my = len(t.cross), t.mean[:-1], t.mean[-1]
        sd = np.sqrt(t.squares[:-1] / t.n)
        sd = np.where(sd > 1e-12 * (1 + np.abs(mu)), sd, 1.0)
        w = np.linalg.solve(t.cross[:, :-1] / np.outer(sd, sd) + alpha * np.eye(d), t.cross[:, -1] / sd) / sd
        weights[m] = (w, my - w @ mu)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for b in blocks(batch):
                w, b0 = shared.value[b.model]
                ids = batch.column("unit_id").take(pa.array(b.at))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(b.model), len(b.at)), ids, pa.array(b.y[:, 0]), pa.array(b.x @ w + b0)],
                    names=["model", "unit_id", "y", "p"],
                )

    test = rows.where(F.col("split").isin(*splits)).select("model", "x", "f", "y", "unit_id")
    schema = T.StructType([
        T.StructField("model", T.StringType()), test.schema["unit_id"], T.StructField("y", T.DoubleType()), T.StructField("p", T.DoubleType()),
    ])
    return test.mapInArrow(run, schema)


def single_probe(train: DataFrame, features: str, label: str, c: float = 1.0, multinomial: bool = False):
    """One probe by MLlib with the same objective: regParam = 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    vec = train.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    n = vec.count()
    lr = LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-8, maxIter=500,
        family="multinomial" if multinomial else "binomial",
    )
    return lr.fit(vec)


def apply_single(model, rows: DataFrame, features: str, out: str = "prob") -> DataFrame:
    """Class probabilities of a single MLlib probe as an array column."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(features))))
    return scored.withColumn(out, vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def ensemble(scores: DataFrame, keys: Sequence[str], logit: str = "logit") -> DataFrame:
    """Mean logit over seeds, then the sigmoid."""
    return scores.groupBy(*keys).agg(F.avg(logit).alias("z"), F.max("y").alias("y")).select(
        *keys, "y", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))).alias("p")
    )
