"""Concept erasure: iterative nullspace projection with a random-direction control."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .probes import Cell, Fitted, ProbeTable, Variant
from ..session import materialize
from .ranking import auroc


def first_cells(table: ProbeTable, attributes: Sequence[str], cohorts: dict[str, tuple[str, ...]] | None = None) -> list[Cell]:
    """The cells of the first round of `nullspace_directions`: nothing is taken out yet."""
    return [c for m in table.models for a in attributes for c in table.cells([Variant(f"erase:{a}", cohort=(cohorts or {}).get(a, ()))], [a], [m])]


def nullspace_directions(
    table: ProbeTable, attributes: Sequence[str], max_rounds: int = 25, target: float = 0.53, check_on: str = "val",
    cohorts: dict[str, tuple[str, ...]] | None = None, ends: dict | None = None, first: Fitted | None = None,
) -> tuple[dict[str, dict[str, np.ndarray]], list[tuple]]:
    """Directions whose removal makes each attribute linearly undecodable.

    Every round trains one probe per (model, attribute) still decodable on the
    validation rows, all in the same scans, and adds its unit direction to the
    basis that the next round projects out. Nothing is rewritten: the projection
    is part of the probe's linear map. Rounds share the table's moments, deflate
    the preconditioner by the directions found so far, and start from the
    coefficients of the round before, so each takes few scans. Returns {attribute: {model: Q}} and a log
    of (model, attribute, round, validation AUROC). `ends` receives the last probe of each (model, attribute): that
    with all directions of the result taken out. `first` gives the probes of `first_cells` where they are fitted already.
    """
    cohorts = cohorts or {}
    found = {a: {m: np.zeros((len(table._scale[m][0]), 0)) for m in table.models} for a in attributes}
    live = [(m, a) for m in table.models for a in attributes]
    warm: dict[tuple[str, str], np.ndarray] = {}
    log = []
    for round_no in range(max_rounds + 1):
        if not live:
            break
        cells = []
        for m, a in live:
            v = Variant(f"erase:{a}", cohort=cohorts.get(a, ()), basis={m: found[a][m]})
            cells += table.cells([v], [a], [m])
        fitted = first.only(cells) if first is not None and round_no == 0 else table.fit(cells, start=[warm.get(k) for k in live])
        scored = auroc(table.group_scores(fitted, (check_on,)), ["model", "target"], weight="w")
        value = {(r["model"], r["target"]): r["auroc"] for r in scored.collect()}
        still = []
        for i, (m, a) in enumerate(live):
            v = value.get((m, a))
            log.append((m, a, round_no, v))
            if ends is not None:
                ends[m, a] = (fitted.coef[i], fitted.theta[i], fitted.rounds[i], fitted.gradient[i])
            if v is None or v < target or round_no == max_rounds:
                continue
            w = fitted.theta[i][: found[a][m].shape[0]]
            q = found[a][m]
            w = w - q @ (q.T @ w)
            size = np.linalg.norm(w)
            if size < 1e-10:
                continue
            q = found[a][m] = np.linalg.qr(np.hstack([q, (w / size)[:, None]]))[0]
            left = fitted.theta[i].copy()
            left[: len(q)] -= q @ (q.T @ left[: len(q)])
            warm[m, a] = left
            still.append((m, a))
        live = still
    return found, log


def last_values(log: Sequence[tuple], target: float = 0.53) -> dict[tuple[str, str], tuple[int, float | None, bool | None]]:
    """Per (model, attribute): the last round, its validation AUROC, and whether that is below the target."""
    out = {}
    for m, a, round_no, v in log:
        out[m, a] = (round_no, v, None if v is None else v < target)
    return out


def random_directions(like: dict[str, np.ndarray], seed: int = 42) -> dict[str, np.ndarray]:
    """Random orthonormal bases of the same shapes: the control for an erasure."""
    out = {}
    for m, q in like.items():
        rng = np.random.default_rng([seed, *m.encode()])
        out[m] = np.linalg.qr(rng.normal(size=q.shape))[0] if q.size else q
    return out


def erasure_effect(
    table: ProbeTable, attribute: str, basis: dict[str, np.ndarray], findings: Sequence[str], seed: int = 42,
    cohort: tuple[str, ...] = (),
) -> DataFrame:
    """Drop of each finding's AUROC after concept and random removal, and decodability left."""
    return erasure_effects(table, {attribute: basis}, findings, seed, cohort)


def _add(fitted: Fitted, *one) -> None:
    for k, v in zip(("cells", "coef", "theta", "rounds", "gradient"), one):
        getattr(fitted, k).append(v)


def erasure_effects(
    table: ProbeTable, found: dict[str, dict[str, np.ndarray]], findings: Sequence[str], seed: int = 42, cohort: tuple[str, ...] = (),
    baseline: Fitted | None = None, ends: dict | None = None,
) -> DataFrame:
    """`erasure_effect` of several attributes, all cells in the same scans.

    Attributes share the baseline; where no direction was found, nothing is taken out and the baseline stands for the variant.
    `baseline` gives its probes where they are fitted already, `ends` the attributes' own (see `nullspace_directions`).
    """
    base = Variant("baseline", cohort=cohort)
    findings = list(findings)
    cells, use = table.cells([base], findings), []  # use: which variant stands for (attribute, role) of a model
    for attribute, basis in found.items():
        for role, q in (("concept", basis), ("random", random_directions(basis, seed))):
            v = Variant(f"{role}:{attribute}", cohort=cohort, basis=q)
            models = [m for m in table.models if q[m].size]
            cells += table.cells([v], findings, models) if models else []
            use += [(attribute, role, m, v.name if m in models else base.name) for m in table.models]
    cells, done = table.guard(cells), Fitted([], [], [], [])
    for i, c in enumerate(baseline.cells if baseline else []):
        _add(done, c, baseline.coef[i], baseline.theta[i], baseline.rounds[i], baseline.gradient[i])
    for attribute, basis in found.items():
        for m in table.models:
            v = Variant(f"concept:{attribute}", cohort=cohort, basis=basis) if basis[m].size else base
            for c in table.cells([v], [attribute], [m]):
                if ends and c not in done.cells:
                    _add(done, c, *ends[m, attribute])
                if c not in cells:
                    cells.append(c)
    fresh = table.fit([c for c in cells if c not in done.cells])
    fitted = done.joined(fresh)
    a = materialize(auroc(table.group_scores(fitted), ["model", "variant", "target"], weight="w"))
    spark = a.sparkSession
    roles = spark.createDataFrame(use, "attribute string, role string, model string, variant string")
    every = spark.createDataFrame([(k, "baseline", m, base.name) for k in found for m in table.models], roles.schema)
    a = a.join(F.broadcast(roles.unionByName(every)), ["model", "variant"])

    def of(role):
        return F.max(F.when(F.col("role") == role, F.col("auroc")))

    per = a.where(F.col("target").isin(*findings)).groupBy("model", "attribute", "target").agg(
        of("baseline").alias("b"), of("concept").alias("c"), of("random").alias("r")
    )
    drops = per.groupBy("model", "attribute").agg(
        F.avg(F.col("b") - F.col("c")).alias("drop_concept"), F.avg(F.col("b") - F.col("r")).alias("drop_random")
    )
    left = a.where((F.col("target") == F.col("attribute")) & (F.col("role") == "concept")).select("model", "attribute", F.col("auroc").alias("decode_after"))
    dirs = spark.createDataFrame([(m, k, q.shape[1]) for k, basis in found.items() for m, q in basis.items()], "model string, attribute string, n_dirs int")
    return dirs.join(left, ["model", "attribute"], "left").join(drops, ["model", "attribute"], "left").select(
        "model", "attribute", "n_dirs", "decode_after", "drop_concept", "drop_random",
        (F.col("drop_concept") - F.col("drop_random")).alias("net_drop"),
    )
