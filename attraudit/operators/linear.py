"""Scaling, residualization, projection and spectrum of array-typed representations."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, blocks, feature_rows, row_moments


def fit_scaler(rows: DataFrame, keys: Sequence[str] = ("model",), x: str = "embedding") -> DataFrame:
    """Mean and population deviation per dimension; zero deviation becomes 1 (M3, P25)."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(x).cast("array<double>")))
    s = rows.groupBy(*keys).agg(stats.alias("s"))
    n = F.col("s.count")
    var = F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n)
    sd = F.transform(var, lambda v: F.when(v > 1e-24, F.sqrt(v)).otherwise(1.0))
    return s.select(*keys, n.alias("n"), vector_to_array("s.mean").alias("mean"), sd.alias("sd"))


def scale(rows: DataFrame, scaler: DataFrame, keys: Sequence[str] = ("model",), x: str = "embedding") -> DataFrame:
    """Standardize every dimension with a fitted scaler (one short row per model)."""
    j = rows.join(scaler.select(*keys, F.col("mean").alias("__m"), F.col("sd").alias("__s")), list(keys))
    centered = F.zip_with(F.col(x), F.col("__m"), lambda a, b: a - b)
    return j.withColumn(x, F.zip_with(centered, F.col("__s"), lambda a, b: a / b)).drop("__m", "__s")


def ridge_map(rows: DataFrame, alpha: float = 1.0) -> dict[str, dict]:
    """Ridge of x on f with a free intercept per model, from one cross-product pass.

    `rows` has the layout of `feature_rows`; rows with an unknown design value are
    left out. Returns weights, means and the pooled R2 per model.
    """
    def known(b: Block) -> tuple[np.ndarray, int, np.ndarray]:
        ok = ~np.isnan(b.f).any(1)
        return np.hstack([b.f[ok], b.x[ok]]), b.f.shape[1], np.zeros(0)

    out = {}
    for m, t in row_moments(rows, known).items():
        k = len(t.cross)
        dd, dx, tss = t.cross[:, :k], t.cross[:, k:], t.squares[k:]
        a = dd + alpha * np.eye(k)
        w = np.linalg.solve(a, dx) if alpha > 0 else np.linalg.pinv(a) @ dx
        gain = (2 * w * dx - w * (dd @ w)).sum()
        out[m] = {"w": w, "f_mean": t.mean[:k], "x_mean": t.mean[k:], "n": int(t.n), "r2": float(gain / tss.sum())}
    return out


def _mapped(rows: DataFrame, apply, keep: Sequence[str], out: str) -> DataFrame:
    """Apply a (block) -> matrix function in Arrow batches; rows with NaN get null."""
    layout = ("model", "x", "f", "y")
    base = rows.select(*layout, *[c for c in keep if c not in layout])
    schema = T.StructType([f for f in base.select("model", *keep).schema.fields] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                z = apply(b)
                ids = pa.array(b.at)
                offsets = pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(z).ravel()))
                cols = [batch.column("model").take(ids), *[batch.column(c).take(ids) for c in keep], lists]
                yield pa.RecordBatch.from_arrays(cols, names=["model", *keep, out])

    return base.mapInArrow(run, schema)


def residualize(
    embeddings: DataFrame, units: DataFrame, designs: Sequence[str], alpha: float = 1.0, split: str = "split",
    fit_on: str = "train", keep: Sequence[str] = ("unit_id", "split"), out: str = "residual",
) -> DataFrame:
    """Embeddings with the linear trace of the designs removed, fitted on train (M4-M7).

    alpha=0 is ordinary least squares. For probes use a Variant instead, which
    never writes the residuals.
    """
    known = units.dropna(subset=list(designs))
    rows = feature_rows(embeddings, known, list(designs), [], split)
    maps = ridge_map(rows.where(F.col("split") == fit_on), alpha)
    shared = rows.sparkSession.sparkContext.broadcast(maps)

    def apply(b: Block) -> np.ndarray:
        m = shared.value[b.model]
        return b.x - m["x_mean"] - (b.f - m["f_mean"]) @ m["w"]

    return _mapped(rows, apply, keep, out)


def project_out(rows: DataFrame, basis: dict[str, np.ndarray], keep: Sequence[str] = ("unit_id", "split"), out: str = "projected") -> DataFrame:
    """Rows with the directions of an orthonormal basis per model removed."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def apply(b: Block) -> np.ndarray:
        q = shared.value.get(b.model)
        return b.x if q is None or not q.size else b.x - (b.x @ q) @ q.T

    return _mapped(rows, apply, keep, out)


def geometry(embeddings: DataFrame) -> DataFrame:
    """Spectrum summary per model: ranks, variance shares, dimensions, mean cosine.

    Stable rank is sum / max of the covariance eigenvalues, participation ratio
    is sum^2 / sum of squares, effective rank is exp of their entropy.
    """
    rows = embeddings.select(
        "model", F.col("embedding").alias("x"), F.array().cast("array<double>").alias("f"), F.array().cast("array<double>").alias("y")
    )

    def about_mean(b: Block) -> tuple[np.ndarray, int, np.ndarray]:
        unit = b.x / np.maximum(np.linalg.norm(b.x, axis=1, keepdims=True), 1e-300)
        return b.x, b.x.shape[1], unit.sum(0)

    out = []
    for m, t in sorted(row_moments(rows, about_mean).items()):
        d, n, u = len(t.mean), t.n, t.extra
        lam = np.linalg.eigvalsh(t.cross / (n - 1))[::-1]
        lam = np.maximum(lam, 0.0)
        share = lam / lam.sum()
        pos = share[share > 0]
        cum = np.cumsum(share)
        out.append((
            m, d, float(np.exp(-(pos * np.log(pos)).sum())), float(lam.sum() / lam[0]), float(lam.sum() ** 2 / (lam**2).sum()),
            float(lam[-1] / lam[0]), *[float(100 * cum[min(k, d) - 1]) for k in (1, 10, 50)],
            int(np.searchsorted(cum, 0.90) + 1), int(np.searchsorted(cum, 0.95) + 1), float((u @ u - n) / (n * (n - 1))),
        ))
    return embeddings.sparkSession.createDataFrame(
        out,
        "model string, ambient_dim int, effective_rank double, stable_rank double, participation_ratio double, isotropy_ratio double, "
        "var_top1_pct double, var_top10_pct double, var_top50_pct double, dims_for_90pct_var int, dims_for_95pct_var int, avg_cosine_similarity double",
    )


def hinge_basis(units: DataFrame, column: str, knots: Sequence[float]) -> tuple[DataFrame, list[str]]:
    """Piecewise-linear basis of one continuous column, for nonlinear residualization."""
    names, out = [column], units
    for i, k in enumerate(knots):
        name = f"{column}__h{i}"
        out = out.withColumn(name, F.greatest(F.col(column) - F.lit(float(k)), F.lit(0.0)) + F.col(column) * 0.0)
        names.append(name)
    return out, names
