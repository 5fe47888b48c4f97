"""Cross-product matrices of column blocks: one scan, additive partial sums.

Every task sums its own rows with BLAS and emits one flat matrix per key; the
matrices are then added in the JVM. A hot key is therefore split over all tasks
that hold its rows, and what is shuffled does not grow with the row count.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_OPEN_KEYS = 512


def sum_arrays(partials: DataFrame, keys: Sequence[str], array: str = "g", extra: Sequence[str] = ("n",)) -> DataFrame:
    """Element-wise sum of equally long arrays per key."""
    return partials.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in extra], vector_to_array(Summarizer.sum(array_to_vector(array))).alias(array)
    )


def gram(
    rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None,
    shift: Sequence[float] | None = None,
) -> DataFrame:
    """Weighted cross products of [1, columns] per key as a flat row-major array.

    Rows with a null in any column are left out. `shift` is subtracted from the
    columns first to keep the sums well conditioned. Returns (by..., n, g).
    """
    by, columns = list(by), list(columns)
    moved = np.zeros(len(columns)) if shift is None else np.asarray(shift, float)
    p = len(columns) + 1
    picked = rows.select(
        *by, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)],
        *([F.col(weight).cast("double").alias("w")] if weight else []),
    ).dropna(subset=[f"c{i}" for i in range(len(columns))])
    names = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType(
        [f for f in picked.select(*by).schema.fields]
        + [T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_keys: dict = {}

        def flush():
            out = pd.DataFrame([[*k, n, g.ravel()] for k, (n, g) in open_keys.items()], columns=[*by, "n", "g"])
            open_keys.clear()
            return out

        for pdf in batches:
            x = np.empty((len(pdf), p))
            x[:, 0] = 1.0
            x[:, 1:] = pdf[names].to_numpy(float) - moved
            wx = x * pdf["w"].to_numpy(float)[:, None] if weight else x
            groups = pdf.groupby(by, sort=False, dropna=False).indices.items() if by else [((), slice(None))]
            for key, at in groups:
                key = key if isinstance(key, tuple) else (key,)
                n, g = open_keys.get(key, (0, np.zeros((p, p))))
                part = x[at]
                open_keys[key] = (n + len(part), g + part.T @ wx[at])
            if len(open_keys) > MAX_OPEN_KEYS:
                yield flush()
        if open_keys:
            yield flush()

    return sum_arrays(picked.mapInPandas(partial, schema), by)


def mean_shift(rows: DataFrame, columns: Sequence[str]) -> list[float]:
    """Means of the complete rows, to single precision so that the order of the rows doesn't matter: a shift that keeps cross products small."""
    picked = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    means = picked.agg(*[F.avg(c) for c in picked.columns]).first()
    return [0.0 if v is None or not np.isfinite(v) else float(np.float32(v)) for v in means]
