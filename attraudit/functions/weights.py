"""Resampling weights as vectors: all replicates of a row at once, from one hash of the row.

Replicate r of a row with hash h mixes h + r * STEP (mod 2**64) and inverts the Poisson(1) distribution at the
upper 32 bits, so a weight depends on seed, row and replicate only, and SQL can repeat it. A row that stands for
m > 1 equal rows draws an exact Poisson(m) from a counter-based generator keyed by the row.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rand import poisson_cuts

STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: u (32 bits) at or above the k-th entry: a weight above k
CUTS = [int(np.ceil(c * 2**32)) for c in poisson_cuts() if c * 2**32 <= 2**32 - 1]
_TABLE = np.searchsorted(CUTS, np.arange(1 << 16, dtype="<u8") << np.uint64(16), "right").astype("u1")
_ASK = 255  # a cut lies within these upper 16 bits
_TABLE[[c >> 16 for c in CUTS]] = _ASK
IN_CACHE = 1 << 15  # draws mixed at once


def row_hash(seed: int, *parts: Column | str) -> Column:
    """First 60 bits of md5('seed:part:...') as a bigint."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def inverted(u: np.ndarray) -> np.ndarray:
    """Poisson(1) weights (small integers) at 32-bit draws."""
    w = _TABLE[u >> np.uint32(16)]
    at = np.flatnonzero(w == _ASK)
    if len(at):
        w.flat[at] = np.searchsorted(CUTS, u.flat[at], "right")
    return w


def poisson_weights(h: np.ndarray, m: np.ndarray, b: int) -> np.ndarray:
    """Weights (rows x b) of rows with hashes h and multiplicities m."""
    out = np.empty((len(h), b))
    steps, key = np.arange(b, dtype="<u8") * np.uint64(STEP), h.astype("<u8")[:, None]
    rows = max(1, IN_CACHE // max(b, 1))
    for lo in range(0, len(h), rows):
        x = key[lo:lo + rows] + steps
        for _ in range(2):
            x ^= x >> np.uint64(32)
            x *= np.uint64(MIX)
        x >>= np.uint64(32)
        out[lo:lo + rows] = inverted(x.astype("<u4"))
    for k in np.flatnonzero(m != 1).tolist():
        out[k] = np.random.Generator(np.random.Philox(key=[int(h[k]), int(m[k])])).poisson(m[k], b)
    return out
