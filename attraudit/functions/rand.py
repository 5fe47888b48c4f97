"""Hash-based randomness: the same draw for a row wherever and whenever it is computed."""
from __future__ import annotations

import math
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = float(2**32)


def hash_u32(seed: int | str | Column, *parts: Column | str) -> Column:
    """First 32 bits of md5('seed:part:...') as a bigint."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", head.cast("string"), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str | Column, *parts: Column | str) -> Column:
    """A uniform draw in [0, 1)."""
    return hash_u32(seed, *parts) / F.lit(U32)


def poisson_cuts(mean: float = 1.0, upto: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson variable at 0, 1, ..., upto."""
    total, term, cuts = 0.0, math.exp(-mean), []
    for k in range(upto + 1):
        total += term
        cuts.append(total)
        term *= mean / (k + 1)
    return cuts


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw by inverting the distribution at a uniform value.

    The draw is bound to a lambda variable, so its hash is computed once per row.
    """
    def invert(v: Column) -> Column:
        out = F.lit(0)
        for c in poisson_cuts():
            out = out + (v >= F.lit(c)).cast("int")
        return out

    return F.transform(F.array(u), invert)[0]


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile by a rational approximation (relative error below 1.2e-9), bound to u once."""
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]

    def poly(k: list[float], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + F.lit(v)
        return out

    def at(p: Column) -> Column:
        q, s = p - 0.5, (p - 0.5) * (p - 0.5)
        low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
        return F.when(p < 0.02425, poly(c, low) / poly(d, low)).when(p > 0.97575, -poly(c, high) / poly(d, high)).otherwise(poly(a, s) * q / poly(b, s))

    return F.transform(F.array(u), at)[0]


ADDED = 64  # up to so many equal rows, their draws are added up


def poisson_many(count: Column, seed: int, *parts: Column | str) -> Column:
    """Sum of `count` independent Poisson(1) draws: the weight of `count` equal rows.

    Up to ADDED rows the draws are added. Beyond, one Poisson(count) draw is the
    Cornish-Fisher quantile at one uniform value: constant work for any bigint count,
    never more than one off the exact quantile.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    n = count.cast("double")
    z = normal_quantile(uniform(seed, *cols, F.lit("all")) + 0.5 / U32)
    many = F.transform(F.array(z), lambda q: n + F.sqrt(n) * q + (q * q - 1) / 6 + (q - q * q * q) / (72 * F.sqrt(n)))[0]
    return F.when(count <= 0, F.lit(0).cast("bigint")).when(count > ADDED, F.greatest(F.round(many), F.lit(0.0)).cast("bigint")).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.least(F.greatest(count, F.lit(1)), F.lit(ADDED)).cast("int")),
            F.lit(0).cast("bigint"),
            lambda acc, i: acc + poisson_one(uniform(seed, *cols, i)),
        )
    )


def hash_order(seed: int | str | Column, *parts: Column | str) -> Column:
    """Full md5 hex of 'seed:part:...': a random order without ties."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", head.cast("string"), *[c.cast("string") for c in cols]))
