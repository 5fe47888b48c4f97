"""Contingency tables and odds ratios for all attribute x finding pairs at once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import safe_abs_log

CELLS = ("tp", "fp", "fn", "tn")
CORRECTIONS = ("zero_cell", "always", "lt_half", "none")


def _cell(a: Column, y: Column) -> dict[str, Column]:
    return {"tp": (a == 1) & (y == 1), "fp": (a == 1) & (y == 0), "fn": (a == 0) & (y == 1), "tn": (a == 0) & (y == 0)}


def _to_long(wide: DataFrame, keys: Sequence[str], findings: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(f).alias("finding"), *[F.col(f"{c}__{f}").alias(c) for c in CELLS]) for f in findings
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def contingency(
    units: DataFrame, attributes: Sequence[str], findings: Sequence[str], by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """2x2 counts per (by, attribute, finding); null attribute or label is left out.

    Rows are repeated once per attribute only: all findings are counted side by
    side, and the map-side combine leaves one short row per task and attribute.
    """
    keep = [*by, *findings] + ([weight] if weight else [])
    rows = F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.when(F.col(a).isin(0, 1), F.col(a).cast("int")).alias("a")) for a in attributes
    ])
    long = units.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*").where(F.col("a").isNotNull())
    aggs = []
    for f in findings:
        for name, cond in _cell(F.col("a"), F.col(f)).items():
            agg = F.count_if(cond) if weight is None else F.sum(F.when(cond, F.col(weight)).otherwise(0.0))
            aggs.append(agg.alias(f"{name}__{f}"))
    keys = [*by, "attribute"]
    return _to_long(long.groupBy(*keys).agg(*aggs), keys, findings)


def entity_weighted_contingency(
    units: DataFrame, attributes: Sequence[str], findings: Sequence[str], entity: str
) -> DataFrame:
    """2x2 sums where each row weighs 1 / rows of its entity (A3, A4).

    Counts are taken per entity first, together with its rows, so the weight is
    divided once per entity and nothing is joined.
    """
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("a")) for a in attributes])
    long = units.select(entity, *findings, F.explode(rows).alias("x")).select(entity, *findings, "x.*")
    counts = [F.count_if(cond).alias(f"{name}__{f}") for f in findings for name, cond in _cell(F.col("a"), F.col(f)).items()]
    per = long.groupBy(entity, "attribute").agg(F.count(F.lit(1)).alias("__n"), *counts)
    return _to_long(per, ["attribute", "__n"], findings).groupBy("attribute", "finding").agg(
        *[F.sum(F.col(c) / F.col("__n")).alias(c) for c in CELLS])


def odds_ratio(table: DataFrame, correction: str, min_n: int = 0, min_side: int = 0) -> DataFrame:
    """Odds ratio, log and |log| from 2x2 cells.

    zero_cell: +0.5 everywhere if one cell is 0. always: +0.5 everywhere.
    lt_half: +0.5 everywhere if one cell is below 0.5. none: as counted.
    """
    if correction not in CORRECTIONS:
        raise ValueError(f"correction must be one of {CORRECTIONS}")
    cols = [F.col(c).cast("double") for c in CELLS]
    low = F.least(*cols)
    add = {
        "zero_cell": F.when(low == 0, 0.5).otherwise(0.0),
        "always": F.lit(0.5),
        "lt_half": F.when(low < 0.5, 0.5).otherwise(0.0),
        "none": F.lit(0.0),
    }[correction]
    tp, fp, fn, tn = [c + add for c in cols]
    out = table
    if min_n:
        out = out.where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= min_n)
    if min_side:
        out = out.where(
            (F.col("tp") + F.col("fp") >= min_side) & (F.col("fn") + F.col("tn") >= min_side)
        )
    ratio = F.try_divide(tp * tn, fp * fn)
    return (
        out.withColumn("odds_ratio", ratio)
        .withColumn("log_or", F.when(F.col("odds_ratio") > 0, F.ln("odds_ratio")))
        .withColumn("abs_log_or", safe_abs_log(F.col("odds_ratio")))
    )


def mantel_haenszel(
    units: DataFrame, attributes: Sequence[str], findings: Sequence[str], stratum: str, min_stratum: int = 50,
    min_strata: int = 2,
) -> DataFrame:
    """Crude and Mantel-Haenszel odds ratios over strata (A5).

    Pairs need `min_strata` strata with `min_stratum` rows each. Cells are not
    corrected in the pooled ratio; the crude ratio corrects only a zero cell.
    """
    per = contingency(units, attributes, findings, by=[stratum])
    per = per.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).where(
        F.col("n") >= min_stratum
    )
    num = F.sum(F.col("tp") * F.col("tn") / F.col("n"))
    den = F.sum(F.col("fp") * F.col("fn") / F.col("n"))
    pooled = per.groupBy("attribute", "finding").agg(
        *[F.sum(c).alias(c) for c in CELLS],
        F.count(F.lit(1)).alias("n_strata"),
        F.when(den > 0, num / den).alias("or_mh"),
    ).where(F.col("n_strata") >= min_strata)
    crude = odds_ratio(pooled, "zero_cell").withColumnRenamed("odds_ratio", "or_crude")
    return crude.select(
        "attribute", "finding", "n_strata", "or_crude", F.col("abs_log_or").alias("abs_log_or_crude"),
        "or_mh", safe_abs_log(F.col("or_mh")).alias("abs_log_or_mh"),
    )


def stratum_odds(units: DataFrame, attributes, findings, stratum: str, min_stratum: int = 50) -> DataFrame:
    """Odds ratio inside each stratum (A5)."""
    per = contingency(units, attributes, findings, by=[stratum])
    return odds_ratio(per, "zero_cell", min_n=min_stratum)


def compare_variants(base: DataFrame, other: DataFrame, suffixes: tuple[str, str]) -> DataFrame:
    """Two odds tables side by side with the change of |log OR|."""
    a, b = suffixes
    keys = ["attribute", "finding"]

    def pick(df, s):
        return df.select(*keys, F.col("odds_ratio").alias(f"or_{s}"), F.col("abs_log_or").alias(f"abs_log_or_{s}"))

    return pick(base, a).join(pick(other, b), keys).withColumn(
        "or_change", F.col(f"abs_log_or_{b}") - F.col(f"abs_log_or_{a}")
    )
