"""Label policies, categories, bins and median splits as column expressions."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("ignore", "zero", "blank_dropped")


def apply_policy(raw: Column, policy: str) -> Column:
    """A ternary raw label (1, 0, -1, null) as a nullable 0/1 integer.

    ignore: only 1 and 0 count, the rest is masked.
    zero: 1 counts, everything else, blanks included, is 0.
    blank_dropped: blanks are masked, 1 counts, 0 and -1 are 0.
    """
    if policy == "ignore":
        return F.when(raw.isin(0.0, 1.0), raw.cast("int"))
    if policy == "zero":
        return F.coalesce((raw == 1.0).cast("int"), F.lit(0))
    if policy == "blank_dropped":
        return F.when(raw.isNotNull(), (raw == 1.0).cast("int"))
    raise ValueError(f"policy must be one of {POLICIES}, is {policy!r}")


@dataclass(frozen=True)
class CategoryRules:
    """Ordered prefix/exact rules that fold free-text categories into a few groups."""

    prefixes: Sequence[tuple[str, str]]
    exact: Sequence[tuple[str, str]] = ()
    unknown: Sequence[str] = ()
    unknown_label: str = "Unknown"
    other_label: str = "Other"


# The category spellings the results depend on.
RACE_RULES = CategoryRules(
    prefixes=(("WHITE", "White"), ("BLACK", "Black"), ("ASIAN", "Asian")),
    exact=(("PORTUGUESE", "White"), ("SOUTH ASIAN", "Asian")),
    unknown=("UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER"),
)


def collapse_category(raw: Column, rules: CategoryRules = RACE_RULES) -> Column:
    """Fold a free-text category into the groups of `rules`."""
    text = F.upper(raw)
    out = F.when(raw.isNull(), rules.unknown_label)
    for value, label in rules.exact:
        out = out.when(text == value, label)
    for prefix, label in rules.prefixes:
        out = out.when(text.startswith(prefix), label)
    if rules.unknown:
        out = out.when(text.isin(*rules.unknown), rules.unknown_label)
    return out.otherwise(rules.other_label)


def assign_bins(value: Column, edges: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """Left-closed, right-open bins; outside or missing values give `missing`."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    out = F.when(value.isNull() | F.isnan(value), F.lit(missing))
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        out = out.when((value >= lo) & (value < hi), label)
    return out.otherwise(F.lit(missing))


def assign_values(value: Column, mapping: dict, missing: str | None = None) -> Column:
    """Value to label lookup for coded groups, e.g. 0/1 to names."""
    out = F.when(value.isNull(), F.lit(missing))
    for key, label in mapping.items():
        out = out.when(value == F.lit(key), label)
    return out.otherwise(F.lit(missing))


def split_at(value: Column, cut: Column, op: str = ">=", missing: int | None = None) -> Column:
    """0/1 side of a cut point (P8 with '>=', P9 with '>' and missing=0)."""
    if op not in (">=", ">"):
        raise ValueError("op must be '>=' or '>'")
    side = (value >= cut) if op == ">=" else (value > cut)
    out = F.when(value.isNotNull() & cut.isNotNull(), side.cast("int"))
    return out if missing is None else F.coalesce(out, F.lit(missing))


def one_hot(value: Column, levels: Sequence[str], drop: str) -> Column:
    """0/1 block over the levels except the reference level."""
    return F.array(*[(value == F.lit(v)).cast("double") for v in levels if v != drop])


def one_hot_columns(name: str, levels: Sequence[str], drop: str) -> dict[str, Column]:
    """The same block as columns of their own, as residualization takes them (P17, M7); null stays null."""
    value = F.col(name)
    return {f"{name}_is_{v}": F.when(value.isNotNull(), (value == F.lit(v)).cast("double")) for v in levels if v != drop}


def contrast(value: Column, positive: str, negative: str) -> Column:
    """1 for one category, 0 for the other, null for everyone else."""
    return F.when(value == positive, 1).when(value == negative, 0)


@dataclass(frozen=True)
class Aliases:
    """Attribute name aliases, resolved once when a table is registered."""

    names: dict = field(default_factory=lambda: {"sex": "gender_binary"})

    def resolve(self, name: str) -> str:
        return self.names.get(name, name)


def nan_to_null(value: Column) -> Column:
    """NaN means missing in the inputs; aggregates skip only null."""
    return F.when(~F.isnan(value), value)
