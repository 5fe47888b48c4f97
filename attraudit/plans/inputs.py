"""What a study needs: embeddings, units with split, attributes and 0/1 findings."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import apply_policy
from ..operators import cohort


@dataclass
class Study:
    """The tables of one audit and the roles of their columns.

    units: unit_id, entity_id, split, attribute and group columns, and findings
    as nullable 0/1 labels. embeddings: model, unit_id, embedding.
    """

    embeddings: DataFrame
    units: DataFrame
    attributes: Sequence[str]
    findings: Sequence[str]
    groups: dict[str, str] = field(default_factory=dict)
    min_train: int = 50
    min_test: int = 50
    min_pos: int = 10
    min_neg: int = 0

    def guard(self, table, cells):
        return table.guard(cells, self.min_train, self.min_test, self.min_pos, self.min_neg)


def build_cohort(
    embeddings: DataFrame, units: DataFrame, findings: Sequence[str], policy: str = "ignore", labels: DataFrame | None = None,
    stratum: str | None = None, seed: int = 42, label_keys: Sequence[str] = ("entity_id", "study_id"),
) -> DataFrame:
    """Canonical units with labels under a policy and an entity-level split (Q1).

    `labels` is long (keys..., finding, raw); without it the findings are
    columns of `units`.
    """
    base = units.join(cohort.canonical_units(embeddings, units), "unit_id", "left_semi")
    if labels is not None:
        wide = labels.groupBy(*label_keys).pivot("finding", list(findings)).agg(F.max("raw"))
        base = base.drop(*findings).join(wide, list(label_keys))
    for f in findings:
        base = base.withColumn(f, apply_policy(F.col(f), policy))
    split = cohort.entity_split(cohort_entities(base, stratum), "entity_id", stratum, seed=seed)
    return base.drop("split").join(split.select("entity_id", "split"), "entity_id")


def cohort_entities(units: DataFrame, stratum: str | None) -> DataFrame:
    """One row per entity with its first known stratum value."""
    if stratum is None:
        return units.select("entity_id").distinct()
    known = cohort.first_known(units, "entity_id", stratum, "unit_id")
    every = units.select("entity_id").distinct()
    return every.join(known, "entity_id", "left").withColumn(stratum, F.coalesce(F.col(stratum).cast("string"), F.lit("missing")))
