"""External-cohort study: the same questions on another cohort and label source."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import apply_policy
from ..operators.probes import BASELINE, Fitted, FourierMap, ProbeTable
from ..session import materialize, together
from ..sources.sinks import write_by_model, write_text
from .inputs import Study
from .outcomes import external_summary, multimetric_study
from .representation import debiasing_study, dependence_matrix, erase


def external_units(meta: DataFrame, labels: DataFrame, embeddings: DataFrame, findings: Sequence[str], known: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Units of the embeddings with metadata and labels by id.

    `known` keeps only listed category values; anything else becomes missing, so
    no placeholder text can pass as a group.
    """
    wide = labels.groupBy("unit_id").pivot("finding", list(findings)).agg(F.max("raw"))
    df = embeddings.select("unit_id").distinct().join(meta, "unit_id", "left").join(wide, "unit_id", "left")
    for f in findings:
        df = df.withColumn(f, apply_policy(F.col(f), "ignore"))
    for c, values in (known or {}).items():
        df = df.withColumn(c, F.when(F.col(c).isin(*values), F.col(c)))
    return df.where(F.col("split").isNotNull())


def external_study(s: Study, sink: str | None = None, b: int = 200) -> dict[str, DataFrame]:
    """Dependence, subgroup gaps and their ratio with the external guards."""
    s = replace(s, min_train=max(s.min_train, 100), min_neg=max(s.min_neg, 10))
    dep = dependence_matrix(s, b=b)
    gaps = debiasing_study(s, {"all": list(s.attributes)}, b=b, min_n=30, min_pos=5, min_neg=5)
    base_gaps = gaps["gaps"].where("variant = 'baseline'")
    aurocs = gaps["cost"].select("model", "target", F.col("before").alias("auroc")).distinct()
    out = {**dep, "gaps": base_gaps, "external": external_summary(aurocs, base_gaps, dep["cells"])}
    if sink is not None:
        write_by_model(dep["cells"], sink)
    return out


def both_erasures(s: Study, attributes: Sequence[str], feature_map: FourierMap, max_rounds: int = 25) -> DataFrame:
    """Nullspace erasure in the plain and in the Fourier space, side by side on one table (Q23, Q27)."""
    targets = list(dict.fromkeys([*attributes, *s.findings]))
    with ProbeTable(s.embeddings, s.units, [], targets) as t:
        t._need_moments([()])
        plain, curved = together(lambda: erase(t, s, attributes, max_rounds), lambda: erase(t.mapped(feature_map), s, attributes, max_rounds))
    return plain.unionByName(curved)


def external_extended(s: Study, attributes: Sequence[str], group: str, feature_map: FourierMap, sink: str | None = None, b: int = 1000, max_rounds: int = 25) -> dict[str, DataFrame]:
    """Multi-metric gaps and nonlinear erasure on the external cohort, with a text summary.

    One table of probes serves all parts; its baseline is fitted once for the gaps and the plain erasure, with the Fourier erasure beside both.
    """
    targets = list(dict.fromkeys([*attributes, *s.findings]))
    with ProbeTable(s.embeddings, s.units, [], targets, keep=(group,)) as t:
        t._need_moments([()])  # read by all

        def gaps(fitted: Fitted) -> dict[str, DataFrame]:
            scores = materialize(t.score(fitted, ("train", "test")))
            out = multimetric_study(scores, ["model", "target"], group, b=b)
            return {**out, "gaps": materialize(out["gaps"])}

        def plain() -> list:
            fitted = t.fit(s.guard(t, t.cells([BASELINE], s.findings)))
            return together(lambda: gaps(fitted), lambda: erase(t, s, attributes, max_rounds, fitted))

        (out, raw), curved = together(plain, lambda: erase(t.mapped(feature_map), s, attributes, max_rounds))
    out["erasure"] = raw.unionByName(curved)
    out["summary"] = out["gaps"].groupBy("metric").agg(F.avg("gap").alias("mean_gap"), F.count("gap").alias("n_cells"))
    if sink is not None:
        line = F.format_string("%-12s mean gap %.3f over %d cells", F.col("metric"), F.col("mean_gap"), F.col("n_cells"))
        write_text(out["summary"], sink, line)
    return out
