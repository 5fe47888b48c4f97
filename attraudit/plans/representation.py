"""Studies of what representations encode and what their probes depend on."""
from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify_confounding, cost_tier
from ..functions.labels import one_hot_columns
from ..functions.tails import p_normal
from ..operators import cohort, fairness, odds, ranking, resample, summary
from ..operators.erasure import erasure_effects, first_cells, last_values, nullspace_directions
from ..operators.linear import hinge_basis
from ..operators.network import Network, fit_network, network_group_scores
from ..operators.panel import one_sample_t, spearman
from ..operators.probes import BASELINE, Fitted, FourierMap, ProbeTable, Variant, ridge_probe
from ..operators.softmax import fit_softmax, score_softmax
from ..session import materialize, together
from .inputs import Study

CELL = ["model", "target"]


def _pivot_variants(a: DataFrame, keys: Sequence[str], columns: dict[str, str], value: str = "auroc") -> DataFrame:
    return a.groupBy(*keys).agg(*[F.max(F.when(F.col("variant") == v, F.col(value))).alias(c) for v, c in columns.items()])


def encoding_study(s: Study, binary: Sequence[str], continuous: Sequence[str] = (), b: int = 200, nonlinear: FourierMap | None = None) -> dict[str, DataFrame]:
    """How well each attribute is decoded from each model."""
    out = {}
    with ProbeTable(s.embeddings, s.units, [], list(binary)) as t:
        scores = materialize(t.score(t.fit(s.guard(t, t.cells([BASELINE], binary)))))
    point = ranking.ranking_metrics(scores, CELL).select(*CELL, "n", "n_pos", "auroc", "auprc")
    ci = resample.bootstrap_ci(scores, CELL, "auroc", b=b).select(*CELL, "ci_low", "ci_high")
    area = resample.bootstrap_ci(scores, CELL, "auprc", b=b).select(*CELL, F.col("ci_low").alias("auprc_low"), F.col("ci_high").alias("auprc_high"))
    out["binary"] = materialize(point.join(ci, CELL, "left").join(area, CELL, "left").withColumn("prevalence", F.col("n_pos") / F.col("n")))
    # weak decoding gets a permutation test
    weak = out["binary"].where(F.col("auroc").between(0.55, 0.65)).select(*CELL)
    out["permutation"] = materialize(resample.permutation_auroc(scores.join(weak, CELL, "left_semi"), CELL, "unit_id", b=b))
    models = sorted(r[0] for r in scores.select("model").distinct().collect())
    if len(models) > 1:
        pairs = ranking.delong(scores, ["target"], "unit_id", "model", models).withColumn("p_value", p_normal(F.col("z")))
        out["pairs"] = materialize(summary.benjamini_hochberg(pairs, [], small=True))
    for c in continuous:
        p = materialize(ridge_probe(s.embeddings, s.units, c))
        m = ranking.regression_metrics(p, ["model"])
        for metric in ("mae", "r2"):
            draws = resample.bootstrap_ci(p, ["model"], metric, b=b, unit="unit_id")
            m = m.join(draws.select("model", F.col("ci_low").alias(f"{metric}_low"), F.col("ci_high").alias(f"{metric}_high")), "model", "left")
        m = m.withColumn("target", F.lit(c))
        out["continuous"] = m if "continuous" not in out else out["continuous"].unionByName(m)
    if nonlinear is not None:
        with ProbeTable(s.embeddings, s.units, [], list(binary), feature_map=nonlinear) as t:
            a = ranking.auroc(t.score(t.fit(s.guard(t, t.cells([BASELINE], binary)))), CELL)
            out["nonlinear"] = materialize(a)
    return out


def dependence_scores(s: Study, attributes: Sequence[str] | None = None) -> tuple[ProbeTable, DataFrame]:
    """Scores of every finding with and without each attribute, all splits.

    Attributes known for every row share one baseline per (model, finding).
    """
    attributes = list(attributes or s.attributes)
    t = ProbeTable(s.embeddings, s.units, attributes, list(s.findings), keep=tuple(s.groups.values()))
    holes = s.units.select(*[F.count_if(F.col(a).isNull()).alias(a) for a in attributes]).first()
    variants = [BASELINE]
    for a in attributes:
        if holes[a]:
            variants.append(Variant(f"base|{a}", cohort=(a,)))
        variants.append(Variant(a, remove=(a,)))
    try:
        fitted = t.fit(s.guard(t, t.cells(variants, s.findings)))
        return t, t.score(fitted, ("train", "test"))
    except BaseException:
        t.close()
        raise


def dependence_matrix(s: Study, b: int = 1000, with_mcc: bool = False) -> dict[str, DataFrame]:
    """AUROC drop of every (model, attribute, finding) cell, with summary and price class (Q6, Q20)."""
    t, scores = dependence_scores(s)
    with t:
        keys = ["model", "variant", "target"]
        a = ranking.auroc(scores.where("split = 'test'"), keys).select(*keys, F.col("auroc").alias("v"))
        cells = materialize(_drops(a, s.attributes, "auroc"))
        if with_mcc:
            m = ranking.best_mcc(scores, keys).select(*keys, F.col("mcc").alias("v"))
            mcc = _drops(m, s.attributes, "mcc")
            cells = materialize(cells.join(mcc, ["model", "attribute", "finding"], "left"))
    means = summary.summarize(cells, ["attribute"], "auroc_drop")
    unit = F.concat_ws("|", "model", "finding")
    ci = resample.bootstrap_mean_exact(cells.withColumn("cell", unit), ["attribute"], "cell", "auroc_drop", b=b)
    from pyspark.sql import Window as W

    order = W.orderBy(F.col("mean_auroc_drop").desc(), F.col("attribute"))
    table = means.join(ci.select("attribute", "ci_low", "ci_high"), "attribute", "left").withColumn(
        "cost_tier", cost_tier(F.col("mean_auroc_drop"))
    ).withColumn("rank", F.row_number().over(order))
    top = summary.top_k_per_group(cells, ["model"], [F.col("auroc_drop").desc(), F.col("attribute"), F.col("finding")], 5)
    out = {"cells": cells, "summary": table, "top": top}
    if with_mcc:
        by = cells.groupBy("attribute").agg(F.avg("auroc_drop").alias("x"), F.avg("mcc_drop").alias("y"))
        out["agreement"] = spearman(by, [], "x", "y", small=True)
    return out


def _drops(a: DataFrame, attributes: Sequence[str], name: str) -> DataFrame:
    """Baseline minus residualized value per (model, attribute, finding)."""
    kind = F.when(F.col("variant") == "baseline", "shared").when(F.col("variant").startswith("base|"), "own").otherwise("after")
    attr = F.when(kind == "shared", F.array(*[F.lit(x) for x in attributes])).otherwise(
        F.array(F.regexp_replace("variant", r"^base\|", ""))
    )
    long = a.select("model", F.col("target").alias("finding"), F.explode(attr).alias("attribute"), kind.alias("kind"), "v")
    g = long.groupBy("model", "attribute", "finding").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(k) for k in ("shared", "own", "after")]
    )
    base = F.coalesce("own", "shared")
    return g.where(F.col("after").isNotNull()).select(
        "model", "attribute", "finding", base.alias(f"{name}_base"), F.col("after").alias(f"{name}_after"),
        (base - F.col("after")).alias(f"{name}_drop"),
    )


def confounding_study(s: Study, confounders: Sequence[str]) -> DataFrame:
    """Drop after OLS removal of the confounders, their own value, and a class per finding."""
    units = s.units
    for c in confounders:
        units = cohort.impute_median(units, c, F.col("split") == "train")
    conf = tuple(confounders)
    removed, alone = Variant("removed", remove=conf, alpha=0.0), Variant("alone", append=conf, use_x=False)
    with ProbeTable(s.embeddings, units, list(conf), list(s.findings)) as t:
        cells = s.guard(t, t.cells([BASELINE, removed, alone], s.findings))
        a = materialize(ranking.auroc(t.score(t.fit(cells)), ["model", "variant", "target"]))
        r2 = t.residual_r2(removed)
    wide = _pivot_variants(a, CELL, {"baseline": "original_auroc", "removed": "residualized_auroc", "alone": "confounder_auroc"})
    r2_rows = a.sparkSession.createDataFrame(list(r2.items()), "model string, embedding_r2 double")
    out = wide.withColumn("drop_residualization", F.col("original_auroc") - F.col("residualized_auroc")).withColumn(
        "added_value", F.col("original_auroc") - F.col("confounder_auroc")
    )
    return out.join(F.broadcast(r2_rows), "model").withColumn(
        "classification", classify_confounding(F.col("drop_residualization"), F.col("added_value"))
    )


def leak_check(s: Study, attribute: str, alpha: float = 0.0) -> DataFrame:
    """Decodability of an attribute from its own residual: should be about one half (M5)."""
    v = Variant("residual", remove=(attribute,), alpha=alpha)
    with ProbeTable(s.embeddings, s.units, [attribute], [attribute]) as t:
        return materialize(ranking.auroc(t.score(t.fit(t.cells([v], [attribute]))), ["model", "target"]))


def fusion_study(s: Study, meta: Sequence[str], b: int = 200) -> dict[str, DataFrame]:
    """Embedding, metadata and both together, with a paired bootstrap of the gain."""
    both = Variant("fusion", append=tuple(meta))
    only = Variant("meta", append=tuple(meta), use_x=False)
    plain = Variant("embedding", cohort=tuple(meta))
    with ProbeTable(s.embeddings, s.units, list(meta), list(s.findings)) as t:
        scores = materialize(t.score(t.fit(s.guard(t, t.cells([plain, only, both], s.findings)))))
        auc = materialize(ranking.auroc(scores, ["model", "variant", "target"]))
        wide = scores.groupBy("model", "target", "unit_id").agg(
            F.max("y").alias("y"), *[F.max(F.when(F.col("variant") == v, F.col("p"))).alias(v) for v in ("embedding", "fusion")]
        )
        delta = materialize(resample.bootstrap_delta(wide, CELL, "embedding", "fusion", b=b))
    tests = delta.withColumn("significant", F.col("p_value") < 0.05)
    overall = summary.with_overall(auc.withColumn("seed", F.lit(0)), ["model", "variant"], "target", "seed", "auroc")
    return {"aurocs": overall, "delta": tests, "significant": summary.significant_counts(tests, ["model"], "significant")}


def simultaneous_study(s: Study, attributes: Sequence[str]) -> dict[str, DataFrame]:
    """Single against joint removal and the redundancy between attributes."""
    cohort_cols = tuple(attributes)
    variants = [Variant("base", cohort=cohort_cols), Variant("joint", remove=cohort_cols)]
    variants += [Variant(f"single_{a}", remove=(a,), cohort=cohort_cols) for a in attributes]
    with ProbeTable(s.embeddings, s.units, list(attributes), list(s.findings)) as t:
        a = materialize(ranking.auroc(t.score(t.fit(s.guard(t, t.cells(variants, s.findings)))), ["model", "variant", "target"]))
    names = {v.name: v.name for v in variants}
    wide = _pivot_variants(a, CELL, names)
    drops = wide.select(*CELL, "base", *[(F.col("base") - F.col(v.name)).alias(f"drop_{v.name}") for v in variants[1:]])
    cells = summary.redundancy(drops, [f"drop_single_{a}" for a in attributes], "drop_joint")
    return {"cells": cells, "test": one_sample_t(cells, [], "redundancy")}


def erasure_study(s: Study, attributes: Sequence[str], feature_map: FourierMap | None = None, max_rounds: int = 25) -> DataFrame:
    """Nullspace erasure with a random control, in the plain or the Fourier space.

    `rounds`, `val_auroc` and `reached` tell how the search for directions ended.
    """
    targets = list(dict.fromkeys([*attributes, *s.findings]))
    with ProbeTable(s.embeddings, s.units, [], targets, feature_map=feature_map) as t:
        return erase(t, s, attributes, max_rounds)


def erase(t: ProbeTable, s: Study, attributes: Sequence[str], max_rounds: int = 25, baseline: Fitted | None = None) -> DataFrame:
    """The erasure of `erasure_study` on a table of probes.

    The probes without any removal are fitted in the scans of the search's first round, but for those that `baseline` holds.
    """
    t._need_moments([()])
    for m in t.models:
        t.spectrum(m)
    bare = t.guard(t.cells([BASELINE], s.findings))
    done = Fitted([], [], [], []) if baseline is None else baseline.only(bare)
    first = t.fit([*first_cells(t, attributes), *[c for c in bare if c not in done.cells]])
    ends: dict = {}
    found, log = nullspace_directions(t, attributes, max_rounds, ends=ends, first=first)
    baseline = done.joined(first.only(bare))
    out = materialize(erasure_effects(t, found, s.findings, baseline=baseline, ends=ends))
    ends = out.sparkSession.createDataFrame(
        [(*k, *v) for k, v in last_values(log).items()], "model string, attribute string, rounds int, val_auroc double, reached boolean"
    )
    return out.join(ends, ["model", "attribute"], "left").withColumn("space", F.lit("raw" if t.map is None else "rff"))


def nonlinear_use(s: Study, attribute: str, feature_map: FourierMap, network: Network = Network()) -> dict[str, DataFrame]:
    """Nonlinear decodability and use of an attribute after linear removal.

    Three decoders side by side: linear, linear over Fourier features, and a two-layer network.
    """
    removed = Variant("removed", remove=(attribute,), alpha=0.0)
    known = s.units.where(F.col(attribute).isNotNull())
    targets = list(dict.fromkeys([attribute, *s.findings]))
    keys = ["model", "variant", "target"]

    def named(scores: DataFrame, name: str) -> DataFrame:
        return materialize(ranking.auroc(scores, keys, weight="w").withColumn("variant", F.concat_ws(":", F.lit(name), "variant")))

    with ProbeTable(s.embeddings, known, [attribute], targets) as t:
        cells = s.guard(t, t.cells([BASELINE, removed], targets))
        plain = [c for c in cells if c.variant == BASELINE]

        def curved(name: str, before: Variant | None) -> DataFrame:
            u = t.mapped(feature_map, before)
            return named(u.group_scores(u.fit(plain)), name)

        t._need_moments([(), removed.needs])  # read by all four
        parts = together(
            lambda: named(network_group_scores(t, fit_network(t, cells, network)), "network"),
            lambda: curved("nonlinear", None), lambda: curved("nonlinear_removed", removed),
            lambda: named(t.group_scores(t.fit(cells)), "linear"),
        )
    wide = _pivot_variants(functools.reduce(DataFrame.unionByName, parts), CELL, {
        "nonlinear:baseline": "nonlinear_base", "nonlinear_removed:baseline": "nonlinear_after",
        "linear:baseline": "linear_base", "linear:removed": "linear_after",
        "network:baseline": "network_base", "network:removed": "network_after",
    })
    drops = {f"{k}_dependence": F.col(f"{k}_base") - F.col(f"{k}_after") for k in ("nonlinear", "linear", "network")}
    return {"decodability": wide.where(F.col("target") == attribute), "use": wide.where(F.col("target") != attribute).withColumns(drops)}


def nonlinear_residualization(s: Study, column: str, n_knots: int = 5) -> dict[str, DataFrame]:
    """Linear against piecewise-linear removal of a continuous attribute, and their agreement."""
    from ..operators.running import exact_quantiles

    probs = {f"q{i}": (i + 1) / (n_knots + 1) for i in range(n_knots)}
    cuts = exact_quantiles(s.units.where("split = 'train'"), [], column, probs).first()
    units, basis = hinge_basis(s.units, column, [cuts[k] for k in probs])
    variants = [Variant("base", cohort=(column,)), Variant("linear", remove=(column,)), Variant("curved", remove=tuple(basis))]
    with ProbeTable(s.embeddings, units, basis, list(s.findings)) as t:
        a = materialize(ranking.auroc(t.score(t.fit(s.guard(t, t.cells(variants, s.findings)))), ["model", "variant", "target"]))
    wide = _pivot_variants(a, CELL, {"base": "base", "linear": "linear", "curved": "curved"})
    cells = wide.select(*CELL, (F.col("base") - F.col("linear")).alias("linear_drop"), (F.col("base") - F.col("curved")).alias("curved_drop"))
    return {"cells": cells, "agreement": spearman(cells, [], "linear_drop", "curved_drop", small=True)}


def _class_code(category: str, classes: Sequence[str]) -> Column:
    """The place of a category in the list of classes; null outside it."""
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(category).cast("string"))


def _decoders(t: ProbeTable, category: str, classes: Sequence[str], pair: tuple[str, str] | None) -> DataFrame:
    """Multinomial decodability per model (M10, A9), and that of a pair of classes by a probe of its own."""
    probs = score_softmax(t, fit_softmax(t, t.cells([BASELINE], ["__code"]), len(classes)))
    wide = probs.select("model", category, *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(classes)])
    out = ranking.ovr_auroc(wide, ["model"], category, {c: f"p_{c}" for c in classes})
    if pair is not None:
        two = ranking.auroc(t.score(t.fit(t.cells([BASELINE], ["__pair"]))), ["model"])
        out = out.join(two.select("model", F.col("auroc").alias(f"auroc_{pair[0]}_vs_{pair[1]}")), "model", "left")
    return out


def _with_codes(units: DataFrame, category: str, classes: Sequence[str], pair: tuple[str, str] | None) -> DataFrame:
    code = _class_code(category, classes)
    units = units.withColumns({"__code": F.when(code > 0, code - 1), "__known": F.when(code > 0, 1.0)})
    flag = F.lit(None).cast("int") if pair is None else F.when(F.col(category).isin(*pair), (F.col(category) == pair[0]).cast("int"))
    return units.withColumn("__pair", flag)


def category_probe(s: Study, category: str, classes: Sequence[str], pair: tuple[str, str] | None = None) -> DataFrame:
    """Multinomial decodability of a category: per-class, macro and two-class AUROC.

    One softmax cell per model, all trained in the same scans.
    """
    units = _with_codes(s.units.where(F.col(category).isin(*classes)), category, classes, pair)
    with ProbeTable(s.embeddings, units, [], ["__code", "__pair"], keep=(category,)) as t:
        return materialize(_decoders(t, category, classes, pair))


def category_odds(units: DataFrame, category: str, pair: tuple[str, str], findings: Sequence[str]) -> DataFrame:
    """Odds ratio of every finding between two classes on train units, always corrected (Q7, A2)."""
    flag = F.when(F.col(category).isin(*pair), (F.col(category) == pair[0]).cast("int"))
    return odds.odds_ratio(odds.contingency(units.where("split = 'train'").withColumn("pair", flag), ["pair"], list(findings)), "always")


def category_study(
    s: Study, category: str, classes: Sequence[str], pair: tuple[str, str], min_group: int = 30, min_group_pos: int = 5, alpha: float = 1.0
) -> dict[str, DataFrame]:
    """A category as attribute: decodability, dependence, odds and group gaps from one table (Q7).

    decoding: multinomial and two-class AUROC. dependence: findings with and
    without the pair's flag removed, on units of the two classes. odds: the pair's
    odds ratio per finding on train. groups, gaps: AUROC per class of probes
    trained on all units of a known class, and their max-min gap.
    """
    units = _with_codes(s.units, category, classes, pair)
    flag, known = ("__pair",), ("__known",)
    variants = [Variant("baseline", cohort=flag), Variant("removed", remove=flag, alpha=alpha), Variant("known", cohort=known)]
    with ProbeTable(s.embeddings, units, ["__pair", "__known"], [*s.findings, "__code", "__pair"], keep=(category,)) as t:
        decoding = materialize(_decoders(t, category, classes, pair))
        scores = materialize(t.score(t.fit(s.guard(t, t.cells(variants, s.findings)))))
    of_pair = scores.where("variant <> 'known'")
    wide = _pivot_variants(ranking.auroc(of_pair, ["model", "variant", "target"]), CELL, {"baseline": "auroc_base", "removed": "auroc_after"})
    groups = materialize(fairness.subgroup_auroc(
        scores.where("variant = 'known'"), CELL, category, min_group, min_group_pos, min_group_pos
    ).select(*CELL, category, "n", "n_pos", "auroc"))
    return {
        "decoding": decoding,
        "dependence": wide.withColumn("auroc_drop", F.col("auroc_base") - F.col("auroc_after")),
        "odds": category_odds(s.units, category, pair, s.findings),
        "groups": groups,
        "gaps": fairness.gap(groups, CELL, category),
    }


def debiasing_study(s: Study, strategies: dict[str, Sequence[str]], b: int = 1000, min_n: int = 50, min_pos: int = 15, min_neg: int = 15) -> dict[str, DataFrame]:
    """Subgroup gap and overall AUROC before and after removing attribute sets."""
    designs = sorted({a for v in strategies.values() for a in v})
    variants = [Variant("baseline", cohort=tuple(designs))]
    variants += [Variant(k, remove=tuple(v), cohort=tuple(designs)) for k, v in strategies.items()]
    groups = list(s.groups.values())
    with ProbeTable(s.embeddings, s.units, designs, list(s.findings), keep=groups) as t:
        scores = materialize(t.score(t.fit(s.guard(t, t.cells(variants, s.findings)))))
        keys = ["model", "variant", "target"]
        dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("grp")) for d, c in s.groups.items()])
        long = scores.select(*keys, "unit_id", "y", "p", F.explode(dims).alias("d")).select(*keys, "unit_id", "y", "p", "d.*")
        per = fairness.subgroup_auroc(long.where(F.col("grp").isNotNull()), [*keys, "dimension"], "grp", min_n, min_pos, min_neg)
        gaps = materialize(fairness.gap(per, [*keys, "dimension"]))
        overall = materialize(ranking.auroc(scores, keys))
    change = fairness.before_after(gaps, ["model", "target", "dimension"], "variant", "baseline", "gap")
    cost = fairness.before_after(overall, CELL, "variant", "baseline", "auroc")
    ci = resample.bootstrap_mean_exact(
        change.withColumn("cell", F.concat_ws("|", "model", "target", "dimension")), ["variant", "dimension"], "cell", "reduction", b=b
    )
    return {"gaps": gaps, "change": change, "cost": cost, "summary": ci}


def gap_decomposition(s: Study, category: str, levels: Sequence[str], drop: str, others: Sequence[str], b: int = 1000, **guards) -> dict[str, DataFrame]:
    """Gaps between categories with nothing, the category's block, other attributes, or both removed, on one cohort (M7, Q21).

    Adds `decomposition`: per condition the mean gap, and its change against nothing removed.
    """
    block = one_hot_columns(category, levels, drop)
    units = s.units.dropna(subset=[category, *others]).withColumns(block)
    one = replace(s, units=units, groups={category: category})
    out = debiasing_study(one, {"block": list(block), "others": list(others), "joint": [*block, *others]}, b=b, **guards)
    mean = out["gaps"].groupBy("variant").agg(F.count("gap").alias("n_cells"), F.avg("gap").alias("mean_gap"))
    base = mean.where("variant = 'baseline'").select("mean_gap").scalar()
    out["decomposition"] = mean.withColumn("change_pct", 100 * (F.col("mean_gap") / base - 1))
    return out
