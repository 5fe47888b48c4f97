"""Scaling, residualization, geometry, probe and erasure queries on the embeddings table."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from attraudit.functions.labels import one_hot_columns
from attraudit.functions.rand import uniform
from attraudit.operators import linear, probes, ranking
from attraudit.plans import external, representation as plans
from attraudit.plans.inputs import Study, build_cohort
from attraudit.operators.probes import BASELINE, FourierMap, ProbeTable, Variant

from attraudit.session import materialize

from .base import COUNTS_SQL, U_SQL, UNITS_SQL, labelled, labelled_sql, query, r, read, split_col, units


def vectors(spark, sf):
    """Two models: the two halves of every vector."""
    e = read(spark, sf, "embeddings")
    halves = F.array(
        F.struct(F.lit("a").alias("model"), F.slice("embedding", 1, 32).alias("embedding")),
        F.struct(F.lit("b").alias("model"), F.slice("embedding", 33, 32).alias("embedding")),
    )
    return e.select(F.col("vec_id").alias("unit_id"), "label", F.explode(halves).alias("h")).select("unit_id", "label", "h.*")


def vector_units(spark, sf):
    e, l = read(spark, sf, "embeddings"), read(spark, sf, "labels")
    u = uniform(42, "vec_id")
    return e.join(l, e.vec_id == l.doc_id, "left").select(
        F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("entity_id"), split_col(u).alias("split"),
        (F.col("label") % 2).alias("parity"), F.when(F.col("label") != 3, F.col("label").cast("double")).alias("size"),
        (F.col("label") >= 5).cast("int").alias("high"), F.col("quality"), F.col("label").cast("double").alias("value"),
        F.concat(F.lit("g"), F.col("label") % 3).alias("grp"),
    )


V = """v AS (SELECT vec_id, label, label % 2 AS parity, ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
d AS (SELECT *, CASE WHEN k <= 32 THEN 'a' ELSE 'b' END AS model, ((k - 1) % 32)::INTEGER AS i FROM v)"""


@query("embedding_scaler", f"""WITH {V} SELECT model, i, count(*) AS n, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'sd')} FROM d WHERE u < 0.7::DOUBLE GROUP BY model, i""")
def embedding_scaler(spark, sf):
    tr = vectors(spark, sf).where(uniform(42, "unit_id") < 0.7)
    s = linear.fit_scaler(tr)
    z = F.arrays_zip("mean", "sd")
    return s.select("model", "n", F.posexplode(z).alias("i", "z")).select("model", "i", "n", "z.mean", "z.sd")


@query("embedding_scaled", f"""WITH {V}, s AS (SELECT model, i, avg(x) AS m, stddev_pop(x) AS s FROM d WHERE u < 0.7::DOUBLE GROUP BY ALL)
SELECT d.model, d.i, {r('avg((x - m) / s)', 'mean')}, {r('avg(((x - m) / s) ** 2)', 'mean_square')} FROM d JOIN s ON d.model = s.model AND d.i = s.i WHERE u >= 0.7::DOUBLE GROUP BY ALL""")
def embedding_scaled(spark, sf):
    v = vectors(spark, sf).withColumn("u", uniform(42, "unit_id"))
    z = linear.scale(v.where("u >= 0.7"), linear.fit_scaler(v.where("u < 0.7")))
    return z.select("model", F.posexplode("embedding").alias("i", "x")).groupBy("model", "i").agg(
        F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("mean_square")
    )


def _resid_sql(alpha: str) -> str:
    return f"""WITH {V}, f AS (SELECT model, i, avg(x) AS mx, avg(parity) AS md, covar_pop(x, parity) * count(*) AS sxd, var_pop(parity) * count(*) AS sdd FROM d WHERE u < 0.7::DOUBLE GROUP BY ALL)
SELECT d.model, d.i, {r(f'avg((x - mx - (parity - md) * sxd / (sdd + {alpha})) ** 2)', 'mean_square', 8)}, {r(f'avg((x - mx - (parity - md) * sxd / (sdd + {alpha})) * parity)', 'mean_with_attribute', 8)}
FROM d JOIN f ON d.model = f.model AND d.i = f.i WHERE u >= 0.7::DOUBLE GROUP BY ALL"""


def _resid(spark, sf, alpha):
    res = linear.residualize(vectors(spark, sf), vector_units(spark, sf), ["parity"], alpha, keep=("unit_id", "split", "f"))
    z = res.where("split <> 'train'").select("model", F.col("f")[0].alias("d"), F.posexplode("residual").alias("i", "x"))
    return z.groupBy("model", "i").agg(
        F.avg(F.col("x") * F.col("x")).alias("mean_square"), F.avg(F.col("x") * F.col("d")).alias("mean_with_attribute")
    )


query("residualize_ridge", _resid_sql("1.0::DOUBLE"), digits=8)(lambda spark, sf: _resid(spark, sf, 1.0))
query("residualize_ols", _resid_sql("0.0::DOUBLE"), digits=8)(lambda spark, sf: _resid(spark, sf, 0.0))


@query("residual_r2", f"""WITH {V}, f AS (SELECT model, i, covar_pop(x, parity) ** 2 / var_pop(parity) AS e, var_pop(x) AS t FROM d WHERE u < 0.7::DOUBLE GROUP BY ALL)
SELECT model, {r('sum(e) / sum(t)', 'r2')} FROM f GROUP BY model""")
def residual_r2(spark, sf):
    rows = linear.feature_rows(vectors(spark, sf), vector_units(spark, sf), ["parity"], [])
    maps = linear.ridge_map(rows.where("split = 'train'"), 0.0)
    return spark.createDataFrame([(m, v["r2"]) for m, v in maps.items()], "model string, r2 double")


@query("geometry_sums", f"""WITH {V}, c AS (SELECT a.model, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM d a JOIN d b ON a.model = b.model AND a.vec_id = b.vec_id GROUP BY ALL),
n AS (SELECT model, vec_id, sqrt(sum(x * x)) AS l FROM d GROUP BY ALL), u AS (SELECT d.model, i, sum(x / l) AS s, count(*) AS n FROM d JOIN n ON d.model = n.model AND d.vec_id = n.vec_id GROUP BY ALL),
w AS (SELECT model, (sum(s * s) - max(n)) / (max(n)::DOUBLE * (max(n) - 1)) AS cosine FROM u GROUP BY model)
SELECT model, 32::INTEGER AS ambient_dim, {r('sum(CASE WHEN i = j THEN c END) ** 2 / sum(c * c)', 'participation_ratio')}, {r('max(cosine)', 'avg_cosine_similarity')} FROM c JOIN w USING (model) GROUP BY model""")
def geometry_sums(spark, sf):
    return linear.geometry(vectors(spark, sf)).select("model", "ambient_dim", "participation_ratio", "avg_cosine_similarity")


@query("geometry")
def geometry(spark, sf):
    return linear.geometry(vectors(spark, sf))


@query("project_out", f"""WITH {V}, q AS (SELECT *, sum(CASE WHEN i IN (0, 1) THEN x / sqrt(2.0::DOUBLE) ELSE 0 END) OVER (PARTITION BY model, vec_id) AS c FROM d)
SELECT model, i, {r("avg((CASE WHEN i IN (0, 1) THEN x - c / sqrt(2.0::DOUBLE) ELSE x END) ** 2)", 'mean_square', 8)} FROM q GROUP BY ALL""", digits=8)
def project_out(spark, sf):
    q = np.zeros((32, 1))
    q[:2] = 1 / np.sqrt(2)
    rows = linear.feature_rows(vectors(spark, sf), vector_units(spark, sf), [], [])
    z = linear.project_out(rows, {"a": q, "b": q}).select("model", F.posexplode("projected").alias("i", "x"))
    return z.groupBy("model", "i").agg(F.avg(F.col("x") * F.col("x")).alias("mean_square"))


@query("seed_ensemble", """WITH l AS (SELECT o_orderkey AS unit_id, (o_totalprice / 100000 + o_orderkey % 3 - s) / 2 AS z, s FROM orders, (SELECT unnest(range(3)) AS s)),
m AS (SELECT unit_id, avg(z) AS z FROM l GROUP BY unit_id)
SELECT unit_id, round(1 / (1 + exp(-z)), 6) AS p, 1 AS y FROM m""")
def seed_ensemble(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    logit = (F.col("o_totalprice") / 100000 + F.col("unit_id") % 3 - F.col("s")) / 2
    return probes.ensemble(o.select("unit_id", logit.alias("logit"), F.lit(1).alias("y")), ["unit_id"])


@query("ridge_probe")
def ridge_probe(spark, sf):
    p = probes.ridge_probe(vectors(spark, sf), vector_units(spark, sf), "value")
    return ranking.regression_metrics(p, ["model"])


# ---- studies on all orders: customers share the vectors by the remainder of their number ----

ATTRS = ["building", "in_debt", "low_nation"]
FINDS = ["fulfilled", "urgent", "winter"]


def study(spark, sf) -> Study:
    u = labelled(spark, sf, "ignore")
    u = u.withColumn("split", split_col(uniform(42, "entity_id"))).withColumn("rich", (F.col("balance") > 5000).cast("int"))
    size = read(spark, sf, "embeddings").agg(F.max("vec_id") + 1).scalar()
    v = vectors(spark, sf).withColumnRenamed("unit_id", "vec")
    emb = u.select("unit_id", (F.col("entity_id") % size).alias("vec")).join(v, "vec").select("model", "unit_id", "embedding")
    return Study(emb, u, ATTRS, FINDS, {"segment": "grp", "rich": "rich"}, min_train=30, min_test=20, min_pos=5)


@query("probe_scores_auroc")
def probe_scores(spark, sf):
    s = study(spark, sf)
    with ProbeTable(s.embeddings, s.units, ["building"], FINDS, keep=("grp",)) as t:
        scores = t.score(t.fit(t.cells([BASELINE, Variant("building", remove=("building",))], FINDS)), ("train", "test"))
        return materialize(ranking.auroc(scores, ["model", "variant", "target", "split"]))


@query("probe_class_weights")
def probe_class_weights(spark, sf):
    s = study(spark, sf)
    with ProbeTable(s.embeddings, s.units, [], FINDS) as t:
        return materialize(ranking.calibration(t.score(t.fit(t.cells([BASELINE], FINDS), balanced=True)), ["model", "target"]))


@query("encoding_study")
def encoding_study(spark, sf):
    out = plans.encoding_study(study(spark, sf), ["building", "in_debt", "rich"], ["age"])
    return out["binary"].select("model", "target", "n", "auroc", "ci_low", "ci_high", "auprc", "prevalence")


@query("encoding_pairs")
def encoding_pairs(spark, sf):
    out = plans.encoding_study(study(spark, sf), ["building", "in_debt"])
    return out["pairs"].drop("variance")


@query("dependence_report")
def dependence_report(spark, sf):
    return plans.dependence_matrix(study(spark, sf))["summary"]


@query("dependence_cells")
def dependence_cells(spark, sf):
    return plans.dependence_matrix(study(spark, sf), with_mcc=True)["cells"]


@query("confounding_study")
def confounding_study(spark, sf):
    s = study(spark, sf)
    return plans.confounding_study(s, ["age", "building"])


@query("leak_check")
def leak_check(spark, sf):
    return plans.leak_check(study(spark, sf), "building")


@query("fusion_study")
def fusion_study(spark, sf):
    return plans.fusion_study(study(spark, sf), ["building", "in_debt"])["delta"]


@query("simultaneous_removal")
def simultaneous_removal(spark, sf):
    return plans.simultaneous_study(study(spark, sf), ["building", "in_debt"])["cells"]


@query("debiasing_gaps")
def debiasing_gaps(spark, sf):
    out = plans.debiasing_study(study(spark, sf), {"top": ["building"], "all": ATTRS}, min_n=20, min_pos=5, min_neg=5)
    return out["change"]


@query("gap_decomposition")
def gap_decomposition(spark, sf):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = plans.gap_decomposition(study(spark, sf), "grp", levels, "AUTOMOBILE", ["in_debt", "low_nation"], min_n=20, min_pos=5, min_neg=5)
    return out["decomposition"]


@query("one_hot_columns", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS grp_is_BUILDING, (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS grp_is_MACHINERY FROM customer")
def one_hot_block_columns(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp"))
    return c.withColumns(one_hot_columns("grp", ["AUTOMOBILE", "BUILDING", "MACHINERY"], "AUTOMOBILE")).drop("grp")


@query("concept_erasure")
def concept_erasure(spark, sf):
    return plans.erasure_study(study(spark, sf), ATTRS)


@query("concept_erasure_fourier")
def concept_erasure_fourier(spark, sf):
    return plans.erasure_study(study(spark, sf), ATTRS, FourierMap())


@query("nonlinear_use")
def nonlinear_use(spark, sf):
    return plans.nonlinear_use(study(spark, sf), "building", FourierMap())["use"]


@query("nonlinear_decodability")
def nonlinear_decodability(spark, sf):
    return plans.nonlinear_use(study(spark, sf), "building", FourierMap())["decodability"]


@query("nonlinear_residualization")
def nonlinear_residualization(spark, sf):
    return plans.nonlinear_residualization(study(spark, sf), "age", 3)["cells"]


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PAIR = ("BUILDING", "FURNITURE")


@query("category_probe")
def category_probe(spark, sf):
    return plans.category_probe(study(spark, sf), "grp", SEGMENTS, PAIR)


@query("category_dependence")
def category_dependence(spark, sf):
    return plans.category_study(study(spark, sf), "grp", SEGMENTS, PAIR)["dependence"]


@query("category_gaps")
def category_gaps(spark, sf):
    return plans.category_study(study(spark, sf), "grp", SEGMENTS, PAIR)["gaps"]


_PAIR_FINDINGS = " UNION ALL ".join(f"SELECT '{f}' AS finding, a, {f} AS y FROM t" for f in FINDS)
_ODDS = "((tp + 0.5::DOUBLE) * (tn + 0.5::DOUBLE)) / ((fp + 0.5::DOUBLE) * (fn + 0.5::DOUBLE))"


@query("category_odds", "WITH " + UNITS_SQL + ", " + labelled_sql("ignore") + f""", t AS (SELECT *, (grp = 'BUILDING')::INT AS a FROM lab WHERE {U_SQL} < 0.7::DOUBLE AND grp IN ('BUILDING', 'FURNITURE')),
l AS ({_PAIR_FINDINGS}), c AS (SELECT finding, {COUNTS_SQL} FROM l GROUP BY finding)
SELECT 'pair' AS attribute, finding, tp, fp, fn, tn, {r(_ODDS, 'odds_ratio')}, {r(f'ln({_ODDS})', 'log_or')}, {r(f'abs(ln({_ODDS}))', 'abs_log_or')} FROM c""")
def category_odds(spark, sf):
    s = study(spark, sf)
    return plans.category_odds(s.units, "grp", PAIR, s.findings)


@query("cohort_build", f"""WITH ids AS (SELECT DISTINCT c_custkey AS entity_id, c_mktsegment AS grp FROM orders JOIN customer ON o_custkey = c_custkey JOIN embeddings ON vec_id = c_custkey % (SELECT max(vec_id) + 1 FROM embeddings)),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('42:' || entity_id)) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM ids),
s AS (SELECT entity_id, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' WHEN pos < floor(0.85::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM o)
SELECT split, count(*) AS n_units, count(DISTINCT entity_id) AS n_entities, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS n_fulfilled
FROM orders JOIN s ON o_custkey = entity_id GROUP BY split""")
def cohort_build(spark, sf):
    s = study(spark, sf)
    c = build_cohort(s.embeddings, units(spark, sf), FINDS, stratum="grp")
    return c.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_distinct("entity_id").alias("n_entities"), F.count("fulfilled").alias("n_fulfilled")
    )


@query("external_study")
def external_study(spark, sf):
    return external.external_study(study(spark, sf))["external"]


@query("external_extended")
def external_extended(spark, sf):
    return external.external_extended(study(spark, sf), ATTRS, "grp", FourierMap())["summary"]
