"""Label policies, bins, splits, eligibility and cohort queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from attraudit.functions.classify import cost_tier, format_ci, format_delta, safe_abs_log
from attraudit.functions.labels import (
    CategoryRules, apply_policy, assign_bins, assign_values, collapse_category, contrast, one_hot, split_at,
)
from attraudit.functions.rand import hash_u32, poisson_one, uniform
from attraudit.operators import cohort

from .base import BINARY, FINDINGS, U_SQL, UNITS_SQL, labelled, labelled_sql, query, r, read, units

U = f"WITH {UNITS_SQL}"


def _finding_rows(df):
    return df.select("unit_id", "entity_id", *[F.col(f).cast("double").alias(f) for f in FINDINGS]).unpivot(
        ["unit_id", "entity_id"], FINDINGS, "finding", "raw"
    )


RAW_SQL = "raws AS (" + " UNION ALL ".join(
    f"SELECT unit_id, entity_id, '{f}' AS finding, {f} AS raw FROM units" for f in FINDINGS
) + ")"


@query("label_policies", f"""{U}, {RAW_SQL}
SELECT finding, count(*) AS n, count(*) FILTER (WHERE raw IN (0,1)) AS ignore_n, count(*) FILTER (WHERE raw = 1) AS ignore_pos,
  count(*) AS zero_n, count(*) FILTER (WHERE raw = 1) AS zero_pos,
  count(raw) AS blank_n, count(*) FILTER (WHERE raw = 1) AS blank_pos FROM raws GROUP BY finding""")
def label_policies(spark, sf):
    rows = _finding_rows(units(spark, sf))
    aggs = [F.count(F.lit(1)).alias("n")]
    for policy, name in (("ignore", "ignore"), ("zero", "zero"), ("blank_dropped", "blank")):
        y = apply_policy(F.col("raw"), policy)
        aggs += [F.count(y).alias(f"{name}_n"), F.sum(y).cast("bigint").alias(f"{name}_pos")]
    return rows.groupBy("finding").agg(*aggs)


RULES = CategoryRules(
    prefixes=(("SMALL", "Small"), ("RED", "Red"), ("BLUE", "Blue")), exact=(("LARGE BOX", "Small"),),
    unknown=("GREEN BOX", "GREEN RING"),
)


@query("collapse_category", """SELECT CASE WHEN p_name IS NULL THEN 'Unknown' WHEN upper(p_name) = 'LARGE BOX' THEN 'Small'
  WHEN upper(p_name) LIKE 'SMALL%' THEN 'Small' WHEN upper(p_name) LIKE 'RED%' THEN 'Red' WHEN upper(p_name) LIKE 'BLUE%' THEN 'Blue'
  WHEN upper(p_name) IN ('GREEN BOX', 'GREEN RING') THEN 'Unknown' ELSE 'Other' END AS category, count(*) AS n FROM part GROUP BY 1""")
def category(spark, sf):
    p = read(spark, sf, "part")
    return p.groupBy(collapse_category(F.col("p_name"), RULES).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("complete_case", f"""{U} SELECT count(*) AS n, {r('avg(age)', 'mean_age')} FROM units
WHERE age IS NOT NULL AND low_nation IS NOT NULL AND urgent IS NOT NULL""")
def complete_case(spark, sf):
    return units(spark, sf).dropna(subset=["age", "low_nation", "urgent"]).agg(
        F.count(F.lit(1)).alias("n"), F.avg("age").alias("mean_age")
    )


@query("age_bins", f"""{U} SELECT CASE WHEN age IS NULL THEN 'missing' WHEN age >= 0 AND age < 50 THEN '<50'
  WHEN age >= 50 AND age < 70 THEN '50-70' WHEN age >= 70 AND age < 200 THEN '70+' ELSE 'missing' END AS age_group,
  CASE building WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS building, count(*) AS n FROM units GROUP BY 1, 2""")
def age_bins(spark, sf):
    return units(spark, sf).groupBy(
        assign_bins(F.col("age"), [0, 50, 70, 200], ["<50", "50-70", "70+"], "missing").alias("age_group"),
        assign_values(F.col("building"), {1: "yes", 0: "no"}).alias("building"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _median_split(op, missing):
    def fn(spark, sf):
        u = units(spark, sf)
        med = cohort.median_cut(u, "age", ["grp"])
        side = split_at(F.col("age"), F.col("median"), op, missing)
        return u.join(med, "grp").groupBy("grp").agg(
            F.max("median").alias("median"), F.count_if(side == 1).alias("high"), F.count_if(side == 0).alias("low"),
            F.count_if(side.isNull()).alias("missing"),
        )
    return fn


_MED = f"{U}, m AS (SELECT grp, quantile_cont(age, 0.5) AS median FROM units GROUP BY grp)"
query("median_split_ge", f"""{_MED} SELECT grp, {r('max(median)', 'median')}, count(*) FILTER (WHERE age >= median) AS high,
 count(*) FILTER (WHERE age < median) AS low, count(*) FILTER (WHERE age IS NULL) AS missing
 FROM units JOIN m USING (grp) GROUP BY grp""")(_median_split(">=", None))
query("median_split_gt", f"""{_MED} SELECT grp, {r('max(median)', 'median')}, count(*) FILTER (WHERE age > median) AS high,
 count(*) FILTER (WHERE age <= median OR age IS NULL) AS low, 0::BIGINT AS missing
 FROM units JOIN m USING (grp) GROUP BY grp""")(_median_split(">", 0))


@query("train_zscore", f"""{U}, s AS (SELECT *, {U_SQL} AS u FROM units),
f AS (SELECT avg(age) AS m, stddev_pop(age) AS s FROM s WHERE u < 0.7::DOUBLE)
SELECT grp, {r('avg((age - f.m) / f.s)', 'mean_z')}, {r('stddev_pop((age - f.m) / f.s)', 'sd_z')} FROM s, f GROUP BY grp""")
def train_zscore(spark, sf):
    u = units(spark, sf)
    z = cohort.zscore(u, "age", uniform(42, "entity_id") < 0.7, "z")
    return z.groupBy("grp").agg(F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("sd_z"))


@query("impute_median", f"""{U}, m AS (SELECT quantile_cont(age, 0.5) AS m FROM units WHERE {U_SQL} < 0.7::DOUBLE)
SELECT grp, {r('avg(coalesce(age, m))', 'mean_age')}, count(*) FILTER (WHERE age IS NULL) AS n_filled FROM units, m GROUP BY grp""")
def impute_median(spark, sf):
    u = units(spark, sf).withColumn("was", F.col("age"))
    return cohort.impute_median(u, "age", uniform(42, "entity_id") < 0.7).groupBy("grp").agg(
        F.avg("age").alias("mean_age"), F.count_if(F.col("was").isNull()).alias("n_filled")
    )


@query("metadata_vector", f"""{U}, tr AS (SELECT * FROM units WHERE {U_SQL} < 0.7::DOUBLE),
m AS (SELECT quantile_cont(age, 0.5) AS m FROM tr),
f AS (SELECT avg(coalesce(age, m)) AS a, stddev_pop(coalesce(age, m)) AS s FROM tr, m),
g AS (SELECT avg(price) AS a, stddev_pop(price) AS s FROM tr)
SELECT grp, 4::BIGINT AS width, {r('avg((coalesce(age, m.m) - f.a) / f.s)', 'v1', 5)}, {r('avg((price - g.a) / g.s)', 'v2', 5)},
 {r('avg(building::DOUBLE)', 'v3', 5)}, {r('avg(coalesce(low_nation, 0)::DOUBLE)', 'v4', 5)}
FROM units, m, f, g GROUP BY grp""", digits=5)
def metadata_vector(spark, sf):
    v = cohort.metadata_vector(units(spark, sf), ["age", "price"], ["building", "low_nation"], uniform(42, "entity_id") < 0.7)
    return v.groupBy("grp").agg(
        F.max(F.size("meta")).cast("bigint").alias("width"), *[F.avg(F.col("meta")[i]).alias(f"v{i + 1}") for i in range(4)]
    )


@query("one_hot_block", """SELECT sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END) AS h1,
 sum(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0 END) AS h2, count(*) AS n FROM customer""")
def one_hot_block(spark, sf):
    h = one_hot(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "FURNITURE"], drop="AUTOMOBILE")
    return read(spark, sf, "customer").select(h.alias("h")).agg(
        F.sum(F.col("h")[0]).alias("h1"), F.sum(F.col("h")[1]).alias("h2"), F.count(F.lit(1)).alias("n")
    )


@query("contrast_subset", f"""{U} SELECT CASE grp WHEN 'BUILDING' THEN 1 ELSE 0 END AS a, count(*) AS n FROM units
WHERE grp IN ('BUILDING', 'FURNITURE') GROUP BY 1""")
def contrast_subset(spark, sf):
    u = units(spark, sf).withColumn("a", contrast(F.col("grp"), "BUILDING", "FURNITURE")).where(F.col("a").isNotNull())
    return u.groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def _tier_sql():
    return f"""WITH {UNITS_SQL}, {RAW_SQL},
t AS (SELECT * FROM raws WHERE {U_SQL} >= 0.85::DOUBLE),
a AS (SELECT finding, count(*) FILTER (WHERE raw IN (0,1)) AS n_valid, count(*) FILTER (WHERE raw = 1) AS n_pos FROM t GROUP BY finding),
b AS (SELECT *, n_valid - n_pos AS n_neg, CASE WHEN n_valid > 0 THEN n_pos / n_valid::DOUBLE ELSE 1 END AS prevalence FROM a)
SELECT finding, n_valid, n_pos, n_neg, {r('prevalence', 'prevalence')},
 CASE WHEN prevalence > 0.9 OR 1 - prevalence > 0.9 THEN 'excluded' WHEN n_valid >= 100 AND n_pos >= 30 AND n_neg >= 30 THEN 'tier1'
  WHEN n_valid >= 30 AND n_pos >= 15 AND n_neg >= 15 THEN 'tier2' ELSE 'excluded' END AS tier FROM b"""


@query("finding_tiers", _tier_sql())
def finding_tiers(spark, sf):
    rows = _finding_rows(units(spark, sf)).where(uniform(42, "entity_id") >= 0.85)
    return cohort.finding_tiers(rows.withColumn("label", apply_policy(F.col("raw"), "ignore")))


@query("probe_targets", f"""{U}, a AS (SELECT 'building' AS attribute, 'binary' AS task, count(building) AS n, sum(building) AS s FROM units
 UNION ALL SELECT 'in_debt', 'binary', count(in_debt), sum(in_debt) FROM units
 UNION ALL SELECT 'low_nation', 'binary', count(low_nation), sum(low_nation) FROM units
 UNION ALL SELECT 'age', 'regression', count(age), 0 FROM units)
SELECT attribute, task, n, {r("CASE WHEN task = 'binary' THEN s / n::DOUBLE END", 'prevalence')} FROM a
WHERE CASE WHEN task = 'binary' THEN s >= 50 AND n - s >= 50 ELSE n >= 200 END""")
def probe_targets(spark, sf):
    return cohort.probe_targets(units(spark, sf), ["building", "in_debt", "low_nation"], ["age"])


@query("cell_guard", f"""{U}, {RAW_SQL}, s AS (SELECT *, {U_SQL} AS u FROM raws),
p AS (SELECT finding, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split,
 CASE WHEN raw IN (0, 1) THEN raw END AS y FROM s),
c AS (SELECT finding, count(y) FILTER (WHERE split='train') AS n_train, count(y) FILTER (WHERE split='test') AS n_test,
 count(*) FILTER (WHERE split='train' AND y=1) AS pos_train, count(*) FILTER (WHERE split='test' AND y=1) AS pos_test,
 count(*) FILTER (WHERE split='train' AND y=0) AS neg_train, count(*) FILTER (WHERE split='test' AND y=0) AS neg_test FROM p GROUP BY finding)
SELECT * FROM c WHERE n_train >= 50 AND n_test >= 50 AND least(pos_train, pos_test) >= 10 AND least(neg_train, neg_test) >= 10""")
def cell_guard(spark, sf):
    u = uniform(42, "entity_id")
    rows = _finding_rows(units(spark, sf)).withColumn("label", apply_policy(F.col("raw"), "ignore")).withColumn(
        "split", F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test")
    )
    return cohort.cell_guard(rows, ["finding"], min_neg=10)


@query("majority_entity", """WITH k AS (SELECT user_id, CASE WHEN event_type IN ('view', 'error') THEN 'Unknown' ELSE event_type END AS c FROM events),
n AS (SELECT user_id, c, count(*) AS n FROM k WHERE c <> 'Unknown' GROUP BY ALL),
b AS (SELECT user_id, c FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, c) = 1)
SELECT u.user_id, coalesce(b.c, 'Unknown') AS category FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id)""")
def majority_entity(spark, sf):
    e = read(spark, sf, "events").withColumn(
        "category", F.when(F.col("event_type").isin("view", "error"), "Unknown").otherwise(F.col("event_type"))
    )
    return cohort.majority_category(e, "user_id", "category")


@query("first_known", """SELECT user_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def first_known(spark, sf):
    e = read(spark, sf, "events").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return cohort.first_known(e, "user_id", "value", "event_id")


@query("cohort_intersection", """WITH m AS (SELECT DISTINCT l_orderkey AS unit_id, l_returnflag AS model FROM lineitem),
c AS (SELECT unit_id FROM m GROUP BY unit_id HAVING count(*) = (SELECT count(DISTINCT model) FROM m))
SELECT unit_id FROM c WHERE unit_id IN (SELECT o_orderkey FROM orders)""")
def cohort_intersection(spark, sf):
    emb = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("model"))
    return cohort.canonical_units(emb, read(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id")))


@query("entity_attribute_lookup", """WITH e AS (SELECT user_id, arg_min(event_type, event_id) AS kind FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT coalesce(kind, 'none') AS kind, count(*) AS n FROM customer LEFT JOIN e ON c_custkey = user_id GROUP BY 1""")
def entity_lookup(spark, sf):
    e = read(spark, sf, "events")
    kinds = cohort.first_known(
        e.withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type"))), "user_id", "kind", "event_id"
    )
    c = read(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    return cohort.attach_entity(c, kinds, "user_id", "kind", "none").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("entity_attribute_known", """WITH e AS (SELECT user_id, arg_min(event_type, event_id) AS kind FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT kind, count(*) AS n FROM customer JOIN e ON c_custkey = user_id GROUP BY 1""")
def entity_known(spark, sf):
    e = read(spark, sf, "events")
    kinds = cohort.first_known(
        e.withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type"))), "user_id", "kind", "event_id"
    )
    c = read(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    return cohort.attach_entity(c, kinds, "user_id", "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("unmatched_units", """SELECT count(*) AS n_units, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_unmatched FROM documents""")
def unmatched_units(spark, sf):
    return cohort.unmatched(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id")


@query("entity_split", """WITH o AS (SELECT c_custkey AS entity_id, c_mktsegment AS stratum,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey)) - 1 AS pos,
 count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT entity_id, stratum, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' WHEN pos < floor(0.85::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM o""")
def entity_split(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("stratum"))
    return cohort.entity_split(c, "entity_id", "stratum")


@query("entity_split_two_way", """WITH o AS (SELECT c_custkey AS entity_id, c_mktsegment AS stratum,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey)) - 1 AS pos,
 count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
s AS (SELECT entity_id, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM o)
SELECT split, count(*) AS n_units, count(DISTINCT entity_id) AS n_entities FROM orders JOIN s ON o_custkey = entity_id GROUP BY split""")
def entity_split_two_way(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("stratum"))
    s = cohort.entity_split(c, "entity_id", "stratum", cuts=(("train", 0.7),), seed=7)
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "entity_id")
    return o.join(s, "entity_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_distinct("entity_id").alias("n_entities")
    )


@query("one_per_entity", """SELECT o_custkey AS entity_id, o_orderkey AS unit_id, o_totalprice AS price FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey)) = 1""")
def one_per_entity(spark, sf):
    o = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("price")
    )
    return cohort.one_per_entity(o, "entity_id", "unit_id")


@query("subsample_per_split", """WITH o AS (SELECT o_orderkey AS unit_id, CASE WHEN o_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT unit_id, split FROM o QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5('42:' || unit_id)) <= 500 OR split = 'test'""")
def subsample(spark, sf):
    o = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_custkey") % 2 == 0, "train").otherwise("test").alias("split")
    )
    return cohort.subsample(o, "unit_id", {"train": 500})


@query("hash_draws", """SELECT ('0x' || substr(md5('1:' || c_custkey), 1, 8))::BIGINT AS h, c_custkey AS entity_id,
 CASE WHEN ('0x' || substr(md5('1:' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.36787944117144233::DOUBLE THEN 0 ELSE 1 END AS drawn FROM customer""")
def hash_draws(spark, sf):
    return read(spark, sf, "customer").select(
        hash_u32(1, "c_custkey").alias("h"), F.col("c_custkey").alias("entity_id"),
        (poisson_one(uniform(1, "c_custkey")) > 0).cast("int").alias("drawn"),
    )


@query("cohort_description", f"""{U} SELECT count(*) AS n_units, count(DISTINCT entity_id) AS n_entities, {r('avg(age)', 'mean_age')},
 {r('stddev_samp(age)', 'std_age')}, {r('avg(building)', 'male_share')} FROM units""")
def describe(spark, sf):
    return cohort.describe_cohort(units(spark, sf), ["age"], "building")


@query("label_coverage", f"""{U}, {RAW_SQL} SELECT finding, count(*) FILTER (WHERE raw IN (0,1)) AS n_valid,
 count(*) FILTER (WHERE raw = 1) AS n_pos, {r('avg(CASE WHEN raw IN (0,1) THEN raw END)', 'prevalence')} FROM raws GROUP BY finding""")
def label_coverage(spark, sf):
    rows = _finding_rows(units(spark, sf)).withColumn("label", apply_policy(F.col("raw"), "ignore"))
    return cohort.label_coverage(rows)


@query("value_shares", """SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM documents GROUP BY lang""")
def value_shares(spark, sf):
    d = read(spark, sf, "documents")
    counts = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / d.agg(F.count(F.lit(1))).scalar())


@query("distinct_and_set_ops", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)
UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'distinct', count(DISTINCT source) FROM documents""")
def set_ops(spark, sf):
    d, l = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id")
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    parts = [("both", d.intersect(l)), ("either", d.union(e).distinct()), ("all", d.unionByName(l))]
    parts.append(("distinct", read(spark, sf, "documents").select("source").dropDuplicates()))
    out = None
    for kind, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("stem_match", r"""WITH i AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS p FROM pages),
s AS (SELECT p, regexp_replace(p, '\.[^./]*$', '') AS f FROM i),
k AS (SELECT p, f, regexp_replace(f, '^[^/]*/', '') AS c FROM s),
a AS (SELECT f, min(p) AS h FROM k GROUP BY f), b AS (SELECT c, min(p) AS h FROM k GROUP BY c)
SELECT k.p || '.jpg' AS path, coalesce(a.h, b.h) AS matched_path FROM k LEFT JOIN a ON a.f = k.p LEFT JOIN b ON b.c = k.p""")
def stem_match(spark, sf):
    idx = read(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct()
    wanted = idx.select(F.concat("path", F.lit(".jpg")).alias("path"))
    return cohort.match_by_stem(idx, wanted)


@query("interval_text", """WITH g AS (SELECT l_returnflag AS k, avg(l_discount) AS m, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1)
SELECT k, format('{:.3f} ({:.3f}-{:.3f})', m, lo, hi) AS ci, CASE WHEN k = 'N' THEN format('{:+.3f}', m) ELSE format('{:+.3f} ({:+.3f}, {:+.3f}) p={:.3f}', m, lo, hi, lo) || '*' END AS delta,
 round(abs(ln(m)), 6) AS abs_log, 'expensive' AS tier FROM g""")
def interval_text(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(
        F.avg("l_discount").alias("m"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi")
    )
    low = F.when(F.col("k") != "N", F.col("lo"))
    return g.select(
        "k", format_ci(F.col("m"), F.col("lo"), F.col("hi")).alias("ci"),
        format_delta(F.col("m"), low, F.col("hi"), F.col("lo")).alias("delta"),
        safe_abs_log(F.col("m")).alias("abs_log"), cost_tier(F.col("m")).alias("tier"),
    )
