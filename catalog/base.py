"""Shared views of the test tables, once as DataFrames and once as SQL text."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attraudit.functions.labels import apply_policy
from attraudit.functions.rand import uniform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BINARY = ["building", "machinery", "in_debt", "low_nation"]
FINDINGS = ["fulfilled", "urgent", "winter"]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """orders x customer as units of entities, with raw ternary findings."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    month = F.month("o_orderdate")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("entity_id"),
        F.col("c_mktsegment").alias("grp"), F.col("o_orderstatus").alias("stratum"),
        F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") <= 9000, (F.col("c_acctbal") + 1000) / 110).alias("age"),
        F.col("c_nationkey").alias("nationkey"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"),
        (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("machinery"),
        (F.col("c_acctbal") < 0).cast("int").alias("in_debt"),
        F.when(F.col("c_nationkey") != 24, (F.col("c_nationkey") < 5).cast("int")).alias("low_nation"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(-1.0).alias("fulfilled"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1.0)
        .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", 0.0).alias("urgent"),
        F.when(month.isin(12, 1, 2), 1.0).when(month == 6, -1.0).otherwise(0.0).alias("winter"),
    )


UNITS_SQL = """units AS (
  SELECT o_orderkey AS unit_id, o_custkey AS entity_id, c_mktsegment AS grp, o_orderstatus AS stratum,
    o_totalprice AS price, c_acctbal AS balance,
    CASE WHEN c_acctbal <= 9000 THEN (c_acctbal + 1000) / 110 END AS age, c_nationkey AS nationkey,
    CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS building, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS machinery,
    CAST(c_acctbal < 0 AS INTEGER) AS in_debt,
    CASE WHEN c_nationkey <> 24 THEN CAST(c_nationkey < 5 AS INTEGER) END AS low_nation,
    CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS fulfilled,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0::DOUBLE
         WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 0.0::DOUBLE END AS urgent,
    CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1.0::DOUBLE WHEN month(o_orderdate) = 6 THEN -1.0::DOUBLE
         ELSE 0.0::DOUBLE END AS winter
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def labelled(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    df = units(spark, sf)
    for f in FINDINGS:
        df = df.withColumn(f, apply_policy(F.col(f), policy))
    return df


_POLICY_SQL = {
    "ignore": "CASE WHEN {f} IN (0, 1) THEN CAST({f} AS INTEGER) END",
    "zero": "COALESCE(CAST({f} = 1 AS INTEGER), 0)",
    "blank_dropped": "CASE WHEN {f} IS NOT NULL THEN CAST({f} = 1 AS INTEGER) END",
}


def labelled_sql(policy: str, name: str = "lab") -> str:
    cols = ", ".join(_POLICY_SQL[policy].format(f=f) + f" AS {f}" for f in FINDINGS)
    return f"{name} AS (SELECT * EXCLUDE ({', '.join(FINDINGS)}), {cols} FROM units)"


def pairs_sql(src: str = "lab", extra: str = "", attrs=BINARY, name: str = "pairs") -> str:
    """Long attribute x finding rows (a, y) of a labelled unit view."""
    a = " UNION ALL ".join(f"SELECT * , '{x}' AS attribute, {x} AS a FROM {src}" for x in attrs)
    f = " UNION ALL ".join(f"SELECT unit_id, entity_id, grp, stratum{extra}, attribute, a, '{x}' AS finding, {x} AS y FROM attrs" for x in FINDINGS)
    return f"attrs AS ({a}), {name} AS ({f})"


COUNTS_SQL = (
    "COUNT(*) FILTER (WHERE a=1 AND y=1) AS tp, COUNT(*) FILTER (WHERE a=1 AND y=0) AS fp, "
    "COUNT(*) FILTER (WHERE a=0 AND y=1) AS fn, COUNT(*) FILTER (WHERE a=0 AND y=0) AS tn"
)


def split_col(u):
    return F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test")


def scores(spark: SparkSession, sf: str, keep: Sequence[str] = ()) -> DataFrame:
    """Two scores for two findings of every unit: the contract of the metric operators; `keep` names columns of the unit to carry along."""
    df = labelled(spark, sf, "ignore").withColumn("split", split_col(uniform(42, "entity_id")))
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(f).alias("finding"), p.alias("p"), F.col(f).alias("y"))
        for m, p in (("a", F.col("price") / 500000), ("b", (F.floor("balance") + 1000) / 11000))
        for f in ("fulfilled", "urgent")
    ])
    base = ["unit_id", "entity_id", "grp", "split", *keep]
    return df.select(*base, F.explode(rows).alias("r")).select(*base, "r.*").where(F.col("y").isNotNull())


U_SQL = "(('0x' || substr(md5('42:' || entity_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

SCORES_SQL = UNITS_SQL + ", " + labelled_sql("ignore") + f""", un AS (SELECT *, {U_SQL} AS u FROM lab),
sp AS (SELECT *, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split FROM un),
scores AS (
  SELECT unit_id, entity_id, grp, split, 'a' AS model, 'fulfilled' AS finding, price / 500000 AS p, fulfilled AS y FROM sp WHERE fulfilled IS NOT NULL
  UNION ALL SELECT unit_id, entity_id, grp, split, 'a', 'urgent', price / 500000, urgent FROM sp WHERE urgent IS NOT NULL
  UNION ALL SELECT unit_id, entity_id, grp, split, 'b', 'fulfilled', (floor(balance) + 1000) / 11000, fulfilled FROM sp WHERE fulfilled IS NOT NULL
  UNION ALL SELECT unit_id, entity_id, grp, split, 'b', 'urgent', (floor(balance) + 1000) / 11000, urgent FROM sp WHERE urgent IS NOT NULL)"""


def line_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A heavier score table with many ties: one row per line item and finding."""
    li = read(spark, sf, "lineitem")
    rows = F.array(
        F.struct(F.lit("returned").alias("finding"), (F.col("l_returnflag") == "R").cast("int").alias("y")),
        F.struct(F.lit("open").alias("finding"), (F.col("l_linestatus") == "O").cast("int").alias("y")),
    )
    return li.select(
        F.concat(F.lit("line"), F.col("l_linenumber")).alias("grp"), F.col("l_suppkey").alias("entity_id"),
        ((F.col("l_quantity") + F.round(F.col("l_discount") * 100)) / 60).alias("p"), F.explode(rows).alias("r"),
    ).select("grp", "entity_id", "p", "r.*")


LINES_SQL = """lines AS (
  SELECT 'line' || l_linenumber AS grp, l_suppkey AS entity_id, (l_quantity + round(l_discount * 100)) / 60 AS p,
    'returned' AS finding, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem
  UNION ALL SELECT 'line' || l_linenumber, l_suppkey, (l_quantity + round(l_discount * 100)) / 60,
    'open', CAST(l_linestatus = 'O' AS INTEGER) FROM lineitem)"""


def midrank_sql(src: str, keys: str, v: str = "p", out: str = "rk") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    both = f"PARTITION BY {keys + ', ' if keys else ''}{v}"
    return f"SELECT *, rank() OVER ({part} ORDER BY {v}) + (count(*) OVER ({both}) - 1) / 2.0::DOUBLE AS {out} FROM {src}"


def auroc_expr(rk: str = "rk", y: str = "y") -> str:
    """Rank-sum form of the AUROC."""
    return (
        f"(sum(CASE WHEN {y}=1 THEN {rk} END) - count(*) FILTER (WHERE {y}=1) * (count(*) FILTER (WHERE {y}=1) + 1) / 2.0::DOUBLE)"
        f" / nullif(count(*) FILTER (WHERE {y}=1)::DOUBLE * count(*) FILTER (WHERE {y}=0), 0)"
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; results are compared with the SQL twin at this precision."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its doubles are rounded and its SQL twin is kept beside it."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {alias}"
