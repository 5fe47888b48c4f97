"""Run a registered query on Spark and its SQL twin on DuckDB and compare the results."""
from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in data)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark_df, con, sql: str) -> list[str]:
    problems = []
    got = spark_df.collect()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    for f in spark_df.schema.fields:
        kind = _KINDS.get(f.dataType.simpleString())
        if kind and kind != types[f.name].upper():
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}")
    a, b = rows_of(spark_df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if not got:
        problems.append("no rows")
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]} cols={sorted(names)}")
    return problems
