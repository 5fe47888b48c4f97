"""Registered queries against their SQL twins on the smallest tables.

By default a quick selection runs; AUDIT_ALL=1 runs every query with a twin.
"""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "label_policies", "age_bins", "majority_entity", "cohort_intersection", "entity_split", "one_per_entity", "or_all_pairs",
    "or_weighted", "or_mantel_haenszel", "auroc_lines", "threshold_rates", "equalized_odds", "confounding_grid", "overall_row",
    "top_k_per_group", "cluster_robust", "embedding_scaler", "bootstrap_slope",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("AUDIT_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_reads_only_needed_columns(spark):
    df = entry.entry(spark)
    plan = df._jdf.queryExecution().toString()
    assert df.count() > 0
    assert "c_name" not in plan.split("== Physical Plan ==")[1]
