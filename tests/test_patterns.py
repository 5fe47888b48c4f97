"""Encoding-dependence patterns against their SQL twins on odd tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from compare import compare


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Line items of eight suppliers, some without any discount or tax, so that means are missing."""
    sf = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT k AS l_suppkey, CASE WHEN k NOT IN (2, 3, 6) THEN 0.02 + k / 50 + i / 100 END AS l_discount,
        CASE WHEN k NOT IN (4, 5, 6) THEN 0.01 + k / 50 + i / 100 END AS l_tax FROM range(8) a(k), range(4) b(i)) TO '{sf}/lineitem.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    return sf, con


@pytest.mark.parametrize("name", ["pattern_study", "pattern_sweep", "pattern_stability"])
def test_cells_with_missing_means_have_the_class_of_the_twin(spark, odd, name):
    sf, con = odd
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) == []
