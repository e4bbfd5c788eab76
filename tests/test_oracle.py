"""Every catalogue query equals its DuckDB oracle (sf0.001 for speed; the
harness runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from calltrail.plans.catalog import QUERIES as CATALOGUE
from oracle_harness import compare, duck_con
from conftest import SMOKE

# The catalogue's own queries; the training-data operators have tests of their own.
QUERIES = {k: v for k, v in E.queries().items() if k in CATALOGUE}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SMOKE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in ORACLE, f"{name} has no oracle SQL"
    info = compare(spark, con, name, QUERIES[name], ORACLE[name], SMOKE)
    assert info["ok"], info


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["class_name", "method", "calls", "closed", "open", "total_ms", "max_ms"]


@pytest.mark.parametrize("name", ["flat_table", "alerts", "store_page", "quota_audit", "retention", "grouped_table"])
def test_results_do_not_depend_on_the_session_zone(spark, con, name):
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "America/New_York")
    try:
        info = compare(spark, con, name, QUERIES[name], ORACLE[name], SMOKE)
    finally:
        spark.conf.set(key, old)
    assert info["ok"], info
