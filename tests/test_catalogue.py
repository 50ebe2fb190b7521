"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

from lakemill.plans import catalogue, operators
from tests.conftest import SF
from tests.oracle import connect, same

QUERIES = catalogue.queries() | operators.queries()
ORACLE = catalogue.oracle_sql() | operators.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["any_subquery", "all_subquery", "sql_any_all_equal"])
def test_quantified_subqueries_need_no_nested_loop(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["n_name", "c_mktsegment", "n_lines", "revenue"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
