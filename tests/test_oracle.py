"""Every registered query on the CRM tables against its SQL twin, and its plan for Python and cross joins."""

import pytest

import __spark_entry__
from leadlake.checks.compare import difference, duck_connection
from leadlake.checks.oracle import oracle_sql
from leadlake.checks.queries import queries
from leadlake.plans.inspect import plan_text
from tests.conftest import SF_DIR

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_DIR)


def test_every_query_has_a_twin():
    assert set(queries()) == set(SQL)
    assert set(queries()) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    text = plan_text(df)
    for bad in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct"):
        assert bad not in text, bad
    assert difference(df, duck, SQL[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 9
