"""Every registered query of the reference's operators against its SQL, or, without SQL, that it gives rows."""

import pytest

from tests.compare import check, connect
from turnlake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    check(spark, con, SF, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows_of_a_stable_schema(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.schema == QUERIES[name](spark, SF).schema


def test_all_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
