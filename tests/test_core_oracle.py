"""Every query of the tracking tables against its SQL."""

import pytest

from conftest import SMALL
from oracle_check import assert_same
from orbitspark import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(core.queries()[name](spark, SMALL), SQL[name], SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(core.queries())
