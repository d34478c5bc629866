"""Every registered query of the event engine against its SQL."""

import pytest

from tickloom.plans.queries import QUERIES
from tickloom.plans.sql import SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(same_rows, name):
    same_rows(QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
