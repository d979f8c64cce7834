"""Every registered query against its SQL, and the shape of those that have none."""

import pytest
from compare import both

from chunkloom.plans.oracles import ORACLES
from chunkloom.plans.queries import QUERIES


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    got, expected, columns, names = both(spark, QUERIES[name], ORACLES[name], sf)
    assert columns == names
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
