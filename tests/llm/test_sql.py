import pytest
from compare import both

from chunkloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf, name):
    got, expected, columns, names = both(spark, queries()[name], oracle_sql()[name], sf)
    assert columns == names
    assert got == expected


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
