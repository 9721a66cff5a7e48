"""Every registered query against its check SQL on the smallest data."""

import pytest

import __spark_entry__ as entry_point
from snaptext.checks.oracles import sql
from snaptext.checks.queries import registered
from check import compare, connect
from conftest import SMALL

SQL = sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    result = compare(spark, con, SMALL, name, registered()[name], SQL[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
