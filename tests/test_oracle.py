"""Every registered query against its SQL on the smallest tables."""

import pytest

from wiretally.registry import ORACLES, QUERIES
from wiretally.verify import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    result = compare(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
