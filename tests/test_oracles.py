"""Every query against its SQL counterpart, on the smallest data."""

import pytest

from conftest import SMALL

from circadia_checks.compare import difference
from circadia_checks.oracles import ORACLES
from circadia_checks.registry import QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], SMALL) is None
