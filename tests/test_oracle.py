"""Every registered query against its SQL, on the smallest data set."""

import oracle
import pytest
from conftest import SF

from tidelog import registry

# Reports that are rightly empty at the smallest scale.
MAY_BE_EMPTY = {"f24_dlq_alert", "d18_rebuild"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLES:
        assert df.count() > 0
        return
    difference = oracle.compare(df, con, registry.ORACLES[name])
    if difference == "no rows" and name in MAY_BE_EMPTY:
        return
    assert difference is None, difference


def test_queries_take_no_fixed_input():
    """A query without SQL is an approximate one; all others are compared."""
    assert {n for n in registry.QUERIES if n not in registry.ORACLES} == {
        "c10_agg_state_uniq", "h08_uniq_approx", "h30_sketch_users",
    }
