"""Every query of the catalogue against its SQL twin; the others for shape."""

from __future__ import annotations

import literal_describing
import literal_reading
import pytest
from compare import connect, differences

from plansift.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, duck, name):
    assert differences(QUERIES[name](spark, small), ORACLES[name], duck) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert len(QUERIES[name](spark, small).collect()) > 0


LITERAL = [*literal_reading.PAIRS, *literal_describing.PAIRS]


@pytest.mark.parametrize("k", range(len(LITERAL)), ids=[f.__name__ for f, _ in LITERAL])
def test_literal_tables(spark, small, duck, k):
    """Small tables with the answers written out, for cases that the standard tables have not."""
    make, sql = LITERAL[k]
    assert differences(make(spark, small), sql, duck) == ""


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200
