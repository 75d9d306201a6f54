"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks import oracle
from checks.compare import differences
from tremorline.plans import reports

from .conftest import SMALL


def test_every_query_has_sql():
    assert reports.QUERIES.keys() == oracle.SQL.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(reports.QUERIES))
def test_query(spark, name):
    rows, problem = differences(spark, SMALL, name)
    assert rows > 0 and not problem


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["window_start", "window_end", "region", "magnitude_band", "count"]
    assert frame.count() > 0
