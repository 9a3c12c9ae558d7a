"""Every registered query runs on the smallest tables and agrees with its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict = verify.compare(spark, con, SF, name)
    assert verdict.startswith(("ok", "rows-only")), verdict
