"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from tests.oracle import database, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query_agrees_with_oracle(spark, con, name):
    problem, rows = difference(spark, con, name, SF_DIR)
    assert problem is None
    assert rows > 0


def test_every_oracle_belongs_to_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_runs(spark):
    assert registered.entry(spark).count() > 0
