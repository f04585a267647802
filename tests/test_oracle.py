"""Registered queries equal their DuckDB oracles by value at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_oracle(spark, con, name):
    ok, message = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
