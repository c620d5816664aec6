"""Registered queries of the operators: what SQL can express, and that the rest runs over the whole table."""

import pytest

import __spark_entry__ as contract
from runlens.llm.queries import ORACLES, QUERIES
from runlens.plans.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(contract.queries()[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_names_are_registered():
    assert {"pipeline", *QUERIES} <= set(contract.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
