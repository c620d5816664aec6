"""Registered queries against their SQL on the smallest tables, and on tables where one run holds a third of the rows.

By default a sample runs; RUNLENS_ALL=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from runlens.plans.catalog import ORACLES, QUERIES
from runlens.plans.check import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("failure_groups", "impacted_suites", "root_cause_clusters", "run_summary", "metrics_by_browser", "trend_month", "history_warnings",
          "manifest_audit", "lifecycle_records", "api_activity", "step_names", "append_outcomes", "metrics_categories_by_project", "trend_warnings")
SKEWED = ("failure_top_groups", "impacted_suites", "failure_insights", "root_cause_members", "slowest_tests", "trace_lookup")
ALL = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(ORACLES) == set(ALL)
    assert set(ALL) <= set(contract.queries()) and set(ALL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ALL if os.environ.get("RUNLENS_ALL") else SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(contract.queries()[name](spark, SF), connect(SF), contract.oracle_sql()[name]) == ""


@pytest.fixture(scope="session")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        column = "CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey" if name == "lineitem" else ""
        replaced = f"REPLACE ({column})" if column else ""
        con.execute(f"COPY (SELECT * {replaced} FROM '{SF}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", SKEWED)
def test_one_run_with_a_third_of_the_rows(spark, skewed, name):
    assert compare(contract.queries()[name](spark, skewed), connect(skewed), contract.oracle_sql()[name]) == ""


def test_top_lists_are_cut_before_the_shuffle(spark):
    plan = contract.queries()["slowest_tests"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_only_needed_columns(spark):
    plan = contract.queries()["capture_coverage"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan.split("ReadSchema")[-1]
