from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from runlens.operators import metrics, trends
from runlens.operators.metrics import RunQuery
from runlens.operators.trends import TrendOptions

SCHEMA = (
    "run_id bigint, run_key string, started_at timestamp, elapsed_ms bigint, total bigint, passed bigint, failed bigint, skipped bigint, timed_out bigint, "
    "interrupted bigint, unsuccessful bigint, total_duration double, project string, feature string, environment string, browser string, executed_by string, "
    "schema_version string, migrated boolean, trace_reported bigint, trace_preserved bigint, has_pdf boolean, has_dashboard boolean, has_evidence boolean, has_traces boolean"
)


def run(n, when, passed=0, failed=0, skipped=0, duration=0.0, elapsed=0, project="P"):
    total = passed + failed + skipped
    return (n, f"20240101-000000-000-{n:08x}", when, elapsed, total, passed, failed, skipped, 0, 0, failed, duration, project, None, "QA", "chromium", "me",
            "1.0.0", n % 2 == 0, 0, 0, True, False, False, False)


def day(n, hour=0):
    return datetime(2024, 1, 1, hour, tzinfo=timezone.utc) + timedelta(days=n)


@pytest.fixture
def runs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def test_rates_come_from_counts(runs):
    data = runs(run(1, day(0), 1, 0, 0, 100.0, 1000), run(2, day(1), 1, 2, 0, 200.0, 2000), run(3, day(2), 0, 1, 1, 300.0, 9000), run(4, day(3)))
    row = metrics.aggregate_runs(data).first()
    assert (row.tests, row.passed, row.weighted_pass_rate, row.average_run_pass_rate) == (6, 2, 33.33, 44.44)
    assert (row.unsuccessful_rate, row.skipped_rate, row.rated_run_count, row.run_count) == (50.0, 16.67, 3, 4)
    assert (row.total_test_duration_ms, row.average_run_test_duration_ms, row.average_test_duration_ms) == (600.0, 150.0, 100.0)


def test_empty_selection(runs):
    row = metrics.aggregate_runs(runs(run(1, day(0), 1)), RunQuery(limit=0)).first()
    assert (row.run_count, row.tests, row.weighted_pass_rate, row.total_test_duration_ms) == (0, 0, None, 0.0)


def test_durations_add_up_exactly(runs):
    row = metrics.aggregate_runs(runs(run(1, day(0), 1, duration=0.1), run(2, day(1), 1, duration=0.2))).first()
    assert row.total_test_duration_ms == 0.3


def test_null_group_is_not_the_total(runs):
    rows = metrics.group_runs(runs(run(1, day(0), 1, project=None), run(2, day(0), 0, 1)), "project").orderBy("is_total", F.asc_nulls_last("key")).collect()
    assert [(r.is_total, r.key, r.label, r.tests) for r in rows] == [(False, "P", "P", 1), (False, None, "Unknown", 1), (True, None, None, 2)]


def test_bad_queries_fail_before_the_scan():
    for options in ({"limit": -1}, {"limit": 1.5}, {"project": []}, {"project": ["a", "a"]}, {"run_ids": "x"}, {"schemaVersion": "2.0.0"},
                    {"start": "2024-02-30T00:00:00Z"}, {"start": "2024-01-02T00:00:00Z", "end": "2024-01-01T00:00:00Z"}, {"newest_first": 1}):
        with pytest.raises(TypeError):
            RunQuery(**options)
    for options in ({"granularity": "year"}, {"window": 1}, {"minimum_points": 1}, {"stable_threshold": 101}):
        with pytest.raises(TypeError):
            TrendOptions(**options)
    with pytest.raises(TypeError):
        metrics.check_dimension("hour")


def test_filters_and_order(runs):
    data = runs(*[run(n, day(n), 1, project="P" if n % 2 else "Q") for n in range(6)])
    keys = [r.run_id for r in metrics.selected_runs(data, RunQuery(project="P", start="2024-01-02T00:00:00Z", limit=2)).collect()]
    assert sorted(keys) == [3, 5]
    assert metrics.matched_runs(data, RunQuery(include_migrated=False)).count() == 3
    assert metrics.matched_runs(data, RunQuery(feature="X")).count() == 0


def test_filters_reach_the_scan(spark, runs, tmp_path):
    path = str(tmp_path / "runs")
    runs(run(1, day(0), 1)).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = metrics.matched_runs(spark.read.parquet(path), RunQuery(project="P", start="2024-01-01T00:00:00Z"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(project,P)" in text and "GreaterThanOrEqual(started_at" in text


@pytest.mark.parametrize("limit, points", [(2, 1), (4, 2), (5, 3)])
@pytest.mark.parametrize("granularity, step", [("day", 1), ("week", 7), ("month", 31)])
def test_limit_counts_runs_before_buckets(runs, limit, points, granularity, step):
    data = runs(run(1, day(0), 1), run(2, day(step), 1), run(3, day(step, 1), 1), run(4, day(2 * step), 1), run(5, day(2 * step, 1), 1))
    assert trends.trend_series(data, TrendOptions(granularity), RunQuery(limit=limit)).count() == points


@pytest.mark.parametrize(
    "first, last, points, relative, direction",
    [((80, 20), (85, 15), 5.0, 6.25, "improving"), ((90, 10), (80, 20), -10.0, -11.11, "declining"), ((0, 1), (1, 1), 50.0, None, "improving"), ((200, 0), (199, 1), -0.5, -0.5, "stable")],
)
def test_changes(runs, first, last, points, relative, direction):
    data = runs(run(1, day(0), *first), run(2, day(1), *last))
    for granularity in ("day", "run"):
        row = trends.trend_summary(trends.trend_series(data, TrendOptions(granularity)), TrendOptions(granularity)).first()
        assert (row.point_change, row.relative_change, row.direction) == (points, relative, direction)


def test_one_point_is_not_enough(runs):
    series = trends.trend_series(runs(run(1, day(0), 1), run(2, day(1))))
    row = trends.trend_summary(series).first()
    assert (row.analyzable, row.direction, row.previous_key, row.point_change) == (1, "insufficient-data", None, None)
    assert sorted(r.code for r in trends.trend_warnings(series).collect()) == ["INSUFFICIENT_DATA", "ZERO_TEST_POINT"]


def test_moving_rate_by_run_and_by_day(runs):
    data = runs(run(1, day(0), 1), run(2, day(1), 0, 99), run(3, day(2), 1))
    for granularity in ("day", "run"):
        series = trends.trend_series(data, TrendOptions(granularity, window=2)).orderBy("start").collect()
        assert [r.moving_weighted_pass_rate for r in series] == [None, 1.0, 1.0]


@pytest.mark.parametrize("size", [2, 5, 40])
@pytest.mark.parametrize("slices", [1, 3, 16])
def test_sliced_window_equals_the_global_one(runs, size, slices):
    when = [day(0)] * 20 + [day(n % 9, n % 24) for n in range(60)]
    points = trends._points(runs(*[run(n, when[n], n % 5, n % 3) for n in range(80)]), TrendOptions("run"), RunQuery())
    expected = points.withColumn("moving_weighted_pass_rate", trends._moving_rate(size))
    got = trends.moving_rate_by_slice(points, size, slices)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_contract_violations(runs):
    data = metrics.normalized_runs(runs(run(1, day(0), 1, 1), run(2, day(0), 1)).withColumn("ended_at", F.col("started_at")).withColumn("average_duration", F.lit(0.0)))
    broken = data.withColumn("passed", F.when(F.col("total") == 2, 2).otherwise(F.col("passed")).cast("bigint"))
    assert [list(r.rules) for r in metrics.contract_violations(broken).collect()] == [["STATUS_SUM", "RATE_CONTRADICTS_COUNTS"]]


def test_trends_read_their_input_once(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.sql("SELECT 'a' AS key, 'a' AS start, 1L AS total_tests, 0.0D AS weighted_pass_rate, 1.0D AS average_run_pass_rate").write.parquet(path)
    series = spark.read.parquet(path)
    for frame in (trends.trend_warnings(series), trends.trend_summary(series)):
        assert path not in frame._jdf.queryExecution().optimizedPlan().toString()
        assert str(tmp_path) not in "".join(frame.inputFiles())
