"""Queries over run summaries: rollups and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens import fixed_values as V
from runlens.functions.times import display_run_id, iso_text
from runlens.operators import metrics, summaries, trends
from runlens.operators.metrics import RunQuery
from runlens.operators.trends import TrendOptions
from runlens.plans import sql as S
from runlens.sources import tables


def _summaries(spark, sf_dir):
    return summaries.run_summaries(tables.executions(spark, sf_dir), tables.runs(spark, sf_dir))


FILTER = RunQuery(
    start="1996-01-01T00:00:00Z", end="1999-12-31T23:59:59.999+02:00", project=["1-URGENT", "2-HIGH", "5-LOW"], environment=["F", "O"],
    browser=["chromium", "firefox"], include_migrated=False, limit=500,
)
FILTER_SQL = """started_at >= TIMESTAMP '1996-01-01' AND started_at <= TIMESTAMP '1999-12-31 21:59:59.999'
    AND project IN ('1-URGENT', '2-HIGH', '5-LOW') AND environment IN ('F', 'O') AND browser IN ('chromium', 'firefox') AND NOT migrated"""


def run_summary(spark, sf_dir):
    columns = ["run_id", "run_key", "elapsed_ms", "total", *summaries.STATUS_COLUMNS, "unsuccessful", "pass_rate", "total_duration",
               "average_duration", "project", "feature", "environment", "browser", "executed_by", "trace_reported"]
    return _summaries(spark, sf_dir).select(*columns, iso_text(F.col("started_at")).alias("started_at"))


def run_failure_categories(spark, sf_dir):
    return summaries.failure_category_counts(tables.executions(spark, sf_dir))


def run_category_maps(spark, sf_dir):
    maps = summaries.category_maps(run_failure_categories(spark, sf_dir))
    return maps.select("run_id", F.to_json("failure_category_counts").alias("failure_category_counts"))


def unfinished_runs(spark, sf_dir):
    records = tables.executions(spark, sf_dir).withColumn(
        "status", F.when(F.col("ordinal") % 97 == 0, "running").when(F.col("ordinal") % 89 == 0, "").otherwise(F.col("status"))
    )
    return summaries.unfinished_runs(records)


def run_defaults(spark, sf_dir):
    return summaries.metadata_with_defaults(tables.runs(spark, sf_dir))


def query_runs(spark, sf_dir):
    return metrics.normalized_runs(metrics.selected_runs(_summaries(spark, sf_dir), FILTER))


def query_runs_oldest(spark, sf_dir):
    query = RunQuery(newest_first=False, limit=100)
    return metrics.normalized_runs(metrics.selected_runs(_summaries(spark, sf_dir), query)).select("run_key", "started_at", "pass_rate")


def runs_in_table(spark, sf_dir):
    runs = tables.runs(spark, sf_dir)
    wanted = runs.filter(F.col("run_id") % 5 == 0).select("run_key")
    return metrics.runs_by_id_table(runs, wanted).select("run_key", display_run_id(F.col("started_at")).alias("display_id"))


def metrics_overall(spark, sf_dir):
    return metrics.aggregate_runs(_summaries(spark, sf_dir))


def metrics_filtered(spark, sf_dir):
    return metrics.aggregate_runs(_summaries(spark, sf_dir), FILTER)


def _metrics_by(dimension):
    return lambda spark, sf_dir: metrics.group_runs(_summaries(spark, sf_dir), dimension)


def _categories_by(dimension):
    return lambda spark, sf_dir: metrics.category_totals(run_failure_categories(spark, sf_dir), tables.runs(spark, sf_dir), dimension)


def metrics_categories_by_month(spark, sf_dir):
    return _categories_by("month")(spark, sf_dir).where("NOT is_total").drop("is_total")


def available_date_range(spark, sf_dir):
    return metrics.date_range(tables.runs(spark, sf_dir), FILTER)


def _trend(granularity, window, **query):
    return lambda spark, sf_dir: trends.trend_series(
        _summaries(spark, sf_dir), TrendOptions(granularity, window=window), RunQuery(**query)
    )


def _trend_summary(granularity, field):
    return lambda spark, sf_dir: trends.trend_summary(
        trends.trend_series(_summaries(spark, sf_dir), TrendOptions(granularity)), TrendOptions(granularity), field
    )


def trend_warnings(spark, sf_dir):
    return trends.trend_warnings(trends.trend_series(_summaries(spark, sf_dir), TrendOptions("day")), TrendOptions("day", minimum_points=5000))


def run_contract(spark, sf_dir):
    rows = metrics.normalized_runs(_summaries(spark, sf_dir))
    serial = F.col("elapsed_ms")
    shifted = rows.withColumn("passed", F.when(serial % 7 == 0, F.col("passed") + 1).otherwise(F.col("passed")))
    broken = shifted.withColumn("unsuccessful", F.when(serial % 11 == 0, F.col("unsuccessful") - 1).otherwise(F.col("unsuccessful")))
    return metrics.contract_violations(broken).select("run_key", F.array_join("rules", ",").alias("rules"))


def status_distribution(spark, sf_dir):
    return summaries.status_distribution(_summaries(spark, sf_dir))


def execution_summary(spark, sf_dir):
    return summaries.execution_summary(_summaries(spark, sf_dir))


QUERIES = {
    "run_summary": run_summary,
    "current_summary": lambda spark, sf_dir: summaries.current_summaries(tables.executions(spark, sf_dir)),
    "run_failure_categories": run_failure_categories,
    "run_category_maps": run_category_maps,
    "unfinished_runs": unfinished_runs,
    "run_defaults": run_defaults,
    "status_distribution": status_distribution,
    "execution_summary": execution_summary,
    "query_runs": query_runs,
    "query_runs_oldest": query_runs_oldest,
    "runs_in_table": runs_in_table,
    "metrics_overall": metrics_overall,
    "metrics_filtered": metrics_filtered,
    **{f"metrics_by_{d.lower()}": _metrics_by(d) for d in V.GROUP_DIMENSIONS},
    "metrics_categories_by_month": metrics_categories_by_month,
    **{f"metrics_categories_by_{d.lower()}": _categories_by(d) for d in V.GROUP_DIMENSIONS if d != "month"},
    "metrics_categories_overall": _categories_by(None),
    "available_date_range": available_date_range,
    "trend_day": _trend("day", None),
    "trend_week": _trend("week", 4),
    "trend_month": _trend("month", 3),
    "trend_run": _trend("run", 7),
    "trend_month_limited": _trend("month", 2, limit=200),
    "trend_summary": _trend_summary("month", "weighted_pass_rate"),
    "trend_summary_average_run": _trend_summary("week", "average_run_pass_rate"),
    "trend_summary_run": _trend_summary("run", "weighted_pass_rate"),
    "trend_warnings": trend_warnings,
    "run_contract": run_contract,
}

_STATUSES = "passed, failed, skipped, timed_out, interrupted"
_DURATION = "CAST(total_duration AS DOUBLE)"
_METRICS = f"""
    SELECT key_value, level, run_count, tests, passed, failed, skipped, timed_out, interrupted, unsuccessful,
           {S.rate('passed', 'tests')} AS weighted_pass_rate,
           CASE WHEN rated_run_count > 0 THEN {S.fixed2('CAST(run_rates AS DOUBLE) / rated_run_count')} END AS average_run_pass_rate,
           {S.rate('unsuccessful', 'tests')} AS unsuccessful_rate, {S.rate('skipped', 'tests')} AS skipped_rate, rated_run_count,
           coalesce(duration, 0.0) AS total_test_duration_ms, {S.mean('duration', 'run_count')} AS average_run_test_duration_ms,
           {S.mean('duration', 'tests')} AS average_test_duration_ms, elapsed AS total_elapsed_duration_ms,
           {S.mean('elapsed', 'run_count')} AS average_run_elapsed_duration_ms, traces_reported, traces_preserved,
           pdf_count, dashboard_count, evidence_count, traces_count
    FROM (SELECT {{value}} AS key_value, {{level}} AS level, count(*) AS run_count, CAST(coalesce(sum(total), 0) AS BIGINT) AS tests,
                 {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in (*_STATUSES.split(', '), 'unsuccessful'))},
                 count(*) FILTER (total > 0) AS rated_run_count,
                 sum(CAST({S.percent('passed', 'total')} AS DECIMAL(18, 12))) AS run_rates,
                 CAST(sum(total_duration) AS DOUBLE) AS duration, CAST(coalesce(sum(elapsed_ms), 0) AS BIGINT) AS elapsed,
                 CAST(coalesce(sum(trace_reported), 0) AS BIGINT) AS traces_reported, CAST(coalesce(sum(trace_preserved), 0) AS BIGINT) AS traces_preserved,
                 count(*) FILTER (has_pdf) AS pdf_count, count(*) FILTER (has_dashboard) AS dashboard_count,
                 count(*) FILTER (has_evidence) AS evidence_count, count(*) FILTER (has_traces) AS traces_count
          FROM {{source}} {{grouping}})"""
_VALUES = {
    "day": "date_trunc('day', started_at)", "week": "date_trunc('week', started_at)", "month": "date_trunc('month', started_at)",
    "project": "project", "feature": "feature", "environment": "environment", "browser": "browser", "executedBy": "executed_by",
    "schemaVersion": "schema_version", "migration": "CASE WHEN migrated THEN 'migrated' ELSE 'native' END",
}
_KEYS = {"day": "strftime(key_value, '%Y-%m-%d')", "week": "strftime(key_value, '%G-W%V')", "month": "strftime(key_value, '%Y-%m')"}
_STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}


def _groups_sql(dimension, source="summaries", total=True):
    value = _VALUES[dimension]
    inner = _METRICS.format(
        value=value, source=source, level=f"grouping({value})" if total else "0",
        grouping=f"GROUP BY GROUPING SETS (({value}), ())" if total else f"GROUP BY {value}",
    )
    is_time = dimension in V.TIME_DIMENSIONS
    key = _KEYS.get(dimension, "key_value")
    label = "upper(key_value[1]) || key_value[2:]" if dimension == "migration" else f"coalesce({key}, 'Unknown')"
    start = S.iso("CAST(key_value AS TIMESTAMP)") if is_time else "CAST(NULL AS VARCHAR)"
    end = S.iso(f"CAST(key_value + {_STEPS[dimension]} AS TIMESTAMP)") if is_time else "CAST(NULL AS VARCHAR)"
    return f"""SELECT level = 1 AS is_total, {key} AS key, CASE WHEN level = 0 THEN {label} END AS label, {start} AS start, {end} AS end_exclusive,
        * EXCLUDE (key_value, level) FROM ({inner})"""


_LIMITED = "(SELECT * FROM summaries ORDER BY started_at DESC, run_key DESC LIMIT 200)"
_RUN_POINTS = f"""
    SELECT run_key AS key, {S.iso('started_at')} AS start, CAST(NULL AS VARCHAR) AS end_exclusive, CAST(1 AS BIGINT) AS run_count, total AS total_tests,
           passed, {S.rate('passed', 'total')} AS weighted_pass_rate, {S.rate('passed', 'total')} AS average_run_pass_rate FROM summaries"""


def _points_sql(granularity, source="summaries"):
    if granularity == "run":
        return _RUN_POINTS
    return f"""SELECT key, start, end_exclusive, run_count, tests AS total_tests, passed, weighted_pass_rate, average_run_pass_rate
        FROM ({_groups_sql(granularity, source, total=False)})"""


def _series_sql(granularity, window, source="summaries"):
    if window is None:
        moving = "CAST(NULL AS DOUBLE)"
    else:
        moving = f"CASE WHEN count(*) OVER last = {window} THEN {S.rate('sum(passed) OVER last', 'sum(total_tests) OVER last')} END"
    clause = f"WINDOW last AS (ORDER BY start, key ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)" if window else ""
    return S.with_ctes("summaries", f"SELECT *, {moving} AS moving_weighted_pass_rate FROM ({_points_sql(granularity, source)}) {clause}")


def _summary_sql(granularity, rate_field):
    change, back = "latest_rate - first_rate", "latest_rate - previous_rate"
    return S.with_ctes("summaries", f"""
        SELECT analyzable, first_key, first_rate, previous_key, previous_rate, latest_key, latest_rate,
               CASE WHEN analyzable > 1 THEN {S.fixed2_signed(change)} END AS point_change,
               CASE WHEN analyzable > 1 AND first_rate <> 0 THEN {S.fixed2_signed(f'({change}) / first_rate * 100')} END AS relative_change,
               {S.fixed2_signed(back)} AS previous_point_change,
               CASE WHEN previous_rate <> 0 THEN {S.fixed2_signed(f'({back}) / previous_rate * 100')} END AS previous_relative_change,
               CASE WHEN analyzable < 2 THEN 'insufficient-data' WHEN {S.fixed2_signed(change)} > 0.5 THEN 'improving'
                    WHEN {S.fixed2_signed(change)} < -0.5 THEN 'declining' ELSE 'stable' END AS direction
        FROM (SELECT count(*) AS analyzable, max(key) FILTER (up = 1) AS first_key, max(r) FILTER (up = 1) AS first_rate,
                     max(key) FILTER (down = 2) AS previous_key, max(r) FILTER (down = 2) AS previous_rate,
                     max(key) FILTER (down = 1) AS latest_key, max(r) FILTER (down = 1) AS latest_rate
              FROM (SELECT key, {rate_field} AS r, row_number() OVER (ORDER BY start, key) AS up, row_number() OVER (ORDER BY start DESC, key DESC) AS down
                    FROM ({_points_sql(granularity)}) WHERE {rate_field} IS NOT NULL))""")


_NORMALIZED = f"""run_key, {S.iso('started_at')} AS started_at, {S.iso('ended_at')} AS ended_at, elapsed_ms, total, {_STATUSES}, unsuccessful,
    {S.rate('passed', 'total')} AS pass_rate, {_DURATION} AS total_duration, {S.mean('total_duration', 'total')} AS average_duration,
    project, feature, environment, browser, executed_by, trace_reported, trace_preserved"""
_STORED = "coalesce(nullif(stored_category, ''), CASE upper(status) WHEN 'TIMEDOUT' THEN 'TIMEOUT_FAILURE' ELSE 'UNKNOWN_FAILURE' END)"
_CATEGORIES = f"SELECT run_id, {_STORED} AS category, count(*) AS failures FROM executions WHERE {S.canonical('status')} IN {S.FAILING} GROUP BY ALL"
_TEXT_RATE = f"CASE WHEN total > 0 THEN {S.fixed_text('CAST(passed AS DOUBLE) / total * 100', 2)} ELSE '0.00' END"


def duration_text(x):
    return f"""CASE WHEN {x} < 1000 THEN CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR) || 'ms'
        WHEN {x} < 60000 THEN {S.fixed_text(f'({x}) / 1000', 2)} || 's'
        ELSE CAST(CAST(floor({x} / 60000) AS BIGINT) AS VARCHAR) || 'm ' || {S.fixed_text(f'(({x}) % 60000.0) / 1000', 1)} || 's' END"""


ORACLES = {
    "run_summary": S.with_ctes("summaries", f"""
        SELECT run_id, run_key, {S.iso('started_at')} AS started_at, elapsed_ms, total, {_STATUSES}, unsuccessful,
               coalesce({S.rate('passed', 'total')}, 0.0) AS pass_rate, {_DURATION} AS total_duration,
               coalesce({S.mean('total_duration', 'total')}, 0.0) AS average_duration, project, feature, environment, browser, executed_by, trace_reported
        FROM summaries"""),
    "current_summary": S.with_ctes("status_counts", f"""
        SELECT run_id, total, {_STATUSES}, failed + timed_out + interrupted AS unsuccessful, {_TEXT_RATE} AS pass_rate,
               {_DURATION} AS total_duration FROM status_counts"""),
    "run_failure_categories": S.with_ctes("executions", _CATEGORIES),
    "run_category_maps": S.with_ctes("executions", f"""
        SELECT run_id, '{{' || string_agg('"' || category || '":' || failures, ',' ORDER BY category) || '}}' AS failure_category_counts
        FROM ({_CATEGORIES}) GROUP BY run_id"""),
    "unfinished_runs": S.with_ctes("executions", """
        SELECT run_id, count(*) AS bad_records, arg_min(bad, ordinal) AS first_status
        FROM (SELECT run_id, ordinal, CASE WHEN ordinal % 97 = 0 THEN 'RUNNING' WHEN ordinal % 89 = 0 THEN 'UNKNOWN' END AS bad FROM executions)
        WHERE bad IS NOT NULL GROUP BY run_id"""),
    "run_defaults": S.with_ctes("runs", """
        SELECT run_id, coalesce(project, 'Project') AS project, feature, environment, coalesce(browser, 'chromium') AS browser,
               'Playwright' AS automation_tool, executed_by FROM runs"""),
    "status_distribution": S.with_ctes("summaries", f"""
        SELECT run_id, position, label, n, {S.rate('n', 'whole')} AS percentage FROM (
          SELECT run_id, passed + failed + skipped AS whole, unnest([CAST(1 AS BIGINT), 2, 3]) AS position,
                 unnest(['Passed', 'Failed', 'Skipped']) AS label, unnest([passed, failed, skipped]) AS n FROM summaries) WHERE n > 0"""),
    "execution_summary": S.with_ctes("summaries", f"""
        SELECT run_id, unnest([CAST(1 AS BIGINT), 2, 3, 4, 5, 6]) AS position,
               unnest(['Total Tests', 'Passed', 'Failed', 'Skipped', 'Pass Rate', 'Total Duration']) AS metric,
               unnest([CAST(total AS VARCHAR), CAST(passed AS VARCHAR), CAST(failed AS VARCHAR), CAST(skipped AS VARCHAR), {_TEXT_RATE} || '%',
                       {duration_text(_DURATION)}]) AS value FROM summaries"""),
    "query_runs": S.with_ctes("summaries", f"""
        SELECT {_NORMALIZED} FROM summaries s WHERE {FILTER_SQL.replace('started_at', 's.started_at')} ORDER BY s.started_at DESC, run_key DESC LIMIT 500"""),
    "query_runs_oldest": S.with_ctes("summaries", f"""
        SELECT run_key, {S.iso('s.started_at')} AS started_at, {S.rate('passed', 'total')} AS pass_rate FROM summaries s
        ORDER BY s.started_at, run_key LIMIT 100"""),
    "runs_in_table": S.with_ctes("runs", """
        SELECT run_key, 'RUN-' || strftime(started_at, '%Y%m%d-%H%M%S') AS display_id FROM runs WHERE run_id % 5 = 0"""),
    "metrics_overall": S.with_ctes("summaries", f"SELECT * EXCLUDE (key_value, level) FROM ({_METRICS.format(value='NULL', level='1', source='summaries', grouping='')})"),
    "metrics_filtered": S.with_ctes("summaries", "SELECT * EXCLUDE (key_value, level) FROM (" + _METRICS.format(
        value="NULL", level="1", grouping="", source=f"(SELECT * FROM summaries WHERE {FILTER_SQL} ORDER BY started_at DESC, run_key DESC LIMIT 500)") + ")"),
    **{f"metrics_by_{d.lower()}": S.with_ctes("summaries", _groups_sql(d)) for d in V.GROUP_DIMENSIONS},
    "metrics_categories_by_month": S.with_ctes(("executions", "runs"), f"""
        SELECT strftime(started_at, '%Y-%m') AS key, category, CAST(sum(failures) AS BIGINT) AS failures
        FROM ({_CATEGORIES}) JOIN runs USING (run_id) GROUP BY ALL"""),
    **{f"metrics_categories_by_{d.lower()}": S.with_ctes(("executions", "runs"), f"""
        SELECT grouping(key_value) = 1 AS is_total, {_KEYS.get(d, 'key_value')} AS key, category, CAST(sum(failures) AS BIGINT) AS failures
        FROM (SELECT category, failures, {_VALUES[d]} AS key_value FROM ({_CATEGORIES}) JOIN runs USING (run_id))
        GROUP BY GROUPING SETS ((category, key_value), (category))""") for d in V.GROUP_DIMENSIONS if d != "month"},
    "metrics_categories_overall": S.with_ctes(("executions", "runs"), f"""
        SELECT TRUE AS is_total, CAST(NULL AS VARCHAR) AS key, category, CAST(sum(failures) AS BIGINT) AS failures
        FROM ({_CATEGORIES}) JOIN runs USING (run_id) GROUP BY category"""),
    "available_date_range": S.with_ctes("runs", f"""
        SELECT {S.iso('min(started_at)')} AS first_start, {S.iso('max(started_at)')} AS last_start, count(*) AS runs FROM runs WHERE {FILTER_SQL}"""),
    "trend_day": _series_sql("day", None),
    "trend_week": _series_sql("week", 4),
    "trend_month": _series_sql("month", 3),
    "trend_run": _series_sql("run", 7),
    "trend_month_limited": _series_sql("month", 2, _LIMITED),
    "trend_summary": _summary_sql("month", "weighted_pass_rate"),
    "trend_summary_average_run": _summary_sql("week", "average_run_pass_rate"),
    "trend_summary_run": _summary_sql("run", "weighted_pass_rate"),
    "trend_warnings": S.with_ctes("summaries", """
        SELECT 'INSUFFICIENT_DATA' AS code, 'weighted_pass_rate' AS field, count(weighted_pass_rate) || ' of ' || count(*) || ' points' AS detail
        FROM points HAVING count(weighted_pass_rate) < 5000
        UNION ALL SELECT 'ZERO_TEST_POINT', 'weighted_pass_rate', count(*) || ' points' FROM points WHERE total_tests = 0 HAVING count(*) > 0
        UNION ALL SELECT DISTINCT 'UNDEFINED_RELATIVE_CHANGE', f.field, a.key || ' to ' || b.key
        FROM rated a, rated b, (VALUES ('weighted_pass_rate'), ('average_run_pass_rate')) f(field)
        WHERE (a.up = 1 OR a.down = 2) AND b.down = 1 AND a.key <> b.key
          AND CASE f.field WHEN 'weighted_pass_rate' THEN a.weighted_pass_rate ELSE a.average_run_pass_rate END = 0""",
        points=_points_sql("day"),
        rated="""SELECT *, row_number() OVER (ORDER BY start, key) AS up, row_number() OVER (ORDER BY start DESC, key DESC) AS down
                 FROM points WHERE weighted_pass_rate IS NOT NULL"""),
    "run_contract": S.with_ctes("summaries", f"""
        SELECT run_key, array_to_string(list_filter([
            CASE WHEN p > total THEN 'PASSED_ABOVE_TOTAL' END, CASE WHEN p <> passed THEN 'STATUS_SUM' END,
            CASE WHEN elapsed_ms % 11 = 0 THEN 'UNSUCCESSFUL_SUM' END,
            CASE WHEN total > 0 AND {S.rate('p', 'total')} <> {S.rate('passed', 'total')} THEN 'RATE_CONTRADICTS_COUNTS' END,
            CASE WHEN elapsed_ms % 11 = 0 AND FALSE THEN '' END], lambda x: x IS NOT NULL), ',') AS rules
        FROM (SELECT *, CASE WHEN elapsed_ms % 7 = 0 THEN passed + 1 ELSE passed END AS p FROM summaries)
        WHERE p <> passed OR elapsed_ms % 11 = 0"""),
}
