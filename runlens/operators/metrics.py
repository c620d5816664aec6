"""Historical metrics over run summaries: filter, order, limit, then roll up."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.fixed_values import (
    GROUP_DIMENSIONS,
    HISTORY_SCHEMA_VERSION,
    INPUT_TIMESTAMP_PATTERN,
    MAX_SAFE_INTEGER,
    RUN_ID_PATTERN,
    TIME_DIMENSIONS,
)
from runlens.functions.numbers import DURATION_TYPE, RATE_TYPE, checked_duration, checked_total, mean, percent, rate, to_fixed2
from runlens.functions.times import bucket_end, bucket_key, bucket_start, iso_text
from runlens.operators.summaries import STATUS_COLUMNS

COLUMNS = {
    "project": "project", "feature": "feature", "environment": "environment", "browser": "browser",
    "executedBy": "executed_by", "schemaVersion": "schema_version",
}


def parse_time(value, label: str) -> datetime | None:
    """A query bound as UTC time; text must be a full ISO timestamp with zone."""
    if value is None:
        return None
    if isinstance(value, str):
        if not re.match(INPUT_TIMESTAMP_PATTERN, value):
            raise TypeError(f"{label} must be a full ISO-8601 timestamp.")
        zone = timedelta(0)
        if not value.endswith("Z"):
            hours, minutes = int(value[-5:-3]), int(value[-2:])
            if hours > 23 or minutes > 59:
                raise TypeError(f"{label} must be a valid date.")
            zone = timedelta(hours=hours, minutes=minutes) * (-1 if value[-6] == "-" else 1)
        fraction = re.match(r".{19}\.(\d+)", value)
        try:
            local = datetime.strptime(value[:19], "%Y-%m-%dT%H:%M:%S")
        except ValueError as error:
            raise TypeError(f"{label} must be a valid date.") from error
        milliseconds = int(fraction.group(1).ljust(3, "0")) if fraction else 0
        value = local.replace(tzinfo=timezone.utc) + timedelta(milliseconds=milliseconds) - zone
    if not isinstance(value, datetime):
        raise TypeError(f"{label} must be a datetime or a full ISO-8601 timestamp.")
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def _names(value, label: str, pattern: str | None = None) -> tuple[str, ...] | None:
    if value is None:
        return None
    values = tuple(value) if isinstance(value, (list, tuple)) else (value,)
    if not values or any(not isinstance(v, str) or not v.strip() for v in values):
        raise TypeError(f"{label} must contain non-empty strings.")
    if pattern and any(not re.match(pattern, v) for v in values):
        raise TypeError(f"{label} contains an invalid value.")
    if len(set(values)) != len(values):
        raise TypeError(f"{label} must contain unique values.")
    return values


@dataclass(frozen=True)
class RunQuery:
    """Which runs count: inclusive time bounds, value lists, order and limit. Checked before any plan is built."""

    start: object = None
    end: object = None
    run_ids: object = None
    project: object = None
    feature: object = None
    environment: object = None
    browser: object = None
    executedBy: object = None
    schemaVersion: object = HISTORY_SCHEMA_VERSION
    include_migrated: bool = True
    newest_first: bool = True
    limit: int | None = None
    lists: dict = field(init=False, repr=False, default=None)

    def __post_init__(self):
        start, end = parse_time(self.start, "start"), parse_time(self.end, "end")
        if start and end and start > end:
            raise TypeError("start must not be later than end.")
        lists = {column: _names(getattr(self, name), name) for name, column in COLUMNS.items()}
        unknown = set(lists["schema_version"] or ()) - {HISTORY_SCHEMA_VERSION}
        if unknown:
            raise TypeError(f"Unsupported history schema version requested: {sorted(unknown)[0]}")
        lists["run_key"] = _names(self.run_ids, "run_ids", RUN_ID_PATTERN)
        for name in ("include_migrated", "newest_first"):
            if not isinstance(getattr(self, name), bool):
                raise TypeError(f"{name} must be a boolean.")
        limit = self.limit
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 0 <= limit <= MAX_SAFE_INTEGER):
            raise TypeError("limit must be a non-negative integer or None.")
        object.__setattr__(self, "start", start)
        object.__setattr__(self, "end", end)
        object.__setattr__(self, "lists", lists)

    def condition(self) -> Column:
        """One conjunction of plain comparisons, which reaches the scan; a missing value matches no list."""
        test = F.lit(True)
        if self.start:
            test = test & (F.col("started_at") >= F.lit(self.start))
        if self.end:
            test = test & (F.col("started_at") <= F.lit(self.end))
        for column, values in self.lists.items():
            if values:
                test = test & F.col(column).isin(*values)
        if not self.include_migrated:
            test = test & ~F.col("migrated")
        return test


def matched_runs(runs: DataFrame, query: RunQuery) -> DataFrame:
    """Runs that fulfil the query; of a table partitioned by ``run_month`` only the months of its time range are read."""
    test = query.condition()
    if "run_month" in runs.columns:
        if query.start:
            test = test & (F.col("run_month") >= query.start.astimezone(timezone.utc).strftime("%Y-%m"))
        if query.end:
            test = test & (F.col("run_month") <= query.end.astimezone(timezone.utc).strftime("%Y-%m"))
    return runs.filter(test)


def selected_runs(runs: DataFrame, query: RunQuery) -> DataFrame:
    """Matching runs; a limit keeps the first of the requested order, before any grouping."""
    matched = matched_runs(runs, query)
    if query.limit is None:
        return matched
    order = [F.desc, F.desc] if query.newest_first else [F.asc, F.asc]
    return matched.orderBy(order[0]("started_at"), order[1]("run_key")).limit(query.limit)


def normalized_runs(runs: DataFrame) -> DataFrame:
    """Public form of run rows: times as text, rates recomputed from the counts, null without tests."""
    return runs.select(
        "run_key", iso_text(F.col("started_at")).alias("started_at"), iso_text(F.col("ended_at")).alias("ended_at"), "elapsed_ms",
        "total", *STATUS_COLUMNS, "unsuccessful",
        rate(F.col("passed"), F.col("total")).alias("pass_rate"),
        "total_duration", mean(F.col("total_duration"), F.col("total")).alias("average_duration"),
        "project", "feature", "environment", "browser", "executed_by", "trace_reported", "trace_preserved",
    )


def _sums() -> list[Column]:
    counts = ["total", *STATUS_COLUMNS, "unsuccessful", "elapsed_ms", "trace_reported", "trace_preserved"]
    return [
        F.count("*").alias("run_count"),
        *[F.sum(c).alias(c) for c in counts],
        F.sum(F.col("total_duration").cast(DURATION_TYPE)).alias("duration_units"),
        F.count_if(F.col("total") > 0).alias("rated_run_count"),
        F.sum(percent(F.col("passed"), F.col("total")).cast(RATE_TYPE)).alias("run_rates"),
        *[F.count_if(F.col(c)).alias(c) for c in ("has_pdf", "has_dashboard", "has_evidence", "has_traces")],
    ]


def _metric_columns() -> list[Column]:
    """Published metrics from the sums; rates come from summed counts, never from averaged rates."""
    c = F.col

    def total(name: str, label: str) -> Column:
        return F.coalesce(checked_total(c(name), label), F.lit(0).cast("bigint"))

    duration = F.coalesce(checked_duration(c("duration_units"), "total test duration"), F.lit(0.0))
    return [
        c("run_count"),
        total("total", "total tests").alias("tests"),
        *[total(s, s).alias(s) for s in (*STATUS_COLUMNS, "unsuccessful")],
        rate(c("passed"), c("total")).alias("weighted_pass_rate"),
        to_fixed2(F.when(c("rated_run_count") > 0, c("run_rates").cast("double") / c("rated_run_count"))).alias("average_run_pass_rate"),
        rate(c("unsuccessful"), c("total")).alias("unsuccessful_rate"),
        rate(c("skipped"), c("total")).alias("skipped_rate"),
        c("rated_run_count"),
        duration.alias("total_test_duration_ms"),
        mean(duration, c("run_count")).alias("average_run_test_duration_ms"),
        mean(duration, c("total")).alias("average_test_duration_ms"),
        total("elapsed_ms", "elapsed duration").alias("total_elapsed_duration_ms"),
        mean(c("elapsed_ms"), c("run_count")).alias("average_run_elapsed_duration_ms"),
        total("trace_reported", "reported traces").alias("traces_reported"),
        total("trace_preserved", "preserved traces").alias("traces_preserved"),
        *[c(f"has_{name}").alias(f"{name}_count") for name in ("pdf", "dashboard", "evidence", "traces")],
    ]


def aggregate_runs(runs: DataFrame, query: RunQuery | None = None) -> DataFrame:
    """Overall metrics of the selected runs as one row."""
    return selected_runs(runs, query or RunQuery()).agg(*_sums()).select(*_metric_columns())


def check_dimension(dimension: str) -> str:
    if dimension not in GROUP_DIMENSIONS:
        raise TypeError(f"Unsupported grouping dimension: {dimension}")
    return dimension


def group_value(dimension: str) -> Column:
    """What runs are grouped by: the start of their time bucket, or a text."""
    if dimension in TIME_DIMENSIONS:
        return bucket_start(dimension, F.col("started_at"))
    if dimension == "migration":
        return F.when(F.col("migrated"), "migrated").otherwise("native")
    return F.col(COLUMNS[check_dimension(dimension)])


def group_runs(runs: DataFrame, dimension: str, query: RunQuery | None = None, with_total: bool = True) -> DataFrame:
    """Metrics per group of a dimension and, marked ``is_total``, of the whole selection, in one pass.

    Runs without a value form the group without key, labelled Unknown.
    """
    is_time = check_dimension(dimension) in TIME_DIMENSIONS
    keyed = selected_runs(runs, query or RunQuery()).withColumn("group_value", group_value(dimension))
    if with_total:
        summed = keyed.rollup("group_value").agg(F.grouping_id().alias("level"), *_sums())
    else:
        summed = keyed.groupBy("group_value").agg(F.lit(0).alias("level"), *_sums())
    is_total = F.col("level") == 1
    start, none = F.col("group_value"), F.lit(None).cast("string")
    key = bucket_key(dimension, start) if is_time else start
    if dimension == "migration":
        label = F.initcap(start)
    else:
        label = F.coalesce(key, F.lit("Unknown"))
    return summed.select(
        is_total.alias("is_total"),
        key.alias("key"),
        F.when(~is_total, label).alias("label"),
        (iso_text(start) if is_time else none).alias("start"),
        (iso_text(bucket_end(dimension, start)) if is_time else none).alias("end_exclusive"),
        *_metric_columns(),
    )


def category_totals(counts: DataFrame, runs: DataFrame, dimension: str | None, query: RunQuery | None = None) -> DataFrame:
    """Failures per group and category and, marked ``is_total``, per category of the whole selection, in one pass.

    ``counts``: run_id, category, failures. The groups are those of ``group_runs``; without a dimension only the totals come.
    """
    selected = selected_runs(runs, query or RunQuery())
    value = F.lit(None).cast("string") if dimension is None else group_value(dimension)
    joined = counts.join(selected.select("run_id", value.alias("group_value")), "run_id")
    if dimension is None:
        summed = joined.groupBy("category").agg(F.lit(1).alias("level"), F.lit(None).cast("string").alias("group_value"), F.sum("failures").alias("failures"))
    else:
        summed = joined.groupingSets([["category", "group_value"], ["category"]], "category", "group_value").agg(
            F.grouping("group_value").alias("level"), F.sum("failures").alias("failures"))
    key = bucket_key(dimension, F.col("group_value")) if dimension in TIME_DIMENSIONS else F.col("group_value")
    return summed.select(
        (F.col("level") == 1).alias("is_total"), key.alias("key"), "category", checked_total(F.col("failures"), "failures").alias("failures"),
    )


def date_range(runs: DataFrame, query: RunQuery | None = None) -> DataFrame:
    """First and last start time of the matching runs, as they were stored where that is known; the limit does not count."""
    place = F.struct("started_at", "run_key") if "run_key" in runs.columns else F.col("started_at")
    text = F.col("started_text") if "started_text" in runs.columns else iso_text(F.col("started_at"))
    return matched_runs(runs, query or RunQuery()).agg(
        F.min_by(text, place).alias("first_start"), F.max_by(text, place).alias("last_start"), F.count("*").alias("runs")
    )


def runs_by_id_table(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs named in a table of run keys, for lists too long for a query."""
    return runs.join(wanted.select("run_key"), "run_key", "left_semi")


def contract_violations(rows: DataFrame) -> DataFrame:
    """Run rows whose counts or rate contradict each other, with the broken rules."""
    c = F.col
    statuses = c("passed") + c("failed") + c("skipped") + c("timed_out") + c("interrupted")
    expected = rate(c("passed"), c("total"))
    rules = {
        "COUNT_RANGE": ~F.greatest(*[F.abs(c(x)) for x in ("total", *STATUS_COLUMNS)]).between(0, MAX_SAFE_INTEGER)
        | (F.least(*[c(x) for x in ("total", *STATUS_COLUMNS)]) < 0),
        "PASSED_ABOVE_TOTAL": c("passed") > c("total"),
        "STATUS_SUM": statuses != c("total"),
        "UNSUCCESSFUL_SUM": c("unsuccessful") != c("failed") + c("timed_out") + c("interrupted"),
        "RATE_WITHOUT_TESTS": (c("total") == 0) & c("pass_rate").isNotNull(),
        "RATE_CONTRADICTS_COUNTS": (c("total") > 0) & ~c("pass_rate").eqNullSafe(expected),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return rows.withColumn("rules", broken).filter(F.size("rules") > 0)


def _rows_of(broken: DataFrame, level: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks: level, key, rule."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return broken.select(F.lit(level).alias("level"), key.cast("string").alias("key"), F.explode(names).alias("rule"))


def level_violations(groups: DataFrame, source: DataFrame, runs: DataFrame, dimension: str) -> DataFrame:
    """What contradicts itself or another level of one result: ``level`` (group, total, source), ``key`` and ``rule``.

    ``groups``: rows of ``group_runs`` with their total. ``source``: counters of ``source_counters``, one row. ``runs``: the selected run
    rows. Runs are added up for all groups and for the whole in one pass, and each sum is compared with the row that states it.
    """
    c = F.col
    safe = lambda *names: F.coalesce(F.least(*names) < 0, F.lit(True)) | (F.greatest(*names) > MAX_SAFE_INTEGER)
    is_time = check_dimension(dimension) in TIME_DIMENSIONS
    expected = rate(c("passed"), c("tests"))
    own = {
        "COUNT_RANGE": safe("run_count", "tests", "passed"),
        "PASSED_ABOVE_TESTS": c("passed") > c("tests"),
        "RATE_WITHOUT_TESTS": (c("tests") == 0) & c("weighted_pass_rate").isNotNull(),
        "RATE_CONTRADICTS_TOTALS": (c("tests") > 0) & ~c("weighted_pass_rate").eqNullSafe(expected),
        "AVERAGE_RATE_RANGE": ~c("average_run_pass_rate").between(0, 100),
    }
    named = {"LABEL_LENGTH": F.length("label") > 512, "LABEL_MISSING": c("label").isNull()}
    if is_time:
        named["START_NOT_BEFORE_END"] = ~F.coalesce(c("start") < c("end_exclusive"), F.lit(False))
    value = group_value(dimension)
    summed = runs.withColumn("value", value).groupingSets([["value"], []], "value").agg(
        F.grouping("value").alias("whole"), F.count("*").alias("r_runs"), F.sum("total").alias("r_tests"), F.sum("passed").alias("r_passed"))
    key = bucket_key(dimension, c("value")) if is_time else c("value").cast("string")
    stated = summed.select((c("whole") == 1).alias("r_total"), key.alias("r_key"), "r_runs", "r_tests", "r_passed")
    met = groups.join(stated, (c("is_total") == c("r_total")) & c("key").eqNullSafe(c("r_key")), "full")
    differs = {
        "NO_RUNS_OF_GROUP": c("r_total").isNull() & (c("run_count") > 0),
        "GROUP_MISSING": c("is_total").isNull() & (c("r_runs") > 0),
        "DIFFERS_FROM_RUNS": c("is_total").isNotNull() & c("r_total").isNotNull() & (
            F.struct("run_count", "tests", "passed") != F.struct(c("r_runs"), F.coalesce("r_tests", F.lit(0)).alias("t"), F.coalesce("r_passed", F.lit(0)).alias("p"))),
    }
    parts = groups.filter(~c("is_total")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"g_{x}") for x in ("run_count", "tests", "passed")])
    # Sums of all groups, the total row and the counters are one row each.
    whole = groups.filter("is_total").select(*[c(x).alias(f"t_{x}") for x in ("run_count", "tests", "passed")])
    one = parts.unionByName(whole, allowMissingColumns=True).unionByName(source.withColumn("s", F.lit(1)), allowMissingColumns=True)
    one = one.agg(*[F.max(x).alias(x) for x in one.columns])
    counters = ("discovered", "valid", "excluded", "aggregation_excluded", "matched", "selected")
    between = {
        "TOTAL_DIFFERS_FROM_GROUPS": F.struct("t_run_count", "t_tests", "t_passed") != F.struct("g_run_count", "g_tests", "g_passed"),
    }
    sources = {
        "COUNTER_RANGE": safe(*counters),
        "DISCOVERED_SUM": c("discovered") != c("valid") + c("excluded"),
        "AGGREGATION_EXCLUDED_ABOVE_VALID": c("aggregation_excluded") > c("valid"),
        "SELECTED_ABOVE_MATCHED": c("selected") > c("matched"),
        "MATCHED_ABOVE_USABLE": c("matched") > c("valid") - c("aggregation_excluded"),
        "SELECTED_DIFFERS_FROM_GROUPS": c("selected") != c("g_run_count"),
    }
    found = [
        _rows_of(groups.filter(~c("is_total")), "group", c("key"), {**own, **named}),
        _rows_of(groups.filter("is_total"), "total", F.lit(None), own),
        _rows_of(met, "runs", F.coalesce("key", "r_key"), differs),
        _rows_of(one, "total", F.lit(None), between), _rows_of(one, "source", F.lit(None), sources),
    ]
    return reduce(DataFrame.union, found)
