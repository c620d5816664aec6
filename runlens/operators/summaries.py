"""Per-run summaries of test records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.fixed_values import FINAL_STATUSES, METADATA_DEFAULTS, UNKNOWN_CATEGORY
from runlens.functions import failures as rules
from runlens.functions.numbers import DURATION_TYPE, checked_duration, fixed_text, mean, percent, rate
from runlens.functions.text import duration_text, none_if_empty

STATUS_COLUMNS = ("passed", "failed", "skipped", "timed_out", "interrupted")


def zero_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint"))


def status_counts(executions: DataFrame) -> DataFrame:
    """Counts and exact durations per run, in one aggregation."""
    status = rules.canonical_status(F.col("status"))
    counts = [F.count_if(status == s).alias(c) for s, c in zip(("PASSED", "FAILED", "SKIPPED", "TIMEDOUT", "INTERRUPTED"), STATUS_COLUMNS)]
    return executions.groupBy("run_id").agg(
        F.count("*").alias("total"),
        *counts,
        F.sum(F.col("duration").cast(DURATION_TYPE)).alias("duration_units"),
        F.count_if(F.col("trace_available")).alias("trace_reported"),
    )


def run_summaries(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """One summary per run; a run without records keeps its row with zero counts."""
    joined = runs.join(status_counts(executions), "run_id", "left")
    unsuccessful = zero_if_null("failed") + zero_if_null("timed_out") + zero_if_null("interrupted")
    total_duration = F.coalesce(checked_duration(F.col("duration_units"), "run duration"), F.lit(0.0))
    return joined.select(
        *runs.columns,
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("elapsed_ms"),
        *[zero_if_null(c).alias(c) for c in ("total", *STATUS_COLUMNS)],
        unsuccessful.alias("unsuccessful"),
        F.coalesce(rate(F.col("passed"), F.col("total")), F.lit(0.0)).alias("pass_rate"),
        total_duration.alias("total_duration"),
        F.coalesce(mean(total_duration, F.col("total")), F.lit(0.0)).alias("average_duration"),
        zero_if_null("trace_reported").alias("trace_reported"),
    )


def failure_category_counts(executions: DataFrame) -> DataFrame:
    """Failures per run and stored category; a timeout without category counts as a timeout failure."""
    status = rules.canonical_status(F.col("status"))
    default = F.when(status == "TIMEDOUT", "TIMEOUT_FAILURE").otherwise(UNKNOWN_CATEGORY)
    return (
        executions.filter(rules.is_failing(F.col("status")))
        .groupBy("run_id", F.coalesce(none_if_empty(F.col("stored_category")), default).alias("category"))
        .agg(F.count("*").alias("failures"))
    )


def category_maps(counts: DataFrame) -> DataFrame:
    """Failure counts of each run as a map with sorted keys; one entry per category of the run."""
    entries = F.array_sort(F.collect_list(F.struct("category", "failures")))
    return counts.groupBy("run_id").agg(F.map_from_entries(entries).alias("failure_category_counts"))


def current_summaries(executions: DataFrame) -> DataFrame:
    """Live summary of each run with the pass rate as text."""
    counts = status_counts(executions)
    rate_text = F.coalesce(fixed_text(percent(F.col("passed"), F.col("total")), 2), F.lit("0.00"))
    return counts.select(
        "run_id", "total", *STATUS_COLUMNS,
        (F.col("failed") + F.col("timed_out") + F.col("interrupted")).alias("unsuccessful"),
        rate_text.alias("pass_rate"),
        F.col("duration_units").cast("double").alias("total_duration"),
    )


def unfinished_runs(executions: DataFrame) -> DataFrame:
    """Runs that must not enter the history: a record is still running or has an unknown status."""
    status = rules.canonical_status(F.col("status"))
    bad = ~status.isin(*FINAL_STATUSES)
    return (
        executions.groupBy("run_id")
        .agg(
            F.count_if(bad).alias("bad_records"),
            F.min_by(F.when(bad, status), F.when(bad, F.col("ordinal"))).alias("first_status"),
        )
        .filter(F.col("bad_records") > 0)
    )


def metadata_with_defaults(runs: DataFrame) -> DataFrame:
    """Metadata with the defaults a run without them gets."""
    return runs.select(
        "run_id",
        *[(F.coalesce(none_if_empty(F.col(name)), F.lit(value)) if name in runs.columns else F.lit(value)).alias(name)
          for name, value in METADATA_DEFAULTS],
    )


def status_distribution(summaries: DataFrame) -> DataFrame:
    """Shares of passed, failed and skipped tests of each run; empty parts are left out."""
    parts = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(c).alias("n"))
                      for i, (label, c) in enumerate((("Passed", "passed"), ("Failed", "failed"), ("Skipped", "skipped")), 1)])
    whole = F.col("passed") + F.col("failed") + F.col("skipped")
    return (
        summaries.select("run_id", whole.alias("whole"), F.inline(parts))
        .filter(F.col("n") > 0)
        .select("run_id", F.col("position").cast("bigint"), "label", "n", rate(F.col("n"), F.col("whole")).alias("percentage"))
    )


def execution_summary(summaries: DataFrame) -> DataFrame:
    """Metric and value rows of the run report."""
    rate_text = F.concat(fixed_text(F.coalesce(percent(F.col("passed"), F.col("total")), F.lit(0.0)), 2), F.lit("%"))
    rows = [
        ("Total Tests", F.col("total").cast("string")),
        ("Passed", F.col("passed").cast("string")),
        ("Failed", F.col("failed").cast("string")),
        ("Skipped", F.col("skipped").cast("string")),
        ("Pass Rate", rate_text),
        ("Total Duration", duration_text(F.col("total_duration"))),
    ]
    parts = F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(m).alias("metric"), v.alias("value"))
                      for i, (m, v) in enumerate(rows, 1)])
    return summaries.select("run_id", F.inline(parts))


def automation_health(summaries: DataFrame, coverage: DataFrame) -> DataFrame:
    """Health label with reasons from the counts of a run and its capture rate."""
    joined = summaries.join(coverage.select("run_id", "capture_rate"), "run_id", "left")
    failed, passed, pass_rate = F.col("failed"), F.col("passed"), F.col("pass_rate")
    capture = F.coalesce("capture_rate", F.lit(0.0))
    healthy = (failed == 0) & (pass_rate >= 95) & (capture >= 95)
    plural = F.when(failed != 1, "s").otherwise("")
    attention = F.array_compact(
        F.array(
            F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failed test"), plural, F.lit(" detected."))),
            F.when(pass_rate < 95, "Pass rate below target."),
            F.when(capture < 95, "Coverage below target."),
        )
    )
    return joined.select(
        "run_id",
        F.when(failed > passed, "critical").when(healthy, "healthy").otherwise("attention").alias("health"),
        F.when(failed > passed, "Critical Issues Detected").when(healthy, "Healthy Run").otherwise("Attention Required").alias("heading"),
        F.when(failed > passed, "Multiple failures require investigation.")
        .when(healthy, "All tests passed. | Auto-capture coverage is excellent.")
        .otherwise(F.array_join(attention, " | "))
        .alias("reasons"),
    )


def slowest_tests(executions: DataFrame, size: int = 5) -> DataFrame:
    """The longest tests of each run; equal durations keep record order."""
    order = Window.partitionBy("run_id").orderBy(F.desc("duration"), "ordinal")
    return (
        executions.filter(F.col("duration") > 0)
        .select("run_id", "test_case", "duration", "ordinal")
        .withColumn("position", F.row_number().over(order).cast("bigint"))
        .filter(F.col("position") <= size)
        .select("run_id", "position", "test_case", "duration", duration_text(F.col("duration")).alias("duration_text"))
    )
