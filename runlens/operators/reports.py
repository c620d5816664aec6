"""Tables behind the run reports: tests, failures, steps, traces and API activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.fixed_values import UNKNOWN_CATEGORY
from runlens.functions import failures as rules
from runlens.functions.text import duration_text, file_size_text, none_if_empty
from runlens.functions.times import iso_text
from runlens.functions.web import api_endpoint, is_api_call, is_included, is_static_resource


def api_log(calls: DataFrame) -> DataFrame:
    """Calls worth keeping: no static resources, no telemetry."""
    return calls.filter(is_api_call(F.col("url")))


def recorded_calls(calls: DataFrame, include: Sequence[str] = ()) -> DataFrame:
    """Calls the recorder takes: the URL holds one of the texts, if any are given, and is no static resource."""
    own = calls.filter(~is_static_resource(F.col("url")))
    return own.filter(is_included(F.col("url"), include)) if include else own


def api_activity(executions: DataFrame, calls: DataFrame) -> DataFrame:
    """Kept API calls of each test record; records without calls keep one row without endpoint."""
    kept = api_log(calls).select(
        "run_id", "test_case", "seq", F.coalesce(none_if_empty(F.col("method")), F.lit("N/A")).alias("method"),
        api_endpoint(F.col("url")).alias("endpoint"),
        F.coalesce(F.nullif(F.col("status"), F.lit(0)).cast("string"), F.lit("N/A")).alias("http_status"),
        duration_text(F.col("duration")).alias("time"),
    )
    return executions.select("run_id", "test_case", "ordinal").join(kept, ["run_id", "test_case"], "left")


def test_case_table(executions: DataFrame) -> DataFrame:
    return executions.select(
        "run_id", "ordinal", "test_case", F.coalesce(none_if_empty(F.col("feature")), F.lit("-")).alias("feature"),
        rules.canonical_status(F.col("status")).alias("status"), duration_text(F.col("duration")).alias("duration"),
        F.coalesce("retry_count", F.lit(0).cast("bigint")).alias("retries"),
        # What only records from files have.
        *([F.coalesce(F.size("steps"), F.lit(0)).cast("bigint").alias("steps")] if "steps" in executions.columns else []),
        *([F.coalesce(iso_text(F.col("execution_date")), F.lit("-")).alias("date")] if "execution_date" in executions.columns else []),
    )


def recent_failures(classified: DataFrame) -> DataFrame:
    """Failed records with category and message; descending ``ordinal`` is the report order."""
    return classified.filter("failing").select(
        "run_id", "ordinal", "test_case", F.coalesce("failure_category", F.lit(UNKNOWN_CATEGORY)).alias("category"),
        F.coalesce(none_if_empty(F.col("message")), F.lit("No error message captured.")).alias("message"),
        *(["failure_screenshot"] if "failure_screenshot" in classified.columns else []),
    )


def trace_table(executions: DataFrame) -> DataFrame:
    """Records that report a trace, with its size as text."""
    return executions.filter(F.col("trace_available") == F.lit(True)).select(
        "run_id", "ordinal", "test_case", file_size_text(F.col("trace_size")).alias("size"), F.coalesce("output_dir", F.lit("-")).alias("location"),
        *(["trace_file"] if "trace_file" in executions.columns else []),
    )


def trace_overview(executions: DataFrame) -> DataFrame:
    """Records with, without and with unknown trace state per run; unknown is neither."""
    traced = F.col("trace_available")
    return executions.groupBy("run_id").agg(
        F.count_if(traced).alias("with_trace"), F.count_if(~traced).alias("without_trace"), F.count_if(traced.isNull()).alias("unknown")
    )


def detect_traces(executions: DataFrame, files: DataFrame) -> DataFrame:
    """Trace archive of each record by its output folder; ``files``: run_id, output_dir, path, size and, if known, modified_at."""
    facts = ["path", "size", *(["modified_at"] if "modified_at" in files.columns else [])]
    found = files.groupBy("run_id", "output_dir").agg(F.max(F.struct(*facts)).alias("trace"))
    return executions.select("run_id", "ordinal", "test_case", "output_dir").join(found, ["run_id", "output_dir"], "left").select(
        "run_id", "ordinal", "test_case", F.col("trace").isNotNull().alias("trace_available"),
        F.col("trace.path").alias("trace_file"), F.col("trace.size").alias("trace_size"),
        *([F.col("trace.modified_at").alias("trace_modified")] if "modified_at" in facts else []),
    )


def trace_counts(executions: DataFrame, files: DataFrame) -> DataFrame:
    """Traces reported by records and trace files preserved, per run with records."""
    reported = executions.groupBy("run_id").agg(F.count_if("trace_available").alias("reported"))
    preserved = files.groupBy("run_id").agg(F.count_distinct("path").alias("preserved"))
    return reported.join(preserved, "run_id", "left").select("run_id", "reported", F.coalesce("preserved", F.lit(0).cast("bigint")).alias("preserved"))


def step_descriptions(spark: SparkSession, described: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Described steps: name, title, action text, expected result; of two of one name the later one counts."""
    rows = {r[0]: r for r in described}
    return spark.createDataFrame(list(rows.values()), "name string, title string, action_text string, expected string")


def describe_steps(steps: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Steps with title, action and expected result; an undescribed step derives them from its name."""
    plain = F.replace("name", F.lit("_"), F.lit(" "))
    joined = steps.join(descriptions, "name", "left")
    title = F.coalesce("title", plain)
    recorded = F.col("action").isNotNull()
    return joined.select(
        *[c for c in steps.columns if c not in ("status",)],
        rules.canonical_status(F.col("status")).alias("status"),
        title.alias("title"),
        F.when(recorded, F.concat(F.lit("Perform "), "action", F.lit(" on "), F.coalesce("target", F.lit("element")), F.lit(".")))
        .otherwise(F.coalesce("action_text", F.concat(F.lit("Execute "), plain, F.lit(".")))).alias("action_text"),
        F.when(recorded, F.concat(title, F.lit(" action completes successfully.")))
        .otherwise(F.coalesce("expected", F.concat(plain, F.lit(" completes successfully.")))).alias("expected"),
        F.coalesce(
            none_if_empty(F.col("error_message")), F.concat(title, F.lit(" "), F.lower(rules.canonical_status(F.col("status"))), F.lit("."))
        ).alias("actual"),
    )


def failed_test_analysis(described: DataFrame) -> DataFrame:
    """The first failed step of each test that has one."""
    entry = F.struct("title", "error_message", "screenshot")
    failed = described.filter(F.col("status") == "FAILED")
    return failed.groupBy("test_case").agg(F.min_by(entry, "step_no").alias("step"), F.min("step_no").alias("step_no")).select(
        "test_case", "step_no", F.col("step.title").alias("failed_step"), F.coalesce("step.error_message", F.lit("N/A")).alias("error_message"),
        F.col("step.screenshot").alias("screenshot"),
    )


def with_existing_file(rows: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    """Rows whose file reference is present in a file listing (path)."""
    return rows.join(listing.select(F.col("path").alias(column)).distinct(), column, "left_semi")

