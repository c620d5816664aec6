"""Recorder events folded into attempts, test records, coverage and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.fixed_values import TOP_LIST_SIZE, UNFINISHED_MESSAGE
from runlens.functions import failures as rules
from runlens.functions.numbers import rate
from runlens.functions.text import clean_message
from runlens.session import written

TEST_KEY = ("run_id", "test_case")
RUN_FIELDS = ("project", "feature", "environment", "browser", "executed_by", "run_status")
TEST_EVENTS = ("test_start", "step", "complete")


def sliced_events(events: DataFrame, keys: tuple[str, ...], slices: int | None = None) -> DataFrame:
    """Events written in range slices of (key, time), with their slice number: a key with very many rows lies in many slices."""
    number = slices or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(events.repartitionByRange(number, *keys, "event_time", "seq").withColumn("slice", F.spark_partition_id()))


def running_count(events: DataFrame, keys: tuple[str, ...], flag: Column, name: str, slices: int | None = None) -> DataFrame:
    """Add the number of flagged rows of the key up to and including each row, in time order.

    Rows are counted within the slices of a key and the slices are added up afterwards, so no key is one task.
    """
    sliced = sliced_events(events.withColumn("flag", F.when(flag, 1).otherwise(0).cast("bigint")), keys, slices)
    in_slice = Window.partitionBy(*keys, "slice").orderBy("event_time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, "slice").agg(F.sum("flag").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counted = sliced.withColumn("here", F.sum("flag").over(in_slice))
    joined = counted.join(offsets.select(*keys, "slice", "offset"), [*keys, "slice"])
    return joined.withColumn(name, F.col("here") + F.col("offset")).drop("here", "offset", "flag", "slice")


def _last(value: Column, when: Column) -> Column:
    """The latest value among the rows that satisfy a condition."""
    return F.max_by(value, F.when(when, F.struct("event_time", "seq")))


def fold_attempts(events: DataFrame) -> DataFrame:
    """One row per test and attempt; number 0 holds what came before the first start.

    Within an attempt the last completion decides status and duration, the last given error text stays.
    """
    kind = F.col("kind")
    done = kind == "complete"
    message = clean_message(F.col("error_message"))
    numbered = running_count(events.filter(kind.isin(*TEST_EVENTS)), TEST_KEY, kind == "test_start", "attempt")
    read = (
        numbered.withColumn("message", F.when(done, message))
        .withColumn("folded", F.when(done, rules.folded(F.col("message"))))
        .withColumn("category", F.when(done & rules.is_failing(F.col("status")), rules.failure_category(F.col("message"), F.col("folded"))))
    )
    return read.groupBy(*TEST_KEY, "attempt").agg(
        F.min(F.when(kind == "test_start", F.col("event_time"))).alias("started_at"),
        F.max(F.when(kind == "test_start", F.col("retry"))).alias("retry"),
        F.count_if(kind == "step").alias("steps"),
        F.count_if((kind == "step") & (F.col("status") == "FAIL")).alias("failed_steps"),
        _last(rules.canonical_status(F.col("status")), done).alias("status"),
        _last(F.coalesce("duration", F.lit(0.0)), done).alias("duration"),
        _last(F.col("message"), done & F.col("message").isNotNull()).alias("error_message"),
        _last(F.col("category"), F.col("category").isNotNull()).alias("category"),
        F.max(F.when(done, F.col("event_time"))).alias("finished_at"),
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
    )


def attempts(folded: DataFrame, finished: bool = True) -> DataFrame:
    """Attempts with their public number.

    With ``finished`` the run is over: the last attempt of a test, if it has no completion, fails at the run's last event. Earlier
    attempts without completion stay running, as nothing ever ended them.
    """
    c = F.col
    own = folded.filter(c("attempt") > 0)
    latest = own.groupBy(*TEST_KEY).agg(F.max("attempt").alias("latest"))
    ends = folded.groupBy("run_id").agg(F.max("last_event").alias("run_end"))
    ended = c("status").isNull() & (c("attempt") == c("latest")) & F.lit(finished)
    return own.join(latest, list(TEST_KEY)).join(ends, "run_id").select(
        *TEST_KEY, "attempt", (c("retry") + 1).alias("attempt_number"), "retry", "steps", "failed_steps",
        F.when(ended, "FAILED").otherwise(F.coalesce("status", F.lit("RUNNING"))).alias("status"), F.coalesce("duration", F.lit(0.0)).alias("duration"),
        F.when(ended, F.coalesce("error_message", F.lit(UNFINISHED_MESSAGE))).otherwise(c("error_message")).alias("error_message"),
        "started_at", F.when(ended, c("run_end")).otherwise(c("finished_at")).alias("finished_at"),
    )


def test_records(folded: DataFrame, finished: bool = True) -> DataFrame:
    """Current record of each test: its last attempt, with the last failure category of any attempt.

    With ``finished`` the run is over: a record still running becomes a failure by timeout.
    """
    last = F.struct("status", "duration", "error_message", "steps", "retry", "started_at", "first_event")
    records = folded.groupBy(*TEST_KEY).agg(
        F.max_by(last, "attempt").alias("last"),
        F.max_by("category", F.when(F.col("category").isNotNull(), F.col("attempt"))).alias("category"),
        F.count_if(F.col("attempt") > 0).alias("attempts"),
    )
    running = F.col("last.status").isNull()
    ended = running if finished else F.lit(False)
    return records.select(
        *TEST_KEY,
        F.when(ended, "FAILED").otherwise(F.coalesce("last.status", F.lit("RUNNING"))).alias("status"),
        F.coalesce("last.duration", F.lit(0.0)).alias("duration"),
        F.when(ended, F.coalesce("last.error_message", F.lit(UNFINISHED_MESSAGE))).otherwise(F.col("last.error_message")).alias("error_message"),
        F.when(ended, "TIMEOUT_FAILURE").otherwise(F.col("category")).alias("failure_category"),
        "attempts", F.coalesce("last.retry", F.lit(0).cast("bigint")).alias("retry_count"), F.col("last.steps").alias("steps"),
        F.coalesce("last.started_at", "last.first_event").alias("execution_date"),
        running.alias("was_running"),
    )


def step_numbers(events: DataFrame) -> DataFrame:
    """Steps with their number within the test."""
    steps = events.filter(F.col("kind") == "step")
    numbered = running_count(steps, TEST_KEY, F.lit(True), "step_no")
    return numbered.select(*TEST_KEY, "step_no", "seq", "action", "status", "duration")


def completion_categories(events: DataFrame, records: DataFrame) -> DataFrame:
    """Failure counter of each run: every failing completion, and the tests that never completed."""
    message = clean_message(F.col("error_message"))
    failing = events.filter((F.col("kind") == "complete") & rules.is_failing(F.col("status")))
    read = failing.select("run_id", message.alias("message")).withColumn("folded", rules.folded(F.col("message")))
    counted = read.groupBy("run_id", rules.failure_category(F.col("message"), F.col("folded")).alias("category")).agg(F.count("*").alias("n"))
    unfinished = records.filter("was_running").groupBy("run_id").agg(F.count("*").alias("n")).withColumn("category", F.lit("TIMEOUT_FAILURE"))
    return counted.unionByName(unfinished).groupBy("run_id", "category").agg(F.sum("n").alias("failures"))


def _coverage_columns() -> list[Column]:
    missed = F.greatest(F.lit(0).cast("bigint"), F.col("detected") - F.col("captured"))
    return ["detected", "captured", missed.alias("missed"),
            F.coalesce(rate(F.col("captured"), F.col("detected")), F.lit(0.0)).alias("capture_rate")]


def capture_coverage(events: DataFrame) -> DataFrame:
    """Detected and captured actions per run and action and, marked ``is_total``, per run, in one pass."""
    steps = events.filter(F.col("action").isNotNull())
    summed = steps.groupingSets([["run_id", "action"], ["run_id"]], "run_id", "action").agg(
        F.grouping_id().alias("level"), F.count("*").alias("detected"), F.count_if(F.col("phase") == "captured").alias("captured")
    )
    return summed.select("run_id", "action", (F.col("level") == 1).alias("is_total"), *_coverage_columns())


def run_coverage(events: DataFrame) -> DataFrame:
    steps = events.filter(F.col("action").isNotNull())
    return steps.groupBy("run_id").agg(F.count("*").alias("detected"), F.count_if(F.col("phase") == "captured").alias("captured")).select(
        "run_id", *_coverage_columns()
    )


def top_actions(events: DataFrame, size: int = TOP_LIST_SIZE) -> DataFrame:
    """Most captured actions of each run; ties keep the order of first appearance."""
    counted = events.filter(F.col("action").isNotNull()).groupBy("run_id", "action").agg(
        F.count("*").alias("detected"), F.count_if(F.col("phase") == "captured").alias("captured"), F.min("seq").alias("first_seq")
    )
    order = Window.partitionBy("run_id").orderBy(F.desc("captured"), "first_seq")
    return (
        counted.withColumn("position", F.row_number().over(order).cast("bigint"))
        .filter(F.col("position") <= size)
        .select("run_id", "position", "action", "captured", "detected")
    )


def run_metadata(events: DataFrame) -> DataFrame:
    """Run metadata from its updates: the last given value of each field that the events have; a reset restarts the clock.

    With a ``run_status`` the time of the last update that ended the run comes along; a run that goes on again has no end.
    """
    c = F.col
    start = F.coalesce(F.max(F.when(c("reset"), c("event_time"))), F.min("event_time"))
    fields = [c(name) for name in RUN_FIELDS if name in events.columns]
    names = [name for name in RUN_FIELDS if name in events.columns]
    found = events.filter(c("kind") == "run_update").groupBy("run_id").agg(
        *[_last(value, value.isNotNull()).alias(name) for name, value in zip(names, fields)],
        start.alias("execution_start"), F.count("*").alias("updates"),
        *([F.max(F.when(c("run_status").isNotNull(), c("event_time"))).alias("execution_end")] if "run_status" in names else []),
    )
    if "run_status" not in names:
        return found
    return found.withColumn("execution_end", F.when(c("run_status") != "RUNNING", c("execution_end")))


