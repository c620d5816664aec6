"""Recorder events as a stream: test records with kept state, coverage and failure counters by aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runlens.fixed_values import UNFINISHED_MESSAGE
from runlens.functions import failures as rules
from runlens.functions.text import clean_message
from runlens.operators.lifecycle import TEST_EVENTS, TEST_KEY

RECORD_SCHEMA = (
    "run_id string, test_case string, attempt bigint, status string, duration double, error_message string, failure_category string, steps bigint, "
    "retry_count bigint, execution_date timestamp, closed string"
)
HOUR_MS = 3600 * 1000
#: What is kept of a test besides its steps. Places are microseconds and sequence numbers.
FACTS = {
    "attempt": "bigint", "start_at": "bigint", "start_seq": "bigint", "start_retry": "bigint",
    "done_at": "bigint", "done_seq": "bigint", "done_status": "string", "done_duration": "double",
    "error_at": "bigint", "error_seq": "bigint", "error_message": "string", "failed_at": "bigint", "failed_seq": "bigint", "failed_category": "string",
    "first_event": "bigint", "last_event": "bigint",
}
#: Facts of which the one with the latest place counts.
LATEST = {"start": ("start_retry",), "done": ("done_status", "done_duration"), "error": ("error_message",), "failed": ("failed_category",)}
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
_STEPS = pa.list_(pa.struct([("at", pa.int64()), ("seq", pa.int64())]))
_FACTS_DDL = ", ".join(f"{name} {kind}" for name, kind in FACTS.items())
_KEY_DDL = "run_id string, test_case string"


def _place(facts: dict, name: str) -> tuple[int, int] | None:
    return None if facts.get(f"{name}_at") is None else (facts[f"{name}_at"], facts[f"{name}_seq"])


def merged(one: dict, other: dict) -> dict:
    """Facts of two sets of events of one test, whichever came first."""
    out = dict(one)
    out["attempt"] = (one.get("attempt") or 0) + (other.get("attempt") or 0)
    for name, values in LATEST.items():
        mine, theirs = _place(one, name), _place(other, name)
        if theirs is not None and (mine is None or theirs > mine):
            out.update({field: other[field] for field in (f"{name}_at", f"{name}_seq", *values)})
    for name, pick in (("first_event", min), ("last_event", max)):
        known = [x[name] for x in (one, other) if x.get(name) is not None]
        out[name] = pick(known) if known else None
    return out


def steps_left(facts: dict, steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Steps after the latest start: earlier ones belong to an attempt that is over, whatever still arrives."""
    start = _place(facts, "start")
    return steps if start is None else [s for s in steps if s > start]


def _folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per test and Arrow batch: a test with very many events is small before it meets its state."""
    for batch in parts:
        tests: dict[tuple, tuple[dict, list]] = {}
        for row in batch.to_pylist():
            at, seq = row["at"], row["seq"]
            facts: dict = {"first_event": at, "last_event": at}
            if row["kind"] == "test_start":
                facts |= {"attempt": 1, "start_at": at, "start_seq": seq, "start_retry": row["retry"]}
            elif row["kind"] == "complete":
                facts |= {"done_at": at, "done_seq": seq, "done_status": row["status"], "done_duration": row["duration"]}
                if row["message"] is not None:
                    facts |= {"error_at": at, "error_seq": seq, "error_message": row["message"]}
                if row["category"] is not None:
                    facts |= {"failed_at": at, "failed_seq": seq, "failed_category": row["category"]}
            known, steps = tests.get((row["run_id"], row["test_case"]), ({}, []))
            if row["kind"] == "step":
                steps.append((at, seq))
            tests[row["run_id"], row["test_case"]] = merged(known, facts), steps
        columns = [pa.array([k[i] for k in tests], pa.string()) for i in (0, 1)]
        columns += [pa.array([facts.get(name) for facts, _ in tests.values()], _ARROW[kind]) for name, kind in FACTS.items()]
        columns.append(pa.array([[{"at": a, "seq": s} for a, s in steps_left(facts, steps)] for facts, steps in tests.values()], _STEPS))
        yield pa.RecordBatch.from_arrays(columns, [*TEST_KEY, *FACTS, "steps"])


def _plain(value):
    """A value of a pandas column as Python has it: whole numbers whole, missing ones none."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


class TestFold(StatefulProcessor):
    """The state of a test: its facts, and the places of the steps after its latest start. An idle test ends by its timer."""

    __test__ = False

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", f"{_FACTS_DDL}, timer bigint")
        self.steps = handle.getListState("steps", "at bigint, seq bigint")

    def _known(self) -> tuple[dict, int | None]:
        if not self.facts.exists():
            return {}, None
        *values, timer = self.facts.get()
        return dict(zip(FACTS, map(_plain, values))), _plain(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, timer = self._known()
        facts, new = before, []
        for frame in rows:
            for row in frame.to_dict("records"):
                own = {name: _plain(row[name]) for name in FACTS}
                facts = merged(facts, {n: int(v) if v is not None and FACTS[n] == "bigint" else v for n, v in own.items()})
                new += [(int(s["at"]), int(s["seq"])) for s in row["steps"]]
        left = steps_left(facts, new)
        if before and _place(before, "start") != _place(facts, "start") and self.steps.exists():
            left += steps_left(facts, [(int(a), int(s)) for a, s in self.steps.get()])
            self.steps.clear()
        if left:
            self.steps.appendList(left)
        due = facts["last_event"] // 1000 + self.idle_ms
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.facts.update((*(facts.get(name) for name in FACTS), due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts, _ = self._known()
        number = sum(1 for _ in self.steps.get()) if self.steps.exists() else 0
        self.facts.clear()
        self.steps.clear()
        columns = {name: pd.array([facts.get(name)], "Int64" if kind == "bigint" else "Float64" if kind == "double" else object) for name, kind in FACTS.items()}
        yield pd.DataFrame({"run_id": [key[0]], "test_case": [key[1]], **columns, "steps": [number]})

    def close(self) -> None:
        pass


def _judged(events: DataFrame) -> DataFrame:
    """Test events with cleaned messages and failure categories of completions."""
    kind = F.col("kind")
    done = kind == "complete"
    read = events.filter(kind.isin(*TEST_EVENTS)).withColumn("message", F.when(done, clean_message(F.col("error_message"))))
    read = read.withColumn("folded", F.when(done, rules.folded(F.col("message"))))
    category = F.when(done & rules.is_failing(F.col("status")), rules.failure_category(F.col("message"), F.col("folded")))
    return read.select(
        *TEST_KEY, "kind", F.unix_micros("event_time").alias("at"), "seq", "retry", F.when(done, rules.canonical_status(F.col("status"))).alias("status"),
        F.when(done, F.coalesce("duration", F.lit(0.0))).alias("duration"), "message", category.alias("category"))


def _state_rows(facts: DataFrame) -> DataFrame:
    """Facts with each fact of a place as one struct, as ``closed_records`` takes them."""
    def fact(name: str) -> Column:
        values = [F.col(v).alias(v.removeprefix(f"{name}_")) for v in LATEST[name]]
        place = F.struct(F.timestamp_micros(F.col(f"{name}_at")).alias("event_time"), F.col(f"{name}_seq").alias("seq"), *values)
        return F.when(F.col(f"{name}_at").isNotNull(), place).alias(name)

    return facts.select(*TEST_KEY, "attempt", *(fact(name) for name in LATEST), "steps", F.timestamp_micros("first_event").alias("first_event"))


def _in_last_attempt(name: str) -> Column:
    """An event's struct where it came after the latest start, else null."""
    start, place = F.col("start"), F.col(name)
    later = (place["event_time"] > start["event_time"]) | ((place["event_time"] == start["event_time"]) & (place["seq"] > start["seq"]))
    return F.when(start.isNull() | later, place)


def closed_records(state: DataFrame) -> DataFrame:
    """Records of tests that ended; one that is still running is a failure by timeout."""
    c = F.col
    rows = state.withColumn("own_done", _in_last_attempt("done")).withColumn("own_error", _in_last_attempt("error"))
    running = c("own_done").isNull()
    return rows.select(
        *TEST_KEY, "attempt", F.when(running, "FAILED").otherwise(c("own_done.status")).alias("status"),
        F.coalesce("own_done.duration", F.lit(0.0)).alias("duration"),
        F.when(running, F.coalesce("own_error.message", F.lit(UNFINISHED_MESSAGE))).otherwise(c("own_error.message")).alias("error_message"),
        F.when(running, "TIMEOUT_FAILURE").otherwise(c("failed.category")).alias("failure_category"), "steps",
        F.coalesce("start.retry", F.lit(0).cast("bigint")).alias("retry_count"), F.coalesce("start.event_time", "first_event").alias("execution_date"),
        F.when(running, "expired").otherwise("completed").alias("closed"),
    )


@contextmanager
def _kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Timers and lists need the state store that keeps more than one value for a key; the session is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def open_tests(spark: SparkSession, folder: str) -> DataFrame:
    """State rows of the tests that have not ended, read from the state store of ``stream_test_records``."""
    def variable(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/progress")

    facts = variable("facts").select("key.*", "value.*")
    steps = variable("steps").groupBy("key").agg(F.count("*").alias("steps")).select(
        F.col("key.run_id").alias("own_run"), F.col("key.test_case").alias("own_test"), "steps")
    same = F.col("run_id").eqNullSafe(F.col("own_run")) & F.col("test_case").eqNullSafe(F.col("own_test"))
    return _state_rows(facts.join(steps, same, "left").withColumn("steps", F.coalesce("steps", F.lit(0).cast("bigint"))))


def stream_test_records(events: DataFrame, folder: str, late_ms: int = HOUR_MS, idle_ms: int = 6 * HOUR_MS, finish: bool = True) -> DataFrame:
    """Process the available events; returns the records of the tests that ended.

    A test ends once it was idle for ``idle_ms`` of event time, judged ``late_ms`` behind the newest event; what arrives of it after that
    is a test of its own, as no event is dropped. With ``finish`` the run is over when no more events are available, and all tests end.
    The order in which events arrive does not matter otherwise. A micro-batch writes the state of the tests it has events of, and of no others.
    """
    spark = events.sparkSession
    with _kept_in_rocksdb(spark):
        partial = _judged(events).mapInArrow(_folded, f"{_KEY_DDL}, {_FACTS_DDL}, steps array<struct<at:bigint,seq:bigint>>")
        timed = partial.withColumn("event_time", F.timestamp_micros("last_event")).withWatermark("event_time", f"{late_ms} milliseconds")
        # Without its time a row is not taken for late, while timers still follow the newest event.
        ended = timed.drop("event_time").groupBy(*TEST_KEY).transformWithStateInPandas(
            statefulProcessor=TestFold(idle_ms), outputStructType=f"{_KEY_DDL}, {_FACTS_DDL}, steps bigint", outputMode="append", timeMode="EventTime")
        rows = run_to_table(closed_records(_state_rows(ended)), folder)
        # What is still open is read at once, as the next call goes on from this state.
        return rows.unionByName(closed_records(open_tests(spark, folder))) if finish else rows


def stream_coverage(events: DataFrame) -> DataFrame:
    """Running capture counts per run and action."""
    steps = events.filter(F.col("action").isNotNull())
    return steps.groupBy("run_id", "action").agg(F.count("*").alias("detected"), F.count_if(F.col("phase") == "captured").alias("captured"))


def stream_failure_counts(events: DataFrame) -> DataFrame:
    """Running failure counter per run and category over completions."""
    message = clean_message(F.col("error_message"))
    failing = events.filter((F.col("kind") == "complete") & rules.is_failing(F.col("status")))
    read = failing.select("run_id", message.alias("message")).withColumn("folded", rules.folded(F.col("message")))
    return read.groupBy("run_id", rules.failure_category(F.col("message"), F.col("folded")).alias("category")).agg(F.count("*").alias("failures"))


def stream_run_failures(events: DataFrame, folder: str, late_ms: int = HOUR_MS, idle_ms: int = 6 * HOUR_MS) -> DataFrame:
    """Failures per run and category: failing completions as they come, and the tests that ended without one, added when their time is up.

    Completions are counted by day of their event; a day's counts are released from the state once the newest event is ``late_ms``
    beyond it, so the state does not grow with the days. The days of a run are added up when the counts are read.
    """
    message = clean_message(F.col("error_message"))
    failing = events.withWatermark("event_time", f"{late_ms} milliseconds").filter((F.col("kind") == "complete") & rules.is_failing(F.col("status")))
    read = failing.select("run_id", "event_time", message.alias("message")).withColumn("folded", rules.folded(F.col("message")))
    category = rules.failure_category(F.col("message"), F.col("folded")).alias("category")
    daily = read.groupBy(F.window("event_time", "1 day").alias("day"), "run_id", category).agg(F.count("*").alias("failures"))
    flat = daily.select(F.col("day.start").alias("day"), "run_id", "category", "failures")
    counted = run_to_table(flat, f"{folder}/completions", "update", ("day", "run_id", "category"))
    ended = stream_test_records(events, f"{folder}/records", late_ms, idle_ms).filter("closed = 'expired'")
    expired = ended.groupBy("run_id").agg(F.count("*").alias("failures")).withColumn("category", F.lit("TIMEOUT_FAILURE"))
    both = counted.drop("day").unionByName(expired)
    return both.groupBy("run_id", "category").agg(F.sum("failures").alias("failures"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process everything available and return the result as a table in ``folder``.

    In update mode every micro-batch writes its changed rows and the newest row of each key counts.
    """
    spark: SparkSession = stream.sparkSession
    path, progress = f"{folder}/rows", f"{folder}/progress"

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{_ddl(stream)}, batch bigint").option("basePath", path).parquet(f"{path}/batch=*")
    if mode != "update":
        return rows.drop("batch")
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return newest.select(*keys, "row.*")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in frame.dtypes)
