import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.operators import lifecycle
from runlens.streaming import ingest
from runlens.streaming import lifecycle as stream

SCHEMA = (
    "run_id string, test_case string, event_time timestamp, seq bigint, kind string, retry bigint, status string, duration double, error_message string, "
    "action string, phase string, project string, browser string, reset boolean"
)


def event(seq, test, kind, minute, **values):
    names = ["retry", "status", "duration", "error_message", "action", "phase", "project", "browser", "reset"]
    return ("r", test, datetime(2024, 1, 1) + timedelta(minutes=minute), seq, kind, *[values.get(n) for n in names])


EVENTS = [
    event(1, "a", "test_start", 0, retry=0), event(2, "a", "step", 1, status="PASS", action="click", phase="captured"),
    event(3, "a", "complete", 2, status="FAIL", duration=5.0, error_message="Timeout"),
    event(4, "a", "test_start", 70, retry=1), event(5, "a", "step", 71, status="FAIL", action="fill", phase="detected"),
    event(6, "a", "step", 72, status="PASS", action="click", phase="captured"), event(7, "a", "complete", 73, status="PASS", duration=2.0),
    event(8, "b", "test_start", 5, retry=0), event(9, "b", "step", 6, status="PASS", action="click", phase="captured"),
    event(10, "c", "step", 8, status="PASS", action="tap", phase="captured"), event(11, "c", "complete", 9, status="timedOut", duration=1.0),
    event(12, "z", "test_start", 2000, retry=0),
]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA)


def test_records(events):
    rows = {r.test_case: r for r in lifecycle.test_records(lifecycle.fold_attempts(events)).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.status, a.duration, a.error_message, a.failure_category, a.attempts, a.retry_count, a.steps) == ("PASSED", 2.0, None, "TIMEOUT_FAILURE", 2, 1, 2)
    assert (b.status, b.error_message, b.failure_category, b.was_running) == ("FAILED", "Test did not complete before report generation.", "TIMEOUT_FAILURE", True)
    assert (c.status, c.failure_category, c.attempts, c.steps) == ("TIMEDOUT", "UNKNOWN_FAILURE", 0, 1)


def test_attempts_and_steps(events):
    rows = lifecycle.attempts(lifecycle.fold_attempts(events)).filter("test_case = 'a'").orderBy("attempt").collect()
    assert [(r.attempt_number, r.status, r.steps, r.error_message) for r in rows] == [(1, "FAILED", 1, "Timeout"), (2, "PASSED", 2, None)]
    (b,) = lifecycle.attempts(lifecycle.fold_attempts(events)).filter("test_case = 'b'").collect()
    assert (b.status, b.error_message, b.finished_at) == ("FAILED", "Test did not complete before report generation.", datetime(2024, 1, 1) + timedelta(minutes=2000))
    (b,) = lifecycle.attempts(lifecycle.fold_attempts(events), finished=False).filter("test_case = 'b'").collect()
    assert (b.status, b.error_message, b.finished_at) == ("RUNNING", None, None)
    steps = lifecycle.step_numbers(events).filter("test_case = 'a'").orderBy("seq").collect()
    assert [r.step_no for r in steps] == [1, 2, 3]


def test_counters(events):
    records = lifecycle.test_records(lifecycle.fold_attempts(events))
    counts = {r.category: r.failures for r in lifecycle.completion_categories(events, records).collect()}
    assert counts == {"TIMEOUT_FAILURE": 3, "UNKNOWN_FAILURE": 1}
    coverage = {r.action: (r.detected, r.captured, r.missed, r.capture_rate) for r in lifecycle.capture_coverage(events).collect()}
    assert coverage == {"click": (3, 3, 0, 100.0), "fill": (1, 0, 1, 0.0), "tap": (1, 1, 0, 100.0), None: (5, 4, 1, 80.0)}


def test_run_metadata_keeps_last_values(spark):
    rows = [event(1, None, "run_update", 0, project="P1", reset=False), event(2, None, "run_update", 5, browser="firefox", reset=True),
            event(3, None, "run_update", 9, project="P2", reset=False)]
    row = lifecycle.run_metadata(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.project, row.browser, row.execution_start, row.updates) == ("P2", "firefox", datetime(2024, 1, 1, 0, 5), 3)


def test_stream_over_several_batches_equals_the_batch_fold(spark, events, tmp_path):
    source = str(tmp_path / "in")
    for low, high in ((1, 3), (4, 9), (10, 12)):
        events.filter(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(source)
    frame = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {r.test_case: r for r in stream.stream_test_records(frame, str(tmp_path / "out")).collect()}
    expected = {r.test_case: r for r in lifecycle.test_records(lifecycle.fold_attempts(events)).collect()}
    assert set(got) == {"a", "b", "c", "z"}
    for name, row in got.items():
        want = expected[name]
        assert (row.status, row.duration, row.error_message, row.failure_category, row.attempt, row.steps, row.retry_count, row.execution_date) == (
            want.status, want.duration, want.error_message, want.failure_category, want.attempts, want.steps, want.retry_count, want.execution_date), name
        assert row.closed == ("expired" if name in "bz" else "completed")


FIELDS = ("status", "duration", "error_message", "failure_category", "steps", "retry_count", "execution_date")


def streamed(spark, batches, folder, **options):
    """Records of a stream that takes each list of events in a micro-batch of its own."""
    source = str(folder / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    rows = stream.stream_test_records(frame, str(folder / "out"), **options).collect()
    return {(r.test_case, r.execution_date) if options.get("finish") is False else r.test_case: (r.attempt, *(r[f] for f in FIELDS)) for r in rows}


def folded(spark, batches):
    rows = lifecycle.test_records(lifecycle.fold_attempts(spark.createDataFrame([r for b in batches for r in b], SCHEMA))).collect()
    return {r.test_case: (r.attempts, *(r[f] for f in FIELDS)) for r in rows}


LATE = {1: event(1, "a", "test_start", 0, retry=0), 2: event(2, "a", "step", 5, status="PASS"), 3: event(3, "a", "complete", 6, status="FAIL", duration=1.0, error_message="Timeout"),
        4: event(4, "a", "test_start", 10, retry=1), 5: event(5, "a", "step", 12, status="PASS"), 6: event(6, "a", "step", 12, status="FAIL"),
        7: event(7, "a", "complete", 20, status="PASS", duration=2.0)}


@pytest.mark.parametrize("order", [(1, 2, 3, 4, 5, 6, 7), (7, 6, 5, 4, 3, 2, 1), (5, 1, 7, 2, 6, 3, 4), (2, 5, 6, 1, 3, 7, 4)])
def test_stream_does_not_depend_on_the_order_of_batches(spark, tmp_path, order):
    batches = [[LATE[k]] for k in order]
    (record,) = streamed(spark, batches, tmp_path).values()
    assert record == folded(spark, batches)["a"] == (2, "PASSED", 2.0, None, "TIMEOUT_FAILURE", 2, 1, record[-1])


def test_random_streams_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(5)
    rows = [event(k, rng.choice(["a", "b", "c"]), rng.choice(["test_start", "step", "step", "complete", "run_update"]), rng.randint(0, 30), status=rng.choice(["PASS", "FAIL"]),
                  duration=float(k), retry=rng.randint(0, 2), error_message=rng.choice([None, "Timeout", "expect(x)"])) for k in range(60)]
    batches = [rows[k::4] for k in range(4)]
    assert streamed(spark, batches, tmp_path) == folded(spark, batches)


def test_idle_tests_end_by_their_timers(spark, tmp_path):
    batches = [[event(1, "a", "test_start", 0, retry=0), event(2, "a", "step", 1)], [event(3, "b", "test_start", 9 * 60, retry=0)], [event(4, "c", "test_start", 20 * 60, retry=0)]]
    ended = streamed(spark, batches, tmp_path, finish=False)
    assert {k[0]: v[:2] for k, v in ended.items()} == {"a": (1, "FAILED"), "b": (1, "FAILED")}
    left = {r.test_case: r.steps for r in stream.open_tests(spark, str(tmp_path / "out")).collect()}
    assert left == {"c": 0}


def test_stream_counts_update(spark, events, tmp_path):
    source = str(tmp_path / "in")
    for half in (F.col("seq") <= 5, F.col("seq") > 5):
        events.filter(half).coalesce(1).write.mode("append").parquet(source)
    frame = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = stream.run_to_table(stream.stream_coverage(frame), str(tmp_path / "out"), "update", ("run_id", "action")).collect()
    assert {r.action: (r.detected, r.captured) for r in rows} == {"click": (3, 3), "fill": (1, 0), "tap": (1, 1)}


def test_ingest_publishes_each_file_once(spark, tmp_path):
    source, ledger, store = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "store")
    schema = "name string, content string, modified_at timestamp"
    rows = [
        ("a.json", '[{"testCase":"a","status":"passed","duration":1.5},{"testCase":"b","status":"FAIL"}]', datetime(2024, 1, 1)),
        ("odd.json", '[{"testCase":"a","status":"dancing"}]', datetime(2024, 1, 2)),
    ]

    def take(progress):
        frame = spark.readStream.schema(schema).parquet(source)
        ingest.ingest_legacy(frame, ledger, str(tmp_path / progress), store)

    def outcomes():
        return sorted((r.name, r.outcome) for r in ingest.read_ledger(spark, ledger).collect())

    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        take("progress")
    assert outcomes()[0] == ("a.json", "migrated") and {o for n, o in outcomes() if n == "odd.json"} == {"failed"}
    (summary,) = spark.read.parquet(f"{store}/summaries").collect()
    assert (summary.total, summary.passed, summary.failed, summary.migration_source) == (2, 1, 1, "a.json")
    # The ledger write of the first batch is lost, and the batch is repeated.
    ledger = str(tmp_path / "ledger2")
    take("progress2")
    assert outcomes()[0] == ("a.json", "migrated") and spark.read.parquet(f"{store}/summaries").count() == 1


def test_a_hot_test_is_counted_in_many_slices(spark):
    rows = spark.sql("""SELECT 'r' AS run_id, IF(id < 400, 'hot', concat('t', id % 50)) AS test_case, timestamp_millis(1700000000000 + (id * 7919) % 3600000) AS event_time,
                        id AS seq FROM range(1200)""")
    sizes = [r["count"] for r in lifecycle.sliced_events(rows, lifecycle.TEST_KEY, 12).filter("test_case = 'hot'").groupBy("slice").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 200
    counted = lifecycle.running_count(rows, lifecycle.TEST_KEY, F.lit(True), "n", 12).filter("test_case = 'hot'").orderBy("event_time", "seq").collect()
    assert [r.n for r in counted] == list(range(1, 401))


def test_shuffled_events_come_in_five_batches_of_many_files(spark, tmp_path, monkeypatch):
    from runlens.plans import stream_queries

    monkeypatch.setattr(stream_queries, "_folder", lambda spark: str(tmp_path))
    stream_queries.stream_shuffled_records(spark, "/root/testdata/sf0.001")
    files = len(list((tmp_path / "events").glob("*.parquet")))
    assert files == 5 * spark.sparkContext.defaultParallelism
    sources = [p for p in (tmp_path / "progress" / "sources" / "0").iterdir() if p.name.isdigit()]
    assert len(sources) == 5
