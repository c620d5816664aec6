import hashlib
import json
import tarfile
import time
from datetime import datetime
from pathlib import Path
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.operators import history, metrics
from runlens.operators.metrics import RunQuery
from runlens.session import SHUFFLE_CLEANUP, written
from runlens.sources import folders, run_table, store, tables
from runlens.sources.folders import local_path


def summary(run_id, **changes):
    base = dict(
        runId=run_id, schemaVersion="1.0.0", createdAt="2024-01-01T10:00:00.000Z", timestamp="2024-01-01T10:00:00.000Z", startTime="2024-01-01T10:00:00.000Z",
        endTime="2024-01-01T10:00:05.000Z", total=2, passed=1, failed=1, skipped=0, timedOut=0, interrupted=0, unsuccessful=1, passRate=50, totalDuration=0.3,
        averageDuration=0.15, project="P", feature="F", environment="QA", browser="chromium", executedBy="me", failureCategoryCounts={"UNKNOWN_FAILURE": 1},
        traceReportedCount=0, tracePreservedCount=0, traceAvailableCount=0, reportAvailability=dict(pdf=True, dashboard=False, evidence=False, traces=False),
    )
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


def rid(n):
    return f"20240101-100000-000-{n:08x}"


def write(root, name, file, value):
    folder = root / name
    folder.mkdir(parents=True, exist_ok=True)
    (folder / file).write_text(value if isinstance(value, str) else json.dumps(value))


def texts(spark, *items):
    return spark.createDataFrame([(rid(i), json.dumps(s) if s is not None else None, None) for i, s in enumerate(items)],
                                 "run_dir string, content string, read_error string")


def test_five_directories_four_diagnostics(spark, tmp_path):
    root = tmp_path / "runs"
    write(root, rid(1), "summary.json", summary(rid(1)))
    (root / rid(2)).mkdir()
    write(root, rid(3), "summary.json", "{ broken")
    write(root, rid(4), "summary.json", summary(rid(4), schemaVersion="2.0.0"))
    write(root, rid(5), "summary.json", summary(rid(5), total=3))
    scanned = history.scan_history(store.read_summary_files(spark, str(root)))
    assert [r.code for r in scanned.orderBy("run_dir").collect()] == [None, "MISSING_SUMMARY", "CORRUPT_SUMMARY", "UNSUPPORTED_SCHEMA", "INVALID_SUMMARY"]
    counters = history.source_counters(store.read_summary_files(spark, str(root))).first().asDict()
    assert counters == dict(discovered=5, valid=1, excluded=4, aggregation_excluded=0, matched=1, selected=1)


def test_unreadable_summaries_are_rows(spark, tmp_path):
    root = tmp_path / "runs"
    write(root, rid(1), "summary.json", summary(rid(1)))
    # A file of that name among the artifacts is no summary, neither of a run with one nor of a run without.
    write(root, f"{rid(1)}/artifacts/x", "summary.json", summary(rid(7)))
    write(root, f"{rid(2)}/artifacts", "summary.json", summary(rid(2)))
    (root / rid(3) / "summary.json").mkdir(parents=True)
    (root / rid(4)).mkdir()
    (root / rid(4) / "summary.json").symlink_to("summary.json")
    (root / "a file").write_text("x")
    (root / "caf\u00e9 +%20").mkdir()
    files = store.read_summary_files(spark, f"file:{root}")
    scanned = {r.run_dir: (r.code, r.diagnostic and r.diagnostic.error_code) for r in history.scan_history(files).collect()}
    assert scanned == {rid(1): (None, None), rid(2): ("MISSING_SUMMARY", "ENOENT"), rid(3): ("UNREADABLE_RUN", "EISDIR"), rid(4): ("UNREADABLE_RUN", "UNKNOWN"),
                       "caf\u00e9 +%20": ("INVALID_SUMMARY", None)}


def test_folders_are_shared_out_whole(spark, tmp_path):
    root = tmp_path / "runs"
    for k in range(60):
        write(root, f"r{k}", "summary.json", {"k": k})
        write(root, f"r0/artifacts/{k % 7}", f"{k}.txt", "x" * k)
    for shares in (1, 3, 64):
        found = folders.read_documents(spark, str(root), "summary.json", shares)
        assert sorted((r.folder, r.content) for r in found.collect()) == sorted((f"r{k}", json.dumps({"k": k})) for k in range(60))
        sizes = {r.path: r.size for r in folders.read_files(spark, str(root), shares).where("folder = 'r0' AND path LIKE '%.txt'").collect()}
        assert sizes == {f"artifacts/{k % 7}/{k}.txt": k for k in range(60)}


def test_a_large_file_is_hashed_block_by_block(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    with open(tmp_path / "r1" / "large.bin", "wb") as file:
        file.truncate(3 << 30)
    digest = hashlib.sha256()
    for _ in range(3 << 6):
        digest.update(bytes(1 << 24))
    row = store.read_artifact_files(spark, str(tmp_path)).first()
    assert (row.path, row.size, row.sha256) == ("large.bin", 3 << 30, digest.hexdigest())


def test_files_are_written_inside_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json", "{}"), ("b/c/y.txt", "\u00e9")], "path string, content string")
    for _ in range(2):
        folders.write_files(rows, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/x.json", "b/c/y.txt"]
    assert (tmp_path / "b" / "c" / "y.txt").read_text() == "\u00e9"


def test_archives_count_as_the_files_they_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "ARCHIVED", 7)
    root = str(tmp_path / "runs")
    rows = [(f"r{k}/{name}", f"{k} \u00e9") for k in range(40) for name in (("summary.json", "a/b.txt") if k % 2 else ("a/b.txt",))]
    folders.write_archives(spark.createDataFrame(rows, "path string, content string").coalesce(2), root)
    write(tmp_path / "runs", "plain", "summary.json", {})
    assert len(list((tmp_path / "runs").iterdir())) < 15
    found = {r.folder: (r.content, r.read_error) for r in folders.read_documents(spark, root, "summary.json", 3).collect()}
    assert found == {f"r{k}": (f"{k} \u00e9", None) if k % 2 else (None, "ENOENT") for k in range(40)} | {"plain": ("{}", None)}
    files = {(r.folder, r.path): (r.size, r.sha256) for r in folders.read_files(spark, root, 3).collect() if r.folder != "plain"}
    assert files == {tuple(p.split("/", 1)): (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for p, t in rows}


def test_archives_hold_folders_and_links_to_themselves(spark, tmp_path):
    rows = [("a", None, "folder"), ("b/summary.json", None, "folder"), ("c/summary.json", None, "loop"), ("c/x/summary.json", "{}", None), ("d/summary.json", "[]", "file")]
    root = str(tmp_path)
    folders.write_archives(spark.createDataFrame(rows, "path string, content string, kind string").coalesce(1), root)
    assert [p.suffix for p in tmp_path.iterdir()] == [".zst"]
    found = {r.folder: (r.content, r.read_error) for r in folders.read_documents(spark, root, "summary.json", 2).collect()}
    assert found == {"a": (None, "ENOENT"), "b": (None, "EISDIR"), "c": (None, "ELOOP"), "d": ("[]", None)}
    files = {(r.folder, r.path, r.size, r.read_error) for r in folders.read_files(spark, root, 2).collect()}
    assert files == {("c", "summary.json", None, "ELOOP"), ("c", "x/summary.json", 2, None), ("d", "summary.json", 2, None)}


def test_summaries_of_a_query_lie_in_archives(spark, tmp_path):
    """Directories of all kinds of summaries are few files; one that comes twice is one."""
    from runlens.plans import file_queries

    days = [(k, k % 9, "O", f"199{k % 7}-03-1{k % 9} 00:00:00", "1-URGENT") for k in range(400)]
    orders = spark.createDataFrame(days + days[::3], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, day string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.col("day").cast("timestamp")).drop("day").write.parquet(str(tmp_path / "orders.parquet"))
    root = file_queries._stored_summaries(spark, str(tmp_path))
    assert len(list(Path(local_path(root)).rglob("*"))) < 40
    found = store.read_summary_files(spark, root).collect()
    assert len(found) == len({r.run_dir for r in found}) == 400
    files = tables.summary_files(spark, str(tmp_path)).collect()
    assert {(r.run_dir, r.content) for r in found} == {(r.run_dir, r.content) for r in files}
    problems = {"EACCES": "EISDIR", "ESTRANGE": "ELOOP", None: None}
    assert {(r.run_dir, r.read_error) for r in found} == {(r.run_dir, problems[r.read_error]) for r in files}
    nested = folders.read_files(spark, root).where("path = 'artifacts/dashboard/summary.json'")
    assert {r.folder for r in nested.collect()} == {r.run_dir for r in files if crc32(r.run_dir.encode()) % 3 == 0}


def test_archives_are_written_and_read_without_tarfile(tmp_path, monkeypatch):
    """Their headers are those of ``tarfile``, which takes many times as long; it reads what else a tar file may hold."""
    names = ["r1/summary.json", "r1/a.txt", "r2/" + "x" * 150 + "/a.txt", "r2/summary.json"]
    for name, some in (("own", names[:2]), ("other", names)):
        archive = folders._Archive(str(tmp_path / f"{name}{folders.ARCHIVE}"))
        for k, path in enumerate(some):
            archive.add(path, b"\xff" * 700 * k, folders.FILE)
        archive.close()
    with pa.CompressedInputStream(str(tmp_path / f"own{folders.ARCHIVE}"), "zstd") as plain, tarfile.open(fileobj=plain, mode="r|") as archive:
        assert [(m.name, m.size, m.mode, m.isreg()) for m in archive] == [(names[0], 0, 0o644, True), (names[1], 700, 0o644, True)]
    folder = folders.folder_of(str(tmp_path))
    assert [(m[0], m[5].read()) for m in folders._members(folder, f"other{folders.ARCHIVE}")] == [(n, b"\xff" * 700 * k) for k, n in enumerate(names)]
    monkeypatch.setattr(tarfile, "open", None)
    assert [(m[0], m[5].read()) for m in folders._members(folder, f"own{folders.ARCHIVE}")] == [(names[0], b""), (names[1], b"\xff" * 700)]


def test_runs_and_legacy_files_of_a_query_lie_in_archives(spark, tmp_path, monkeypatch):
    from runlens.plans import file_queries

    monkeypatch.setattr(file_queries, "_folder", lambda spark: str(tmp_path / "files"))
    records = file_queries.stored_records(spark, "/root/testdata/sf0.001")
    assert len(list((tmp_path / "files").rglob("*"))) < 100 < records.select("run_id").distinct().count()
    monkeypatch.setattr(file_queries, "_folder", lambda spark: str(tmp_path / "legacy"))
    names = file_queries.legacy_file_names(spark, "/root/testdata/sf0.001")
    assert len(list((tmp_path / "legacy").iterdir())) < 100 < names.count()


def test_legacy_files_of_a_local_folder_are_listed_in_tasks(spark, tmp_path):
    for name, text in (("a.json", b"\xff"), ("b c+%20.json", b"[]"), ("empty.json", b""), ("_x.json", b"[]"), (".y.json", b"[]"), ("z.txt", b"[]")):
        (tmp_path / name).write_bytes(text)
    read = store.read_legacy_files(spark, f"file:{tmp_path}")
    assert not read.inputFiles()
    hashes = {r.name: r.h for r in read.select("name", F.sha2("content", 256).alias("h")).collect()}
    assert hashes == {"a.json": hashlib.sha256(b"\xff").hexdigest(), "b c+%20.json": hashlib.sha256(b"[]").hexdigest()}


def test_a_batch_of_runs_has_one_file_a_month(spark, tmp_path):
    rows = spark.range(400).selectExpr("id", "concat('2024-0', 1 + id % 5) AS run_month").repartition(8)
    assert len(run_table.write_batch(rows, str(tmp_path), "b")) == 5
    assert len(list(tmp_path.rglob("*.parquet"))) == 5


def test_legacy_outcomes_deal_the_sources_once(spark):
    files = spark.createDataFrame([(f"{k}.json", "[]", datetime(2024, 1, 1)) for k in range(6)], "name string, content string, modified_at timestamp")
    sources = history.legacy_sources(files)
    state = history.legacy_sources(files.filter("name = '1.json'")).select("name", "content_hash")
    told = history.legacy_outcomes(sources, state, state.limit(0).selectExpr("name AS migration_identity", "name AS run_key"))
    assert sorted(r.name for r in told.collect()) == ["0.json", "2.json", "3.json", "4.json", "5.json"]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    anti = [line for line in plan.splitlines() if "Join LeftAnti" in line]
    assert anti and all("identity" in line and "content_hash" not in line for line in anti)


def test_checksums_are_joined_as_bytes(spark):
    good = "sha256:" + "ab" * 32
    entries = spark.createDataFrame([("r", "pdf", f"{k}", True, 1, v) for k, v in enumerate((good, good + "\n", "sha256:" + "AB" * 32, None, "sha256:" + "cd" * 32))],
                                    "run_key string, type string, path string, availability boolean, size bigint, checksum string")
    files = spark.createDataFrame([("r", f"{k}", False, 1, "ab" * 32) for k in range(5)], "run_key string, path string, is_directory boolean, size bigint, sha256 string")
    audit = history.audit_manifests(entries, files)
    assert {r.path: r.violation for r in audit.collect()} == {"1": "CHECKSUM_MISMATCH", "2": "CHECKSUM_FORMAT", "4": "CHECKSUM_MISMATCH"}
    assert "digest" in audit._jdf.queryExecution().optimizedPlan().toString()


def test_missing_root_is_an_empty_history(spark, tmp_path):
    assert store.list_run_directories(spark, str(tmp_path / "none")).count() == 0
    assert store.read_summary_files(spark, str(tmp_path / "none")).count() == 0
    assert store.read_legacy_files(spark, str(tmp_path / "none")).count() == 0
    files = texts(spark).limit(0)
    assert [r.code for r in history.history_warnings(files).collect()] == ["EMPTY_HISTORY"]


def test_storage_rules(spark):
    bad = {
        "COUNT_passed": dict(passed="1"), "COUNT_total": dict(total=2.5), "PASS_RATE": dict(passRate=101), "END_BEFORE_START": dict(endTime="2023-01-01T00:00:00.000Z"),
        "TIME_timestamp": dict(timestamp="2024-02-30T00:00:00.000Z"), "CATEGORY_COUNTS": dict(failureCategoryCounts={"a": "x"}), "TRACE_COUNTS": dict(tracePreservedCount=1),
        "MIGRATION": dict(migration={"identity": "no"}), "DURATION_totalDuration": dict(totalDuration=-1), "RUN_ID_DIFFERS": dict(runId="other"),
        "UNSUCCESSFUL_SUM": dict(unsuccessful=0), "SCHEMA_VERSION": dict(schemaVersion=1),
    }
    items = [summary(rid(i), **change) for i, change in enumerate(bad.values())]
    rows = history.scan_history(texts(spark, *items)).orderBy("run_dir").collect()
    for (rule, _), row in zip(bad.items(), rows):
        assert rule in row.violations and row.code == "INVALID_SUMMARY", rule
    fine = [summary(rid(0), total=2.0), summary(rid(1), failureCategoryCounts={"__proto__": 3}), summary(rid(2), project=...), summary(rid(3), traceReportedCount=2**53)]
    assert [r.code for r in history.scan_history(texts(spark, *fine)).collect()] == [None] * 4


def test_root_kinds(spark):
    frame = spark.createDataFrame([(rid(i), t, None) for i, t in enumerate(["[]", "5", '"x"', "null", "", "[" + json.dumps(summary(rid(5))) + "]"])],
                                  "run_dir string, content string, read_error string")
    codes = [r.code for r in history.scan_history(frame).orderBy("run_dir").collect()]
    assert codes == ["INVALID_SUMMARY"] * 4 + ["CORRUPT_SUMMARY", "INVALID_SUMMARY"]


def test_normalization(spark):
    items = [
        summary(rid(0)), summary(rid(1), totalDuration=0.1 + 0.2), summary(rid(2), totalDuration=0.0001), summary(rid(3), passRate=49),
        summary(rid(4), project=5, browser=" ", executedBy=None), summary(rid(5), traceReportedCount=2**53), summary(rid(6), reportAvailability={"pdf": "yes"}),
    ]
    rows = history.normalize_history(history.scan_history(texts(spark, *items))).orderBy("run_key").collect()
    assert [r.usable for r in rows] == [True, True, False, True, True, False, True]
    assert rows[1].total_duration == 0.3 and [i.code for i in rows[1].issues] == ["DURATION_NORMALIZED"]
    assert [(i.code, i.field) for i in rows[3].issues] == [("DERIVED_METRIC_MISMATCH", "passRate")]
    assert [(i.code, i.field) for i in rows[4].issues] == [("INVALID_METADATA", "project"), ("INVALID_METADATA", "browser"), ("MISSING_METADATA", "executedBy")]
    assert (rows[4].project, rows[4].browser, rows[6].has_pdf, len(rows[6].issues)) == (None, None, False, 4)


def test_warnings_collapse_metadata(spark):
    items = [summary(rid(0), project=...), summary(rid(1), project=...), summary(rid(2), total=9)]
    rows = {r.code: r for r in history.history_warnings(texts(spark, *items), RunQuery(limit=2)).collect()}
    assert set(rows) == {"INVALID_SUMMARY", "EXCLUDED_RUN", "PARTIAL_AGGREGATION", "MISSING_METADATA"}
    assert (rows["MISSING_METADATA"].detail, rows["EXCLUDED_RUN"].detail) == ("2", "1+0")


def test_append_is_idempotent_and_refuses_open_runs(spark, tmp_path):
    records = spark.createDataFrame([(1, 0, "PASS", 0.1, None, True), (1, 1, "timedOut", 0.2, None, None), (2, 0, "RUNNING", 1.0, None, None)],
                                    "run_id bigint, ordinal bigint, status string, duration double, stored_category string, trace_available boolean")
    runs = spark.sql("""SELECT id AS run_id, concat('20240101-000000-000-0000000', id) AS run_key, timestamp'2024-01-01' AS started_at, timestamp'2024-01-01' AS ended_at
                        FROM VALUES (1L), (2L), (3L) AS t(id)""")
    path = str(tmp_path / "table")
    store.append_runs(records, runs, path)
    store.append_runs(records, runs, path)
    rows = spark.read.parquet(path).orderBy("run_id").collect()
    assert [(r.run_id, r.total, r.pass_rate, r.total_duration) for r in rows] == [(1, 2, 50.0, 0.3), (3, 0, 0.0, 0.0)]
    assert rows[0].failure_category_counts == {"TIMEOUT_FAILURE": 1}


def test_retention(spark):
    runs = spark.sql("SELECT concat('k', id) AS run_key, timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id DIV 2 AS INT)) AS started_at FROM range(10)")
    def keys(**options):
        return sorted(r.run_key for r in history.retention_plan(runs, **options).collect())
    assert keys(max_runs=8) == ["k0", "k1"] and keys(max_runs=0) == [f"k{i}" for i in range(10)] and keys() == []
    assert keys(max_runs=9, max_age_days=3, as_of="2024-01-05T00:00:00Z") == ["k0", "k1"]
    with pytest.raises(TypeError):
        keys(max_runs=-1)


def test_legacy_files(spark, tmp_path):
    folder = tmp_path / "legacy"
    folder.mkdir()
    record = {"testCase": "a", "status": "passed", "duration": 0.1}
    (folder / "a.json").write_text(json.dumps([record, dict(record, duration=0.2)]))
    (folder / "b.json").write_text(json.dumps({"execution": [record], "metadata": {"executionStartTime": "2024-01-01T00:00:00Z"}}))
    (folder / "c.json").write_text("{ broken")
    (folder / "d e%20f+g.json").write_text("[]")
    assert {r.name for r in store.read_legacy_files(spark, str(folder)).collect()} == {"a.json", "b.json", "c.json", "d e%20f+g.json"}
    (folder / "d e%20f+g.json").unlink()
    sources = history.legacy_sources(store.read_legacy_files(spark, str(folder)))
    state = spark.createDataFrame([], "name string, content_hash string")
    content = hashlib.sha256((folder / "b.json").read_bytes()).hexdigest()
    identity = "sha256:" + hashlib.sha256(f"b.json\0{content}".encode()).hexdigest()
    stored = spark.createDataFrame([(identity, "kept")], "migration_identity string, run_key string")
    rows = {r.name: r for r in history.legacy_outcomes(sources, state, stored).collect()}
    assert {n: r.outcome for n, r in rows.items()} == {"a.json": "migrated", "b.json": "reconciled", "c.json": "failed"}
    assert rows["b.json"].run_key == "kept" and rows["c.json"].error == "corrupt"
    outcomes = history.legacy_outcomes(sources, state, stored.limit(0)).filter("name = 'a.json'")
    assert history.legacy_durations(outcomes).first().total_duration == 0.1 + 0.2
    assert history.legacy_executions(outcomes).count() == 2


def test_manifest_of_real_files(spark, tmp_path):
    root = tmp_path / "runs"
    write(root, "r1", "artifacts/x", "") if False else (root / "r1" / "artifacts" / "dashboard").mkdir(parents=True)
    (root / "r1" / "artifacts" / "dashboard" / "a.html").write_text("abc")
    (root / "r1" / "artifacts" / "dashboard" / "b.html").write_text("hello")
    files = store.read_artifact_files(spark, str(root))
    sizes = {r.directory: (r.size, r.files) for r in history.directory_sizes(files).collect()}
    assert sizes == {"artifacts": (8, 2), "artifacts/dashboard": (8, 2)}
    listing = files.select("run_key", "path", F.lit(False).alias("is_directory"), "size", "sha256").unionByName(
        history.directory_sizes(files).select("run_key", F.col("directory").alias("path"), F.lit(True).alias("is_directory"), "size", F.lit(None).cast("string").alias("sha256"))
    )
    good = "sha256:" + hashlib.sha256(b"abc").hexdigest()
    entries = spark.createDataFrame([
        ("r1", "dashboard", "artifacts/dashboard", True, 8, None), ("r1", "pdf", "artifacts/dashboard/a.html", True, 3, good),
        ("r1", "pdf", "../r1/artifacts/dashboard/a.html", True, 3, good), ("r1", "pdf", "artifacts/dashboard/b.html", True, 3, None),
        ("r1", "pdf", "artifacts/dashboard/b.html", True, 5, good), ("r1", "evidence", "artifacts/dashboard", True, 8, good),
        ("r1", "trace", "gone.zip", True, 1, None), ("r1", "trace", "off.zip", False, 1, None), ("r1", "pdf", "/etc/x", True, 1, None),
    ], "run_key string, type string, path string, availability boolean, size bigint, checksum string")
    got = sorted((r.path, r.violation) for r in history.audit_manifests(entries, listing).collect())
    assert got == [
        ("../r1/artifacts/dashboard/a.html", "PATH_ESCAPES"), ("/etc/x", "PATH_ESCAPES"), ("artifacts/dashboard", "DIRECTORY_CHECKSUM"),
        ("artifacts/dashboard/b.html", "CHECKSUM_MISMATCH"), ("artifacts/dashboard/b.html", "SIZE_MISMATCH"), ("gone.zip", "MISSING_FILE"),
    ]


def test_file_readers(spark, tmp_path):
    root = tmp_path / "runs"
    write(root, "r1", "execution.json", [{"testCase": "a", "status": "PASS", "duration": 1, "steps": [{"name": "s", "status": "PASS"}]}, {"testCase": "b", "status": "FAIL"}])
    write(root, "r1", "metadata.json", {"project": "Shop", "browser": ""})
    write(root, "TC1", "api-log.json", [{"method": "GET", "status": 200, "duration": 5, "url": "https://x.y/api/z"}, {"url": "https://x.y/a.css"}])
    records = store.read_executions(spark, str(root))
    assert [(r.run_id, r.ordinal, r.test_case) for r in records.orderBy("ordinal").collect()] == [("r1", 0, "a"), ("r1", 1, "b")]
    assert [(r.step_no, r.name) for r in store.read_steps(records).collect()] == [(1, "s")]
    shot = {"testCase": "c", "status": "FAIL", "failureScreenshot": "c.png", "executionDate": "2024-01-01T00:00:00Z", "traceModified": "2024-01-01T00:00:09Z",
            "attempts": [{"attemptNumber": 1, "retry": 0, "status": "FAIL", "startedAt": "2024-01-01T00:00:01Z", "steps": [{"name": "s"}]}, {"retry": 1, "status": "PASS"}]}
    write(root, "r3", "execution.json", [shot])
    again = store.read_executions(spark, str(root)).where("run_id = 'r3'")
    row = again.first()
    assert (row.failure_screenshot, row.execution_date, row.trace_modified) == ("c.png", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 9))
    got = [(r.attempt_number, r.retry, r.status, r.steps, r.started_at) for r in store.read_attempts(again).orderBy("attempt_number").collect()]
    assert got == [(1, 0, "FAIL", 1, datetime(2024, 1, 1, 0, 0, 1)), (2, 1, "PASS", 0, None)]
    meta = store.read_metadata(spark, str(root)).first()
    assert (meta.project, meta.browser, meta.environment, meta.executed_by) == ("Shop", "chromium", "QA", "Automation Framework")
    both = store.read_metadata(spark, str(root), spark.createDataFrame([("r1",), ("r9",)], "run_id string"))
    assert {r.run_id: (r.project == "Shop", r.browser, r.run_status) for r in both.collect()} == {"r1": (True, "chromium", None), "r9": (False, "chromium", None)}
    calls = store.read_api_logs(spark, str(root))
    assert calls.count() == 2
    store.save_api_logs(calls, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    write(root, "r2", "execution.json", "[{ broken")
    with pytest.raises(Exception):
        store.read_executions(spark, str(root)).collect()


def test_unreadable_and_missing_manifests_are_reported(spark, tmp_path):
    root = tmp_path / "runs"
    write(root, "r1", "manifest.json", {"artifacts": []})
    write(root, "r2", "manifest.json", "{ broken")
    write(root, "r3", "summary.json", {})
    (root / "r1" / "artifacts" / "runs").mkdir(parents=True)
    (root / "r1" / "artifacts" / "runs" / "x.png").write_text("abc")
    files = store.read_artifact_files(spark, str(root))
    assert ("r1", "artifacts/runs/x.png", 3) in [(r.run_key, r.path, r.size) for r in files.collect()]
    listing = files.select("run_key", "path", F.lit(False).alias("is_directory"), "size", "sha256")
    got = history.audit_manifests(store.read_manifests(spark, str(root)), listing).collect()
    assert sorted((r.run_key, r.violation) for r in got) == [("r2", "CORRUPT_MANIFEST"), ("r3", "MISSING_MANIFEST")]


def test_absent_files_are_empty_tables(spark, tmp_path):
    for root in (str(tmp_path / "none"), str(tmp_path)):
        for reader in (store.read_executions, store.read_metadata, store.read_api_logs, store.read_artifact_files, store.read_manifests):
            assert reader(spark, root).count() == 0


def test_append_tells_what_becomes_of_each_run(spark, tmp_path):
    start = "timestamp'2024-05-06 10:00:00'"
    keys = {1: "20240506-100000-000-00000001", 2: "20240506-100000-000-00000001", 3: "20240506-100000-000-00000003", 4: "bad key", 5: "20240506-100000-000-00000005"}
    runs = spark.createDataFrame(list(keys.items()), "run_id int, run_key string").selectExpr(
        "run_id", "run_key", f"{start} AS started_at", f"{start} + make_dt_interval(0, 0, IF(run_id = 5, -1, 1)) AS ended_at")
    records = spark.createDataFrame(
        [(i, 0, "t", "running" if i == 3 else "passed", 1.0, None, True) for i in keys],
        "run_id int, ordinal bigint, test_case string, status string, duration double, stored_category string, trace_available boolean")
    path = str(tmp_path / "table")
    expected = {1: "published", 2: "duplicate", 3: "unfinished", 4: "invalid", 5: "invalid"}
    assert {r.run_id: r.outcome for r in store.append_runs(records, runs, path).collect()} == expected
    assert {r.run_id: r.outcome for r in store.append_runs(records, runs, path).collect()} == {**expected, 1: "duplicate"}
    assert spark.read.parquet(path).count() == 1


def test_time_filters_and_keys_prune_the_summary_table(spark, tmp_path):
    path, month = str(tmp_path / "table"), "2024-0{}-05T00:00:00Z"
    rows = spark.sql("SELECT concat('20240', m, '05-000000-000-00000001') AS run_key, make_timestamp(2024, m, 5, 0, 0, 0) AS started_at, false AS migrated, '1.0.0' AS schema_version, "
                     "concat('2024-0', m) AS run_month FROM VALUES (1), (2), (3), (4), (5), (6) AS t(m)")
    rows.write.partitionBy("run_month").parquet(path)
    table = store.read_summaries(spark, path, rows.schema)
    plans = {
        ("20240205-000000-000-00000001",): history.get_run(table, "20240205-000000-000-00000001"),
        ("20240305-000000-000-00000001", "20240405-000000-000-00000001"): metrics.matched_runs(table, RunQuery(start=month.format(3), end=month.format(4))),
    }
    for expected, frame in plans.items():
        assert tuple(sorted(r.run_key for r in frame.collect())) == expected
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(run_month" in plan or "PartitionFilters: [run_month" in plan


def test_numbers_json_cannot_carry(spark):
    assert store.as_json(spark.sql("SELECT 1L AS a, 0.5D AS b")).first().json == '{"a":1,"b":0.5}'
    with pytest.raises(Exception, match="Numeric range"):
        store.as_json(spark.sql("SELECT 9007199254740993L AS a")).collect()


def test_shuffles_of_a_written_table_are_removed(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {str(b) for b in (manager.getAllBlocks().apply(k) for k in range(manager.getAllBlocks().size())) if str(b).startswith("shuffle_")}

    before = shuffled()
    table = written(spark.range(1000).repartition(5, "id"))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and table.count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_intermediate_tables_can_be_removed(spark):
    from runlens.session import drop_written, written
    drop_written(spark)
    table = written(spark.range(3))
    (file,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    assert table.count() == 3 and drop_written(spark) == 1 and drop_written(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(file).count()


RUN_KEY = "20240506-100000-000-{:08x}"


def run_rows(spark, *numbers, start="2024-05-06 10:00:00"):
    values = ", ".join(f"({n}, '{RUN_KEY.format(n)}')" for n in numbers)
    runs = spark.sql(f"SELECT id AS run_id, run_key, timestamp'{start}' AS started_at, timestamp'{start}' + interval 5 seconds AS ended_at, false AS migrated FROM VALUES {values} AS t(id, run_key)")
    return runs.withColumn("run_id", F.col("run_id").cast("string"))


def record_rows(spark, *numbers):
    return spark.createDataFrame([(str(n), 0, "t", "PASS", 1.0, None, None) for n in numbers],
                                 "run_id string, ordinal bigint, test_case string, status string, duration double, stored_category string, trace_available boolean")


def test_interleaved_appends_store_a_key_once(spark, tmp_path, monkeypatch):
    path, commit, calls = str(tmp_path / "table"), run_table.commit, []

    def interrupted(*args):
        if not calls:
            calls.append(1)
            # Another writer publishes one of the keys between the look-up and the snapshot.
            other = store.append_runs(record_rows(spark, 2, 3), run_rows(spark, 2, 3), path)
            assert {r.run_id: r.outcome for r in other.collect()} == {"2": "published", "3": "published"}
        return commit(*args)

    monkeypatch.setattr(run_table, "commit", interrupted)
    mine = store.append_runs(record_rows(spark, 1, 2), run_rows(spark, 1, 2), path)
    assert {r.run_id: r.outcome for r in mine.collect()} == {"1": "published", "2": "duplicate"}
    table = store.read_summaries(spark, path, store.summary_rows(record_rows(spark, 1), run_rows(spark, 1)).schema)
    assert sorted(r.run_key for r in table.collect()) == [RUN_KEY.format(n) for n in (1, 2, 3)]
    assert run_table.snapshot(spark, path)[0] == 2
    # What the first try wrote is gone.
    assert spark.read.parquet(path).count() == 3


def test_a_corrected_start_is_no_second_run(spark, tmp_path):
    path = str(tmp_path / "table")
    store.append_runs(record_rows(spark, 1), run_rows(spark, 1), path)
    moved = store.append_runs(record_rows(spark, 1), run_rows(spark, 1, start="2024-06-02 10:00:00"), path)
    assert [r.outcome for r in moved.collect()] == ["duplicate"]
    far = store.append_runs(record_rows(spark, 4), run_rows(spark, 4, start="2024-07-02 10:00:00"), path)
    assert [(r.outcome, r.detail) for r in far.collect()] == [("invalid", "RUN_ID_MONTH")]


def test_retention_rewrites_months_with_dropped_runs_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    for n, month in ((1, 5), (2, 5), (3, 6)):
        key = f"2024{month:02}06-100000-000-{n:08x}"
        runs = run_rows(spark, n, start=f"2024-{month:02}-0{n} 10:00:00").withColumn("run_key", F.lit(key))
        store.append_runs(record_rows(spark, n), runs, path)
    schema = store.summary_rows(record_rows(spark, 1), run_rows(spark, 1)).schema
    before, commit = run_table.snapshot(spark, path), run_table.commit

    def keys():
        return sorted(int(r.run_key[-8:], 16) for r in store.read_summaries(spark, path, schema).collect())

    def lost(*args):
        raise OSError("the writer is gone")

    monkeypatch.setattr(run_table, "commit", lost)
    with pytest.raises(OSError):
        store.retain_runs(spark, path, schema, max_runs=2)
    assert keys() == [1, 2, 3] and run_table.snapshot(spark, path) == before
    monkeypatch.setattr(run_table, "commit", commit)
    fates = {int(r.run_key[-8:], 16): r.outcome for r in store.retain_runs(spark, path, schema, max_runs=2).collect()}
    assert fates == {1: "deleted", 2: "kept", 3: "kept"} and keys() == [2, 3]
    untouched = [f for f in before[1] if f.endswith("06")]
    assert set(untouched) <= set(run_table.snapshot(spark, path)[1])


def test_fates_need_one_diagnosis(spark, monkeypatch):
    """The passes that find the newest runs read what was judged, and do not judge again."""
    seen = []
    plan = history.retention_plan
    monkeypatch.setattr(history, "retention_plan", lambda runs, *rest: seen.append(runs._jdf.queryExecution().optimizedPlan().toString()) or plan(runs, *rest))
    files = spark.createDataFrame([(rid(k), json.dumps(summary(rid(k))), None) for k in (1, 2, 3)] + [(rid(4), "[]", None)], "run_dir string, content string, read_error string")
    fates = {(r.run_dir, r.outcome, r.code) for r in history.retention_fates(history.scan_history(files), max_runs=3).collect()}
    assert fates == {(rid(k), "kept", None) for k in (1, 2, 3)} | {(rid(4), "skipped", "INVALID_SUMMARY")}
    assert len(seen) == 1 and "RLIKE" not in seen[0].upper()


@pytest.mark.parametrize("kept", [0, 1, 7, 40, 99, 100, 500])
def test_retention_rank_by_counting(spark, kept):
    rows = spark.sql("SELECT timestamp_millis(1700000000000 + (id * id * 7919) % 400000000 div 3000 * 1000) AS started_at, concat('k', lpad(id, 4, '0')) AS run_key FROM range(100)")
    order = sorted(((r.started_at, r.run_key) for r in rows.collect()), reverse=True)
    assert sorted(r.run_key for r in history.retention_plan(rows, max_runs=kept).collect()) == sorted(k for _, k in order[kept:])


def test_all_parts_of_a_run_lie_in_one_bucket(spark, tmp_path):
    path = str(tmp_path / "parts")
    runs = run_rows(spark, *range(1, 200))
    store.write_run_parts({"summary": runs, "metadata": runs.select("run_key", "started_at")}, path)
    parts = store.get_run_parts(spark, path, RUN_KEY.format(77))
    assert sorted(parts) == ["metadata", "summary"]
    for frame in parts.values():
        assert [r.run_key for r in frame.collect()] == [RUN_KEY.format(77)]
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert [f.count() for f in store.get_run_parts(spark, path, "none").values()] == [0, 0]


def test_codes_are_found_without_lists_of_rules(spark):
    """A list for each summary, of which only the size counts, took most of the time of the codes."""
    scanned = history.scan_history(texts(spark, summary(rid(0)), summary(rid(1), passed=2, unsuccessful=2)))
    assert [(r.code, r.violations) for r in scanned.orderBy("run_dir").collect()] == [
        (None, []), ("INVALID_SUMMARY", ["STATUS_SUM", "UNSUCCESSFUL_SUM"])]
    plan = scanned.filter("code IS NOT NULL").groupBy("code").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "INVALID_SUMMARY" in plan and "UNSUCCESSFUL_SUM" not in plan
