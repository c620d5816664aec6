"""Readers and writers of the file layout: execution, metadata, history, API-log and artifact files.

History layout: ``<root>/<run id>/{summary,execution,metadata,manifest}.json`` with artifacts below each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.fixed_values import HISTORY_SCHEMA_VERSION, METADATA_DEFAULTS
from runlens.functions.text import none_if_empty
from runlens.functions.times import is_run_id, parse_timestamp
from runlens.operators.history import retention_plan
from runlens.operators.metrics import contract_violations
from runlens.operators.reports import api_log
from runlens.operators.summaries import category_maps, failure_category_counts, run_summaries, unfinished_runs
from runlens.session import written
from runlens.sources import run_table
from runlens.sources.folders import is_local, read_documents, read_files, read_plain

STEP_SCHEMA = "name string, action string, target string, status string, duration double, timestamp string, mode string, screenshot string, errorMessage string"
STEPS = f"array<struct<{STEP_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
ATTEMPT_SCHEMA = (
    "attemptNumber bigint, retry bigint, repeatEachIndex bigint, status string, duration double, "
    f"steps {STEPS}, startedAt string, finishedAt string, errorMessage string"
)
EXECUTION_SCHEMA = (
    "testCase string, status string, duration double, feature string, failureCategory string, errorMessage string, failureScreenshot string, "
    "traceAvailable boolean, traceFile string, traceSize bigint, traceModified string, retryCount bigint, currentAttempt bigint, executionDate string, "
    f"steps {STEPS}, attempts array<struct<{ATTEMPT_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
)
API_SCHEMA = "method string, status bigint, duration bigint, url string"
METADATA_SCHEMA = (
    "project string, feature string, environment string, browser string, automationTool string, executedBy string, "
    "executionStartTime string, executionEndTime string, runStatus string, "
    "autoCaptureCoverage struct<detected:bigint,captured:bigint,missed:bigint,byAction:map<string,struct<detected:bigint,captured:bigint>>>, "
    "failureCategories map<string,bigint>"
)


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``folder`` and ``value`` of ``<root>/<folder>/<name>``; no root or no such file is an empty table, an unreadable file an error."""
    found = read_documents(spark, root, name).where("read_error IS NULL OR read_error != 'ENOENT'")
    failed = F.raise_error(F.concat(F.lit("cannot read "), "folder", F.lit(f"/{name}: "), "read_error")).cast("string")
    return found.select("folder", F.when(F.col("read_error").isNotNull(), failed).otherwise(F.col("content")).alias("value"))


def _parse_or_fail(column: Column, schema: str) -> Column:
    return F.from_json(column, schema, {"mode": "FAILFAST"})


def read_executions(spark: SparkSession, root: str) -> DataFrame:
    """Test records of all runs with their array position; a corrupt file fails the query."""
    texts = _texts(spark, root, "execution.json").withColumnRenamed("folder", "run_id")
    records = texts.select("run_id", F.posexplode(_parse_or_fail(F.col("value"), f"array<struct<{_struct(EXECUTION_SCHEMA)}>>")).alias("ordinal", "r"))
    return records.select(
        "run_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("r.testCase").alias("test_case"), "r.status", "r.duration", "r.feature",
        F.col("r.errorMessage").alias("error_message"), F.col("r.failureCategory").alias("stored_category"), F.col("r.retryCount").alias("retry_count"),
        F.col("r.traceAvailable").alias("trace_available"), F.col("r.traceFile").alias("trace_file"), F.col("r.traceSize").alias("trace_size"),
        parse_timestamp(F.col("r.traceModified")).alias("trace_modified"), F.col("r.failureScreenshot").alias("failure_screenshot"),
        parse_timestamp(F.col("r.executionDate")).alias("execution_date"), F.col("r.currentAttempt").alias("current_attempt"), "r.steps", "r.attempts",
    )


def _struct(columns: str) -> str:
    """Column list as the inside of a struct type."""
    out, depth = [], 0
    for part in columns.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            out.append(f"{name}:{kind}")
        else:
            out[-1] += f",{part}"
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def read_attempts(executions: DataFrame) -> DataFrame:
    """Attempts of the records in their order; a record without attempts has none."""
    return executions.select("run_id", "ordinal", "test_case", F.posexplode("attempts").alias("place", "a")).select(
        "run_id", "ordinal", "test_case", F.coalesce("a.attemptNumber", (F.col("place") + 1).cast("bigint")).alias("attempt_number"),
        F.col("a.retry").alias("retry"), F.col("a.repeatEachIndex").alias("repeat_index"), "a.status", "a.duration",
        F.coalesce(F.size("a.steps"), F.lit(0)).cast("bigint").alias("steps"),
        parse_timestamp(F.col("a.startedAt")).alias("started_at"), parse_timestamp(F.col("a.finishedAt")).alias("finished_at"), F.col("a.errorMessage").alias("error_message"),
    )


def read_steps(executions: DataFrame) -> DataFrame:
    """Steps of the records, numbered within each record."""
    return executions.select("run_id", "ordinal", "test_case", F.posexplode("steps").alias("step_no", "s")).select(
        "run_id", "ordinal", "test_case", (F.col("step_no") + 1).cast("bigint").alias("step_no"), "s.name", "s.action", "s.target", "s.status",
        F.col("s.errorMessage").alias("error_message"), "s.screenshot",
    )


def read_metadata(spark: SparkSession, root: str, runs: DataFrame | None = None) -> DataFrame:
    """Metadata of all runs; a missing or empty field gets its default.

    With ``runs`` (run_id) each of them has a row, whether it has a file or not.
    """
    texts = _texts(spark, root, "metadata.json").withColumnRenamed("folder", "run_id")
    if runs is not None:
        texts = runs.select("run_id").distinct().join(texts, "run_id", "left")
    parsed = texts.select("run_id", _parse_or_fail(F.col("value"), METADATA_SCHEMA).alias("m"))
    fields = {"project": "project", "feature": "feature", "environment": "environment", "browser": "browser",
              "automation_tool": "automationTool", "executed_by": "executedBy"}
    return parsed.select(
        "run_id",
        *[F.coalesce(none_if_empty(F.col(f"m.{fields[name]}")), F.lit(default)).alias(name) for name, default in METADATA_DEFAULTS],
        F.col("m.executionStartTime").alias("execution_start"), F.col("m.executionEndTime").alias("execution_end"),
        F.col("m.runStatus").alias("run_status"), F.col("m.autoCaptureCoverage").alias("coverage"), F.col("m.failureCategories").alias("failure_categories"),
    )


def list_run_directories(spark: SparkSession, root: str) -> DataFrame:
    """Names of the run directories, listed in tasks; a missing root is an empty history, any other failure is an error."""
    return read_documents(spark, root, "summary.json").select(F.col("folder").alias("run_dir"))


def read_summary_files(spark: SparkSession, root: str) -> DataFrame:
    """Every run directory with its summary text, or with the code of what kept it from being read: the input of ``scan_history``.

    A file of that name further below is an artifact and no summary.
    """
    found = read_documents(spark, root, "summary.json").withColumnRenamed("folder", "run_dir")
    return found.withColumn("read_error", F.expr("nullif(read_error, 'ENOENT')"))


def read_api_logs(spark: SparkSession, root: str) -> DataFrame:
    """API logs stored per test below ``<root>/<test>/api-log.json``, with their position."""
    texts = _texts(spark, root, "api-log.json").withColumnRenamed("folder", "test_case")
    calls = texts.select("test_case", F.posexplode(_parse_or_fail(F.col("value"), f"array<struct<{_struct(API_SCHEMA)}>>")).alias("seq", "c"))
    return calls.select("test_case", F.col("seq").cast("bigint").alias("seq"), "c.*")


def read_artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below each run directory: run_key, path, size, sha256, modified_at; hashed block by block, whatever their size.

    A file that cannot be read has neither size nor hash.
    """
    return read_files(spark, root).select(F.col("folder").alias("run_key"), "path", "size", "sha256", "modified_at")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifest entries of all runs; a manifest that cannot be read gives one row without an entry, marked ``CORRUPT_MANIFEST``.

    A run directory without a manifest gives one row marked ``MISSING_MANIFEST``.
    """
    entry = "struct<type:string,path:string,availability:boolean,size:bigint,checksum:string>"
    found = read_documents(spark, root, "manifest.json").withColumnRenamed("folder", "run_key")
    read = found.withColumn("entries", F.from_json("content", f"artifacts array<{entry}>")["artifacts"])
    none = F.array(F.lit(None).cast(entry))
    problem = F.when(F.col("read_error") == "ENOENT", "MISSING_MANIFEST").when(F.col("entries").isNull(), "CORRUPT_MANIFEST")
    rows = read.select("run_key", F.explode(F.coalesce("entries", none)).alias("entry"), problem.alias("manifest_error"))
    return rows.select("run_key", "entry.*", "manifest_error")


def read_legacy_files(spark: SparkSession, folder: str) -> DataFrame:
    """Legacy execution files with content and modification time, under the names they have in the folder; no folder is an empty table.

    A local folder is listed in tasks, as it may hold millions of files, and may hold archives of them.
    """
    if is_local(folder):
        return read_plain(spark, folder, ".json").select("name", F.col("content").cast("string").alias("content"), "modified_at")
    if _is_empty_store(spark, folder):
        return spark.createDataFrame([], "name string, content string, modified_at timestamp")
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    # The path is a URI: what a name may not hold there is spelled in percent, while a plus sign is itself.
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return texts.select(
        F.substring_index(place, "/", -1).alias("name"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def _is_empty_store(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_summaries(spark: SparkSession, path: str, schema) -> DataFrame:
    """The run-summary table, partitioned by start month so that time filters prune it: what its newest snapshot names.

    Of a table without snapshots all months are read.
    """
    return run_table.read(spark, path, schema)



def summary_rows(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """What the summary table holds of each run."""
    maps = category_maps(failure_category_counts(executions))
    return (
        run_summaries(executions, runs)
        .join(maps, "run_id", "left")
        .withColumn("schema_version", F.lit(HISTORY_SCHEMA_VERSION))
        .withColumn("run_month", F.date_format("started_at", "yyyy-MM"))
    )


def _key_months(rows: DataFrame) -> DataFrame:
    """The months in which runs with these keys may have started: that of the date in the key, the one before and the one after."""
    dated = rows.filter(is_run_id(F.col("run_key"))).select(F.try_to_timestamp(F.concat(F.substring("run_key", 1, 6), F.lit("01")), F.lit("yyyyMMdd")).alias("month"))
    near = F.array(*(F.date_format(F.add_months("month", k), "yyyy-MM") for k in (-1, 0, 1)))
    return dated.select(F.explode(near).alias("run_month")).distinct()


def append_outcomes(executions: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """What becomes of each run that is to be appended: run_id, run_key, outcome, detail.

    ``unfinished``: a record is still running or of unknown status. ``invalid``: no proper key, a key whose date is more than a month
    from the start, an end before the start, or counts that contradict each other. ``duplicate``: the table, or a run with a smaller id
    of the same call, has the key, whatever its start was then. Only months that may hold the keys are looked up.
    """
    rows = summary_rows(executions, runs)
    return _outcomes(rows, unfinished_runs(executions), read_summaries(executions.sparkSession, path, rows.schema))


def _outcomes(rows: DataFrame, unfinished: DataFrame, table: DataFrame) -> DataFrame:
    c = F.col
    stored = table.join(_key_months(rows), "run_month", "left_semi").select("run_key").distinct().withColumn("is_stored", F.lit(True))
    bad = contract_violations(rows.withColumn("pass_rate", F.when(c("total") > 0, c("pass_rate")))).select("run_id", F.array_join("rules", ",").alias("broken"))
    unfinished = unfinished.select("run_id", c("first_status"))
    key_month = F.try_to_timestamp(F.concat(F.substring("run_key", 1, 6), F.lit("01")), F.lit("yyyyMMdd"))
    judged = rows.join(bad, "run_id", "left").join(unfinished, "run_id", "left").join(stored, "run_key", "left")
    problem = (
        F.when(~F.coalesce(is_run_id(c("run_key")), F.lit(False)), "RUN_ID")
        .when(c("started_at").isNull() | c("ended_at").isNull(), "TIME")
        .when(c("ended_at") < c("started_at"), "END_BEFORE_START")
        .when(~F.coalesce(F.abs(F.months_between(key_month, F.date_trunc("MONTH", "started_at"))) <= 1, F.lit(False)), "RUN_ID_MONTH")
        .otherwise(c("broken"))
    )
    judged = judged.withColumn("problem", problem)
    usable = c("problem").isNull() & c("first_status").isNull() & c("is_stored").isNull()
    rank = F.row_number().over(Window.partitionBy("run_key", usable).orderBy("run_id"))
    outcome = (
        F.when(c("first_status").isNotNull(), "unfinished").when(c("problem").isNotNull(), "invalid")
        .when(c("is_stored").isNotNull() | (rank > 1), "duplicate").otherwise("published")
    )
    return judged.withColumn("outcome", outcome).select("run_id", "run_key", "outcome", F.coalesce("first_status", "problem").alias("detail"))


#: Times an append looks again at a table that other writers keep changing.
APPEND_TRIES = 50


def append_runs(executions: DataFrame, runs: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Append the summaries of new, finished and valid runs; returns the outcome of every run, none is left out silently.

    Repeating the call adds nothing, so an interrupted append can be run again. Several writers may append at once: the rows of a call
    become visible together, when no other writer has changed the table since its keys were looked up; else they are looked up
    again. A call that is repeated under the name ``batch`` replaces the files that its first run left without becoming visible.
    """
    spark = executions.sparkSession
    # Summaries do not depend on what is stored.
    rows, unfinished = written(summary_rows(executions, runs)), written(unfinished_runs(executions))
    own = batch or uuid.uuid4().hex
    for attempt in range(APPEND_TRIES):
        number, live = run_table.snapshot(spark, path)
        outcomes = written(_outcomes(rows, unfinished, run_table.read(spark, path, rows.schema, live)))
        published = outcomes.where("outcome = 'published'").select("run_id", "run_key")
        if published.isEmpty():
            return outcomes
        name = f"{own}-{number}"
        added = run_table.write_batch(rows.join(published, ["run_id", "run_key"], "left_semi"), path, name)
        if run_table.commit(spark, path, number + 1, live + added):
            return outcomes
        run_table.drop_batch(spark, path, name)
    raise RuntimeError(f"the table at {path} was changed by others {APPEND_TRIES} times; the append can be repeated")


def retain_runs(spark: SparkSession, path: str, schema, max_runs: int | None = None, max_age_days: float | None = None, as_of=None) -> DataFrame:
    """Delete what ``retention_plan`` drops from the table and return the fate of every run: run_key, outcome (``deleted`` or ``kept``).

    Only months with dropped runs are written anew. Until the new snapshot is there, readers see the old table, whatever happens.
    """
    for attempt in range(APPEND_TRIES):
        table = read_summaries(spark, path, schema)
        dropped = written(retention_plan(table, max_runs, max_age_days, as_of).select("run_key", "run_month"))
        fates = written(table.select("run_key").join(dropped.select("run_key", F.lit("deleted").alias("outcome")), "run_key", "left").select(
            "run_key", F.coalesce("outcome", F.lit("kept")).alias("outcome")))
        if run_table.rewrite_without(spark, path, table.schema, dropped):
            return fates
    raise RuntimeError(f"the table at {path} was changed by others {APPEND_TRIES} times; retention can be repeated")


#: Folders that the parts of runs are dealt over by a hash of their key.
BUCKETS = 64


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_run_parts(parts: dict[str, DataFrame], path: str) -> None:
    """Write tables that have a ``run_key`` - summaries, records, metadata, manifests - under their names, all dealt by the same hash."""
    for name, frame in parts.items():
        dealt = frame.withColumn("bucket", _bucket(F.col("run_key")))
        dealt.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{name}")


def get_run_parts(spark: SparkSession, path: str, run_key: str) -> dict[str, DataFrame]:
    """All parts of one run, whatever its month; of each table the one folder is read that may hold the key."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    bucket = spark.range(1).select(_bucket(F.lit(run_key))).first()[0]
    return {name: spark.read.parquet(f"{path}/{name}").filter((F.col("bucket") == bucket) & (F.col("run_key") == run_key)).drop("bucket") for name in names}


def save_api_logs(calls: DataFrame, path: str) -> None:
    """Write the kept API calls, one folder per test."""
    api_log(calls).write.partitionBy("test_case").mode("append").json(path)


def checked_numbers(frame: DataFrame) -> DataFrame:
    """Fail on numbers JSON cannot carry: not finite, or beyond the safe integers."""
    tests = []
    for name, kind in frame.dtypes:
        if kind in ("double", "float"):
            tests.append(F.isnan(name) | (F.abs(F.col(name)) == float("inf")))
        elif kind == "bigint":
            tests.append(F.abs(F.col(name)) > 9007199254740991)
    if not tests:
        return frame
    bad = F.lit(False)
    for test in tests:
        bad = bad | F.coalesce(test, F.lit(False))
    return frame.filter(F.when(bad, F.raise_error(F.lit("Numeric range exceeded in result.")).cast("boolean")).otherwise(True))


def as_json(frame: DataFrame) -> DataFrame:
    """Rows as JSON texts after the number check."""
    return checked_numbers(frame).select(F.to_json(F.struct(*frame.columns)).alias("json"))


