"""Run history: validation of stored summaries, diagnostics, retention, ingest and artifact audit."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.fixed_values import (
    ARTIFACT_TYPES,
    AVAILABILITY_FIELDS,
    COUNT_FIELDS,
    DIAGNOSTIC_MESSAGES,
    HISTORY_SCHEMA_VERSION,
    IO_ERROR_CODES,
    MAX_SAFE_INTEGER,
    METADATA_FIELDS,
    RUN_ID_PATTERN,
    SAFE_RUN_ID_PATTERN,
    SHA256_PATTERN,
)
from runlens.functions.numbers import DURATION_TYPE, exact_duration, is_adjacent_double, mean, rate, to_fixed2
from runlens.functions.text import is_blank, version_token
from runlens.functions.times import is_run_id, migration_identity, migration_run_id, parse_stored_timestamp, parse_timestamp
from runlens.operators.metrics import RunQuery
from runlens.session import written

TIMESTAMP_FIELDS = ("createdAt", "timestamp", "startTime", "endTime")
DURATION_FIELDS = ("totalDuration", "averageDuration")
ISSUE_TYPE = "array<struct<code:string,field:string,detail:string>>"


# JSON kind of each type word a variant schema starts with.
KINDS = {
    "TINYINT": "number", "SMALLINT": "number", "INT": "number", "BIGINT": "number", "DECIMAL": "number", "FLOAT": "number", "DOUBLE": "number",
    "STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null",
}


def _kind(doc: Column, path: str | None = None) -> Column:
    """JSON kind at a path, or of the whole value: number, string, boolean, object, array or null; null when missing."""
    value = doc if path is None else F.try_variant_get(doc, f"$.{path}", "variant")
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair]), word)


def _text(doc: Column, path: str | None = None) -> Column:
    """A string value; null for any other JSON kind."""
    return F.when(_kind(doc, path) == "string", F.try_variant_get(doc, "$" if path is None else f"$.{path}", "string"))


def _is_count(value: Column) -> Column:
    return F.coalesce((value >= 0) & (value == F.floor(value)) & (value < float("inf")), F.lit(False))


# Numbers and flags of another JSON type read as null. Where a text must be told from other kinds, it is read as a variant.
SUMMARY_SCHEMA = ", ".join(
    [f"{f} double" for f in (*COUNT_FIELDS, *DURATION_FIELDS, "passRate")]
    + [f"{f} string" for f in ("runId", *TIMESTAMP_FIELDS)]
    + [f"{f} variant" for f in ("schemaVersion", *METADATA_FIELDS, "migration")]
    + ["failureCategoryCounts map<string,double>", "reportAvailability struct<" + ",".join(f"{f}:boolean" for f in AVAILABILITY_FIELDS) + ">"]
    + ["_corrupt_record string"]
)


def read_fields(files: DataFrame) -> DataFrame:
    """Typed fields of each summary text, parsed once."""
    c = F.col
    parsed = files.withColumn("s", F.from_json("content", SUMMARY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    braced = F.startswith(F.ltrim(c("content"), F.lit(" \t\r\n")), F.lit("{"))
    # Only texts the typed reader objects to are parsed again, to tell broken JSON from wrong types.
    doubtful = ~braced | c("s._corrupt_record").isNotNull() | c("s").isNull()
    is_object = F.when(doubtful, F.when(F.try_parse_json("content").isNotNull(), braced)).otherwise(F.lit(True))
    return parsed.select(
        "run_dir", "read_error", c("content").isNotNull().alias("has_content"), F.when(c("content").isNotNull(), is_object).alias("is_object"),
        *[c(f"s.{f}") for f in (*COUNT_FIELDS, *DURATION_FIELDS, "passRate", "runId", *TIMESTAMP_FIELDS)],
        *[_text(c(f"s.{f}")).alias(f) for f in ("schemaVersion", *METADATA_FIELDS)],
        *[_kind(c(f"s.{f}")).alias(f"{f}_kind") for f in (*METADATA_FIELDS, "migration")],
        c("s.failureCategoryCounts").alias("categoryCounts"),
        *[c(f"s.reportAvailability.{f}").alias(f"has_{f}") for f in AVAILABILITY_FIELDS],
        *[_text(c("s.migration"), f).alias(f"migration_{f}") for f in ("identity", "source", "sourceChecksum")],
    )


def summary_rules() -> dict[str, Column]:
    """Storage rules by name; true where a summary breaks one."""
    c = F.col

    def fails(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    times = {f: parse_stored_timestamp(c(f)) for f in TIMESTAMP_FIELDS}
    has_migration = c("migration_kind").isNotNull()
    counts = F.coalesce(F.map_values("categoryCounts"), F.array().cast("array<double>"))
    return {
        "NOT_AN_OBJECT": fails(c("is_object")),
        "RUN_ID": fails(c("runId").rlike(SAFE_RUN_ID_PATTERN)),
        "RUN_ID_DIFFERS": fails(c("runId") == c("run_dir")),
        "SCHEMA_VERSION": fails(c("schemaVersion") == HISTORY_SCHEMA_VERSION),
        **{f"TIME_{f}": times[f].isNull() for f in TIMESTAMP_FIELDS},
        "END_BEFORE_START": F.coalesce(times["endTime"] < times["startTime"], F.lit(False)),
        **{f"COUNT_{f}": ~_is_count(c(f)) for f in COUNT_FIELDS},
        **{f"DURATION_{f}": fails((c(f) >= 0) & (c(f) < float("inf"))) for f in DURATION_FIELDS},
        "PASS_RATE": fails(c("passRate").between(0, 100)),
        "CATEGORY_COUNTS": c("categoryCounts").isNull() | F.exists(counts, lambda v: ~_is_count(v)),
        "STATUS_SUM": fails(c("total") == c("passed") + c("failed") + c("skipped") + c("timedOut") + c("interrupted")),
        "UNSUCCESSFUL_SUM": fails(c("unsuccessful") == c("failed") + c("timedOut") + c("interrupted")),
        "TRACE_COUNTS": fails(c("traceAvailableCount") == c("tracePreservedCount")),
        "MIGRATION": has_migration & (
            (c("migration_kind") != "object") | fails(c("migration_identity").rlike(SHA256_PATTERN))
            | is_blank(c("migration_source")) | fails(c("migration_sourceChecksum").rlike(SHA256_PATTERN))
        ),
    }


def scan_history(files: DataFrame) -> DataFrame:
    """Every run directory with its diagnosis; a null code marks a valid summary.

    ``files`` has run_dir, content (null when the file is missing) and read_error.
    """
    c = F.col
    # The texts are parsed once, into a typed table; the rules then read plain columns. Only a summary that breaks a rule gets a list.
    rules = summary_rules()
    broken = reduce(or_, rules.values())
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    fields = written(read_fields(files)).withColumn("violations", F.when(broken, names).otherwise(F.array().cast("array<string>")))
    bad_dir = ~F.coalesce(is_run_id(c("run_dir")), F.lit(False))
    missing = (c("read_error") == "ENOENT") | (~c("has_content") & c("read_error").isNull())
    unsupported = c("schemaVersion").isNotNull() & (c("schemaVersion") != HISTORY_SCHEMA_VERSION)
    code = (
        F.when(bad_dir, "INVALID_SUMMARY")
        .when(missing, "MISSING_SUMMARY")
        .when(c("read_error").isNotNull(), "UNREADABLE_RUN")
        .when(c("is_object").isNull(), "CORRUPT_SUMMARY")
        .when(unsupported, "UNSUPPORTED_SCHEMA")
        .when(broken, "INVALID_SUMMARY")
    )
    io_code = F.when(c("read_error").isin(*IO_ERROR_CODES), c("read_error")).otherwise("UNKNOWN")
    return fields.withColumn("code", code).withColumn(
        "diagnostic",
        F.when(
            c("code").isNotNull(),
            F.struct(
                c("code").alias("code"),
                F.when(is_run_id(c("run_dir")), c("run_dir")).alias("run_key"),
                F.when(bad_dir, "runId").when(c("code") == "UNSUPPORTED_SCHEMA", "schemaVersion").alias("field"),
                F.when(c("code") == "MISSING_SUMMARY", "ENOENT").when(c("code") == "UNREADABLE_RUN", io_code).alias("error_code"),
                F.when(c("code") == "UNSUPPORTED_SCHEMA", version_token(c("schemaVersion"))).alias("schema_version"),
            ),
        ),
    )


def _issue(test: Column, code: str, field: Column, detail: Column | None = None) -> Column:
    entry = F.struct(F.lit(code).alias("code"), field.alias("field"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    return F.when(test, entry)


def normalize_history(scanned: DataFrame) -> DataFrame:
    """Valid summaries as run rows with issues; ``usable`` is false outside the aggregation's numeric contract.

    A total duration one double away from an exact thousandth, left by an early writer, is repaired.
    """
    c = F.col
    valid = scanned.filter(c("code").isNull())
    stored, total = c("totalDuration"), c("total")
    candidate = F.when(stored <= MAX_SAFE_INTEGER, stored.cast(DURATION_TYPE)).cast("double")
    repaired = F.when(
        (total >= 2) & is_adjacent_double(stored, candidate)
        & (to_fixed2(stored / total) == c("averageDuration")) & (to_fixed2(candidate / total) == c("averageDuration")),
        candidate,
    )
    exact = exact_duration(stored).cast("double")
    largest = F.greatest(*[c(f) for f in COUNT_FIELDS], F.coalesce(F.array_max(F.map_values("categoryCounts")), F.lit(0.0)))
    rows = (
        valid.withColumn("exact", exact)
        .withColumn("duration", F.coalesce("exact", repaired))
        .withColumn("usable", (largest <= MAX_SAFE_INTEGER) & c("duration").isNotNull() & exact_duration(c("averageDuration")).isNotNull())
    )
    recomputed_rate = F.coalesce(rate(c("passed"), total), F.lit(0.0))
    recomputed_mean = F.coalesce(mean(c("duration"), total), F.lit(0.0))
    issues = [
        _issue(c("exact").isNull(), "DURATION_NORMALIZED", F.lit("totalDuration"), c("duration")),
        _issue(c("passRate") != recomputed_rate, "DERIVED_METRIC_MISMATCH", F.lit("passRate"), recomputed_rate),
        _issue(c("averageDuration") != recomputed_mean, "DERIVED_METRIC_MISMATCH", F.lit("averageDuration"), recomputed_mean),
        _issue(total == 0, "ZERO_TEST_RUN", F.lit(None).cast("string")),
    ]
    for name in METADATA_FIELDS:
        kind = c(f"{name}_kind")
        missing = kind.isNull() | (kind == "null")
        issues.append(_issue(missing, "MISSING_METADATA", F.lit(name)))
        issues.append(_issue(~missing & is_blank(c(name)), "INVALID_METADATA", F.lit(name), kind))
    for name in AVAILABILITY_FIELDS:
        issues.append(_issue(c(f"has_{name}").isNull(), "INVALID_METADATA", F.lit(f"reportAvailability.{name}")))
    start, end = parse_stored_timestamp(c("startTime")), parse_stored_timestamp(c("endTime"))

    def count(name: str) -> Column:
        return F.when(c("usable"), c(name).try_cast("bigint"))

    return rows.select(
        c("run_dir").alias("run_key"), "usable", c("schemaVersion").alias("schema_version"),
        parse_stored_timestamp(c("timestamp")).alias("started_at"), c("timestamp").alias("started_text"), start.alias("start_time"), end.alias("end_time"),
        (F.unix_millis(end) - F.unix_millis(start)).alias("elapsed_ms"),
        *[count(a).alias(b) for a, b in (("total", "total"), ("passed", "passed"), ("failed", "failed"), ("skipped", "skipped"),
                                        ("timedOut", "timed_out"), ("interrupted", "interrupted"), ("unsuccessful", "unsuccessful"))],
        F.when(c("usable"), rate(c("passed"), total)).alias("pass_rate"),
        c("duration").alias("total_duration"),
        F.when(c("usable"), mean(c("duration"), total)).alias("average_duration"),
        *[F.when(~is_blank(c(a)), c(a)).alias(b) for a, b in (("project", "project"), ("feature", "feature"), ("environment", "environment"),
                                                              ("browser", "browser"), ("executedBy", "executed_by"))],
        c("categoryCounts").alias("failure_category_counts"),
        count("traceReportedCount").alias("trace_reported"), count("tracePreservedCount").alias("trace_preserved"),
        *[F.coalesce(f"has_{f}", F.lit(False)).alias(f"has_{f}") for f in AVAILABILITY_FIELDS],
        c("migration_kind").isNotNull().alias("migrated"), c("migration_identity").alias("migration_identity"),
        F.when(c("usable"), F.array_compact(F.array(*issues))).otherwise(F.array().cast(ISSUE_TYPE)).alias("issues"),
    )


def source_counters(files: DataFrame, query: RunQuery | None = None) -> DataFrame:
    """One row: discovered, valid, excluded, excluded by numbers, matched and selected runs."""
    query = query or RunQuery()
    scanned = scan_history(files)
    runs = normalize_history(scanned)
    found = scanned.agg(
        F.count("*").alias("discovered"), F.count_if(F.col("code").isNull()).alias("valid"), F.count_if(F.col("code").isNotNull()).alias("excluded")
    )
    matched = F.count_if(F.col("usable") & F.coalesce(query.condition(), F.lit(False)))
    used = runs.agg(F.count_if(~F.col("usable")).alias("aggregation_excluded"), matched.alias("matched"))
    both = found.unionByName(used, allowMissingColumns=True)
    names = ("discovered", "valid", "excluded", "aggregation_excluded", "matched")
    selected = F.col("matched") if query.limit is None else F.least(F.col("matched"), F.lit(query.limit))
    return both.agg(*[F.max(n).alias(n) for n in names]).withColumn("selected", selected.cast("bigint"))


def selection_flags(files: DataFrame, query: RunQuery | None = None) -> DataFrame:
    """Whether metrics of a query are partial, as runs were excluded, or limited, as matching runs were cut off."""
    c = F.col
    return source_counters(files, query).select(
        ((c("excluded") > 0) | (c("aggregation_excluded") > 0)).alias("partial"), (c("selected") < c("matched")).alias("limited")
    )


def history_warnings(files: DataFrame, query: RunQuery | None = None) -> DataFrame:
    """All warnings of a history query: (seq, code, run_key, field, detail); ``seq`` orders the kinds.

    Warnings about missing or invalid metadata collapse to one per field with the number of runs.
    """
    query = query or RunQuery()
    c, none = F.col, F.lit(None).cast("string")
    scanned = scan_history(files)
    runs = written(normalize_history(scanned))
    matched = runs.filter(c("usable")).filter(query.condition())
    if query.limit is None:
        selected = matched
    else:
        order = (F.desc("started_at"), F.desc("run_key")) if query.newest_first else (F.asc("started_at"), F.asc("run_key"))
        selected = matched.orderBy(*order).limit(query.limit)

    def row(seq: int, code: Column, run_key: Column, field: Column, detail: Column) -> list[Column]:
        return [F.lit(seq).cast("bigint").alias("seq"), code.alias("code"), run_key.alias("run_key"), field.alias("field"),
                detail.cast("string").alias("detail")]

    storage = scanned.filter(c("code").isNotNull()).select(
        *row(1, c("code"), c("diagnostic.run_key"), c("diagnostic.field"), F.coalesce(c("diagnostic.schema_version"), c("diagnostic.error_code")))
    )
    unusable = runs.filter(~c("usable")).select(*row(2, F.lit("AGGREGATION_UNUSABLE_SUMMARY"), c("run_key"), F.lit("numericContract"), none))
    counts = storage.unionByName(unusable).agg(
        F.count_if(c("seq") == 1).alias("storage"), F.count_if(c("seq") == 2).alias("numbers")
    ).filter(c("storage") + c("numbers") > 0)
    numbers = F.concat(c("storage").cast("string"), F.lit("+"), c("numbers").cast("string"))
    excluded = counts.select(*row(3, F.lit("EXCLUDED_RUN"), none, none, numbers))
    partial = counts.select(*row(4, F.lit("PARTIAL_AGGREGATION"), none, none, numbers))
    issues = selected.select("run_key", F.inline("issues"))
    about_metadata = c("code").isin("MISSING_METADATA", "INVALID_METADATA")
    per_run = issues.filter(~about_metadata).select(*row(5, c("code"), c("run_key"), c("field"), c("detail")))
    collapsed = issues.filter(about_metadata).groupBy("code", "field").agg(F.count("*").alias("n")).select(
        *row(6, c("code"), none, c("field"), c("n"))
    )
    result = storage
    for part in (unusable, excluded, partial, per_run, collapsed):
        result = result.unionByName(part)
    found = scanned.agg(F.count("*").alias("n")).withColumn("what", F.lit("discovered"))
    usable = runs.agg(F.count_if("usable").alias("n")).withColumn("what", F.lit("usable"))
    hits = matched.agg(F.count("*").alias("n")).withColumn("what", F.lit("matched"))
    totals = found.unionByName(usable).unionByName(hits).groupBy().pivot("what", ["discovered", "usable", "matched"]).agg(F.first("n"))
    empty = F.when(c("discovered") == 0, "EMPTY_HISTORY").when((c("usable") > 0) & (c("matched") == 0), "NO_MATCHING_RUNS")
    result = result.unionByName(totals.select(*row(7, empty, none, none, none)).filter(c("code").isNotNull()))
    if query.limit is not None:
        kept = F.concat(F.lit(f"{query.limit} of "), c("matched").cast("string"))
        cut = totals.filter(c("matched") > query.limit)
        result = result.unionByName(cut.select(*row(8, F.lit("LIMIT_APPLIED"), none, F.lit("limit"), kept)))
    return result


def with_messages(warnings: DataFrame) -> DataFrame:
    """Add the fixed text of storage diagnostics."""
    texts = F.create_map(*[F.lit(v) for pair in DIAGNOSTIC_MESSAGES for v in pair])
    return warnings.withColumn("message", F.element_at(texts, F.col("code")))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run; equal times go by run key."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_key")).alias("run")).select("run.*")


def list_runs(runs: DataFrame, start=None, end=None, newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """Runs in an inclusive time range in time order."""
    query = RunQuery(start=start, end=end, newest_first=newest_first, limit=limit)
    order = [F.desc, F.desc] if newest_first else [F.asc, F.asc]
    listed = runs.filter(query.condition()).orderBy(order[0]("started_at"), order[1]("run_key"))
    return listed if limit is None else listed.limit(limit)


def get_run(runs: DataFrame, run_key: str) -> DataFrame:
    """The run of a key. Of a table partitioned by ``run_month`` only the month in the key and its neighbours are read, as a key may
    have been given some time before or after the start."""
    test = F.col("run_key") == run_key
    if "run_month" in runs.columns and re.match(RUN_ID_PATTERN, run_key):
        month = int(run_key[:4]) * 12 + int(run_key[4:6]) - 1
        test = test & F.col("run_month").isin(*(f"{m // 12:04}-{m % 12 + 1:02}" for m in (month - 1, month, month + 1)))
    return runs.filter(test)


def oldest_kept(runs: DataFrame, max_runs: int) -> tuple | None:
    """``started_at`` in microseconds and ``run_key`` of the newest run but ``max_runs - 1``; null where there are no more runs than that.

    Runs are counted by day, those of the day on the border by second, and only the runs of one second are put in order. The driver
    sees one number for each day, and for each second of one day.
    """
    for unit in ("DAY", "SECOND"):
        start = F.date_trunc(unit, "started_at")
        counts = runs.groupBy(F.unix_seconds(start).alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("at")).collect()
        border = None
        for row in counts:
            if row["n"] >= max_runs:
                border = row["at"]
                break
            max_runs -= row["n"]
        else:
            return None
        runs = runs.filter(F.unix_seconds(start).eqNullSafe(F.lit(border).cast("bigint")))
    last = runs.select("started_at", "run_key").orderBy(F.desc_nulls_last("started_at"), F.desc_nulls_last("run_key")).limit(max_runs)
    row = last.agg(F.min(F.struct(F.unix_micros("started_at").alias("at"), "run_key")).alias("m")).first()["m"]
    return row["at"], row["run_key"]


def retention_plan(runs: DataFrame, max_runs: int | None = None, max_age_days: float | None = None, as_of=None) -> DataFrame:
    """Runs to drop: all but the newest ``max_runs``, and those older than ``max_age_days`` at ``as_of``."""
    if max_runs is not None and (isinstance(max_runs, bool) or not isinstance(max_runs, int) or max_runs < 0):
        raise TypeError("max_runs must be a non-negative integer or None.")
    if max_age_days is not None and not 0 <= max_age_days < float("inf"):
        raise TypeError("max_age_days must be a finite non-negative number or None.")
    drop = F.lit(False)
    if max_runs == 0:
        drop = F.lit(True)
    elif max_runs is not None:
        oldest = oldest_kept(runs, max_runs)
        if oldest is not None:
            drop = F.struct("started_at", "run_key") < F.struct(F.timestamp_micros(F.lit(oldest[0]).cast("bigint")), F.lit(oldest[1]).cast("string"))
    if max_age_days is not None:
        age_ms = int(max_age_days * 86400000)
        drop = drop | (F.unix_millis("started_at") < F.unix_millis(F.lit(as_of).cast("timestamp")) - age_ms)
    return runs.filter(drop)


def retention_fates(scanned: DataFrame, max_runs: int | None = None, max_age_days: float | None = None, as_of=None) -> DataFrame:
    """What retention does with every run directory of ``scan_history``: ``deleted``, ``kept``, or ``skipped`` with the code of what is wrong.

    A run that cannot be read as a valid one is never deleted, and does not count among the newest.
    """
    c = F.col
    # The newest runs are found in several passes, which need a diagnosis only once.
    judged = written(scanned.select("run_dir", "code", parse_stored_timestamp(c("timestamp")).alias("started_at")))
    valid = judged.filter(c("code").isNull()).select(c("run_dir").alias("run_key"), "started_at")
    dropped = retention_plan(valid, max_runs, max_age_days, as_of).select(c("run_key").alias("dropped"))
    joined = judged.select("run_dir", "code").join(dropped, c("run_dir") == c("dropped"), "left")
    outcome = F.when(c("code").isNotNull(), "skipped").when(c("dropped").isNotNull(), "deleted").otherwise("kept")
    return joined.select("run_dir", outcome.alias("outcome"), "code")


def apply_retention(runs: DataFrame, dropped: DataFrame) -> DataFrame:
    return runs.join(dropped.select("run_key"), "run_key", "left_anti")


def new_runs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose key the history does not hold yet."""
    return candidates.join(existing.select("run_key"), "run_key", "left_anti")


def legacy_sources(files: DataFrame) -> DataFrame:
    """Legacy files (name, content, modified_at) read as records and metadata, with their identity.

    A file holds an array of records, or an object with ``execution`` and ``metadata``.
    """
    doc = F.col("doc")
    is_list = F.coalesce(_kind(doc) == "array", F.lit(False))
    records = F.when(is_list, F.try_variant_get(doc, "$", "array<variant>")).otherwise(
        F.when(_kind(doc, "execution") == "array", F.try_variant_get(doc, "$.execution", "array<variant>"))
    )
    content_hash = F.sha2("content", 256)
    start_text = F.when(~is_list, _text(doc, "metadata.executionStartTime"))
    created = F.coalesce(parse_timestamp(start_text), F.when(start_text.isNull(), F.col("modified_at")))
    parsed = files.withColumn("doc", F.try_parse_json("content")).select(
        "name", content_hash.alias("content_hash"), records.alias("records"), created.alias("created_at"),
        F.when(doc.isNull(), "corrupt").when(records.isNull(), "no records").when(created.isNull(), "bad start time").alias("error"),
    )
    identity = migration_identity(F.col("name"), F.col("content_hash"))
    return parsed.withColumn("identity", identity).withColumn("run_key", migration_run_id(F.col("created_at"), F.col("identity")))


def legacy_outcomes(sources: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """What happens to each legacy file not yet recorded: migrated, reconciled with a stored run, or failed.

    ``state`` holds (name, content_hash) of finished files, ``history`` (migration_identity, run_key) of stored runs.
    """
    # The identity stands for name and content, so that both joins need the sources dealt once.
    done = state.select(migration_identity(F.col("name"), F.col("content_hash")).alias("identity"))
    pending = sources.join(done, "identity", "left_anti")
    stored = history.filter(F.col("migration_identity").isNotNull()).groupBy(F.col("migration_identity").alias("identity")).agg(
        F.min("run_key").alias("stored_key")
    )
    outcome = (
        F.when(F.col("error").isNotNull(), "failed").when(F.col("stored_key").isNotNull(), "reconciled").otherwise("migrated")
    )
    return pending.join(stored, "identity", "left").select(
        "name", "identity", outcome.alias("outcome"),
        F.when(F.col("error").isNull(), F.coalesce("stored_key", "run_key")).alias("run_key"), "error", "content_hash", "records", "created_at",
    )


def manifest_entries(files: DataFrame) -> DataFrame:
    """Manifest rows from preserved files (run_key, type, path, file, size, sha256): size of each path, hash of single files.

    The rows are what ``audit_manifests`` takes.
    """
    return files.groupBy("run_key", "type", "path").agg(
        F.lit(True).alias("availability"),
        F.sum("size").alias("size"),
        F.count("*").alias("files"),
        F.when(F.bool_and(F.col("file") == F.col("path")), F.concat(F.lit("sha256:"), F.max("sha256"))).alias("checksum"),
    )


def normalized_path(path: Column) -> Column:
    """A relative path with its ``.`` and ``..`` parts resolved; null when it leaves its root or is empty."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda stack, p: F.when(
            (p == "..") & (F.size(stack) > 0) & (F.element_at(F.concat(F.array(F.lit("")), stack), -1) != ".."),
            F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))),
        ).otherwise(F.array_append(stack, p)),
    )
    return F.when(~path.startswith("/") & (F.size(depth) > 0) & (F.element_at(F.concat(depth, F.array(F.lit(""))), 1) != ".."), F.array_join(depth, "/"))


def audit_manifests(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries that contradict the files beside them, with the first broken rule.

    ``entries``: run_key, type, path, availability, size, checksum and, if there is one, why the manifest could not be read
    (``manifest_error``). ``files``: run_key, path, is_directory, size, sha256,
    one row per file and per directory.
    """
    c = F.col
    target = normalized_path(c("path"))
    listed = files.select("run_key", c("path").alias("target"), "is_directory", c("size").alias("file_size"), "sha256")
    # A proper checksum goes through the join as its 32 bytes.
    proper = c("checksum").rlike(SHA256_PATTERN)
    compact = entries.withColumn("target", target).withColumn("proper", proper).withColumn(
        "digest", F.when(proper & (F.length("checksum") == 71), F.unhex(F.substring("checksum", 8, 64)))).drop("checksum")
    joined = compact.join(listed, ["run_key", "target"], "left")
    same = F.when(c("digest").isNull() & c("sha256").isNotNull(), False).otherwise(F.lower(F.hex("digest")) == c("sha256"))
    known_type = F.coalesce(c("type").isin(*ARTIFACT_TYPES), F.lit(False))
    unread = c("manifest_error") if "manifest_error" in entries.columns else F.lit(None).cast("string")
    broken = (
        F.when(unread.isNotNull(), unread)
        .when(~known_type, "UNSUPPORTED_TYPE")
        .when(c("availability").isNull(), "AVAILABILITY_NOT_BOOLEAN")
        .when(c("target").isNull(), "PATH_ESCAPES")
        .when(~c("availability"), None)
        .when(c("file_size").isNull(), "MISSING_FILE")
        .when(~c("size").eqNullSafe(c("file_size")), "SIZE_MISMATCH")
        .when(c("is_directory") & c("proper").isNotNull(), "DIRECTORY_CHECKSUM")
        .when(~c("proper"), "CHECKSUM_FORMAT")
        .when(c("proper") & ~same, "CHECKSUM_MISMATCH")
    )
    return joined.withColumn("violation", broken).filter(c("violation").isNotNull()).select("run_key", "type", "path", "violation")


def directory_sizes(files: DataFrame) -> DataFrame:
    """Total size and number of files below each directory of each run."""
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    parents = F.when(F.size(parts) > 1, F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), "/")))
    return (
        files.select("run_key", "size", F.explode(parents).alias("directory"))
        .groupBy("run_key", "directory")
        .agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    )


def latest_evidence(files: DataFrame) -> DataFrame:
    """The last failure screenshot, by name, of each test: (run_key, test_case, file)."""
    shot = F.lower(F.col("file")).endswith(".png") & F.contains("file", F.lit("FAILED"))
    return files.filter(shot).groupBy("run_key", "test_case").agg(F.max("file").alias("file"))



def legacy_executions(outcomes: DataFrame) -> DataFrame:
    """Test records of the legacy files to migrate."""
    record = F.col("record")
    exploded = outcomes.filter(F.col("outcome") == "migrated").select(
        "run_key", F.posexplode("records").alias("ordinal", "record")
    )
    return exploded.select(
        F.col("run_key").alias("run_id"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        *[F.try_variant_get(record, f"$.{a}", t).alias(b)
          for a, b, t in (("testCase", "test_case", "string"), ("status", "status", "string"), ("duration", "duration", "double"),
                          ("feature", "feature", "string"), ("errorMessage", "error_message", "string"),
                          ("failureCategory", "stored_category", "string"), ("traceAvailable", "trace_available", "boolean"))],
    )


def legacy_durations(outcomes: DataFrame) -> DataFrame:
    """Total duration of migrated files: their records added up as doubles in file order."""
    total = F.aggregate(
        "records", F.lit(0.0), lambda acc, r: acc + F.coalesce(F.try_variant_get(r, "$.duration", "double"), F.lit(0.0))
    )
    return outcomes.filter(F.col("outcome") == "migrated").select("run_key", total.alias("total_duration"))
