"""Streaming runs over the event table, read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.times import iso_text
from runlens.plans import sql as S
from runlens.plans.history_queries import LEGACY_SQL
from runlens.plans.report_queries import ORACLES as REPORT_ORACLES
from runlens.plans.report_queries import lifecycle_sql
from runlens.session import scratch_dir
from runlens.sources import tables
from runlens.streaming import ingest
from runlens.streaming import lifecycle as stream


def _folder(spark):
    return scratch_dir(spark, "stream")


def _events(spark, sf_dir):
    schema = tables.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return tables.lifecycle_events(spark, sf_dir, source)


def stream_coverage(spark, sf_dir):
    counts = stream.stream_coverage(_events(spark, sf_dir))
    return stream.run_to_table(counts, _folder(spark), "update", ("run_id", "action"))


def stream_failure_counts(spark, sf_dir):
    counts = stream.stream_failure_counts(_events(spark, sf_dir))
    return stream.run_to_table(counts, _folder(spark), "update", ("run_id", "category"))


def stream_test_records(spark, sf_dir):
    records = stream.stream_test_records(_events(spark, sf_dir), _folder(spark))
    return records.withColumn("execution_date", iso_text(F.col("execution_date")))


def stream_shuffled_records(spark, sf_dir):
    """The same events in five micro-batches of any order, so that steps and completions come before the starts they follow."""
    folder, files = _folder(spark), spark.sparkContext.defaultParallelism
    events = tables.lifecycle_events(spark, sf_dir)
    # Files are dealt by a hash, so those of any micro-batch have events of all times.
    events.repartition(5 * files, "seq").write.parquet(f"{folder}/events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")
    # A test may be silent for days here: it ends with its run alone.
    records = stream.stream_test_records(source, folder, idle_ms=100 * 24 * stream.HOUR_MS)
    return records.withColumn("execution_date", iso_text(F.col("execution_date")))


def stream_run_failures(spark, sf_dir):
    return stream.stream_run_failures(_events(spark, sf_dir), _folder(spark))


def _ingested(spark, sf_dir):
    folder = _folder(spark)
    tables.legacy_files(spark, sf_dir).drop("key").write.parquet(f"{folder}/files")
    files = spark.readStream.schema("name string, content string, modified_at timestamp").parquet(f"{folder}/files")
    ingest.ingest_legacy(files, f"{folder}/ledger", f"{folder}/progress", folder)
    return folder


def stream_legacy_store(spark, sf_dir):
    """The summaries that the ingest published, read back from their table."""
    rows = spark.read.parquet(f"{_ingested(spark, sf_dir)}/summaries")
    return rows.select("run_key", "migration_source", "migration_identity", "total", "passed", "timed_out", "unsuccessful")


def stream_legacy_ingest(spark, sf_dir):
    folder = _ingested(spark, sf_dir)
    return ingest.read_ledger(spark, f"{folder}/ledger").select("name", "outcome", "identity", "run_key")


QUERIES = {
    "stream_coverage": stream_coverage,
    "stream_failure_counts": stream_failure_counts,
    "stream_test_records": stream_test_records,
    "stream_shuffled_records": stream_shuffled_records,
    "stream_run_failures": stream_run_failures,
    "stream_legacy_ingest": stream_legacy_ingest,
    "stream_legacy_store": stream_legacy_store,
}

ORACLES = {
    "stream_coverage": S.with_ctes("lifecycle", """
        SELECT run_id, action, count(*) AS detected, count(*) FILTER (phase = 'captured') AS captured
        FROM lifecycle WHERE action IS NOT NULL GROUP BY run_id, action"""),
    "stream_failure_counts": S.with_ctes("lifecycle", f"""
        SELECT run_id, {S.category('c')} AS category, count(*) AS failures FROM (
          SELECT run_id, {S.clean('error_message')} AS c FROM lifecycle WHERE kind = 'complete' AND {S.canonical('status')} IN {S.FAILING}) GROUP BY ALL"""),
    "stream_test_records": lifecycle_sql(f"""
        SELECT run_id, test_case, attempts AS attempt, status, duration, error_message, failure_category, steps, retry_count,
               {S.iso('executed_at')} AS execution_date, CASE WHEN was_running THEN 'expired' ELSE 'completed' END AS closed FROM records"""),
    "stream_legacy_store": S.with_ctes((), """
        SELECT strftime(created_at, '%Y%m%d-%H%M%S-%g') || '-' || right(identity, 8) AS run_key, name AS migration_source, identity AS migration_identity,
               CAST(2 AS BIGINT) AS total, CAST(1 AS BIGINT) AS passed, CAST(1 AS BIGINT) AS timed_out, CAST(1 AS BIGINT) AS unsuccessful
        FROM legacy WHERE error IS NULL""", legacy=LEGACY_SQL),
    "stream_legacy_ingest": S.with_ctes((), """
        SELECT name, CASE WHEN error IS NOT NULL THEN 'failed' ELSE 'migrated' END AS outcome, identity,
               CASE WHEN error IS NULL THEN strftime(created_at, '%Y%m%d-%H%M%S-%g') || '-' || right(identity, 8) END AS run_key FROM legacy""",
        legacy=LEGACY_SQL),
}
ORACLES["stream_shuffled_records"] = ORACLES["stream_test_records"]
ORACLES["stream_run_failures"] = REPORT_ORACLES["completion_categories"]
