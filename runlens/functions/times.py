"""UTC time texts and time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.fixed_values import INPUT_TIMESTAMP_PATTERN, RUN_ID_PATTERN, STORED_TIMESTAMP_PATTERN

#: The part of the input times that ends with the ``Z``, without a line break after it.
UTC_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z\z"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def parse_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text with zone or offset; null when malformed or an impossible date."""
    local = F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z")))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 3, "0").cast("int")
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    hours = _two_digits(text, r"[+-](\d{2}):\d{2}$")
    minutes = _two_digits(text, r"[+-]\d{2}:(\d{2})$")
    shifted = F.timestamp_millis(
        F.unix_millis(local) + fraction - (sign * (hours * 60 + minutes)).cast("bigint") * 60000
    )
    # Most texts are of UTC, which Spark reads by itself.
    return F.when(text.rlike(UTC_TIMESTAMP_PATTERN), F.try_to_timestamp(text)).when(
        text.rlike(INPUT_TIMESTAMP_PATTERN) & (hours <= 23) & (minutes <= 59), shifted)


def _two_digits(text: Column, pattern: str) -> Column:
    """The number that a pattern finds, 0 where there is none. An empty text is never cast, as each failing cast costs an exception."""
    found = F.regexp_extract(text, pattern, 1)
    return F.coalesce(F.when(found != "", found).cast("int"), F.lit(0))


def parse_stored_timestamp(text: Column) -> Column:
    """Timestamp of a stored ``...Z`` text with no or three fraction digits; null when invalid."""
    return F.when(text.rlike(STORED_TIMESTAMP_PATTERN), F.try_to_timestamp(text))


def bucket_start(dimension: str, ts: Column) -> Column:
    return F.date_trunc({"day": "DAY", "week": "WEEK", "month": "MONTH"}[dimension], ts)


def bucket_end(dimension: str, start: Column) -> Column:
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[dimension]
    return start + F.expr(step)


def bucket_key(dimension: str, start: Column) -> Column:
    """Key of a bucket: 2024-01-31, 2024-W05 or 2024-01."""
    if dimension == "week":
        year, week = F.extract(F.lit("YEAROFWEEK"), start), F.extract(F.lit("WEEK"), start)
        return F.when(start.isNotNull(), F.format_string("%04d-W%02d", year, week))
    return F.date_format(start, "yyyy-MM-dd" if dimension == "day" else "yyyy-MM")


def run_id_prefix(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss-SSS")


def display_run_id(ts: Column) -> Column:
    return F.coalesce(F.concat(F.lit("RUN-"), F.date_format(ts, "yyyyMMdd-HHmmss")), F.lit("RUN-UNKNOWN"))


def is_run_id(run_id: Column) -> Column:
    return run_id.rlike(RUN_ID_PATTERN)


def migration_identity(name: Column, content_hash: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(name, F.lit("\0"), content_hash), 256))


def migration_run_id(ts: Column, identity: Column) -> Column:
    return F.concat(run_id_prefix(ts), F.lit("-"), F.right(identity, F.lit(8)))
