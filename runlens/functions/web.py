"""URL tests and texts for API logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.fixed_values import STATIC_EXTENSIONS, STATIC_PATHS, TELEMETRY_VENDORS
from runlens.functions.text import none_if_empty


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_static_resource(url: Column) -> Column:
    path = F.substring_index(F.lower(F.coalesce(url, F.lit(""))), "?", 1)
    return _any([F.endswith(path, F.lit(e)) for e in STATIC_EXTENSIONS] + [F.contains(path, F.lit(p)) for p in STATIC_PATHS])


def is_api_call(url: Column) -> Column:
    """Neither a static resource nor telemetry."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    return ~is_static_resource(url) & ~_any([F.contains(lower, F.lit(v)) for v in TELEMETRY_VENDORS])


def is_included(url: Column, patterns: Sequence[str]) -> Column:
    return _any([F.contains(url, F.lit(p)) for p in patterns])


def api_endpoint(url: Column) -> Column:
    """Path and query of a URL, at most 90 characters; the text itself when it is no URL."""
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.coalesce(none_if_empty(F.try_parse_url(url, F.lit("PATH"))), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), none_if_empty(F.try_parse_url(url, F.lit("QUERY")))), F.lit(""))
    return F.substring(F.when(host.isNotNull(), F.concat(path, query)).otherwise(url), 1, 90)
