"""Web captures answered with "not modified", resolved to the full response they stand for.

A revisit belongs to the latest earlier full response of the same canonical URL, if the validators of the two agree; the headers that
such an answer may carry replace the stored ones. Captures of one URL are cut into ranges of time, each ordered on its own,
and the last response of each range is handed on to the later ones; so a URL with a third of all captures is no single task.
Bodies take no part in this: they are joined by the id of the response once it is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.texts import cuts, range_of

#: Headers that an answer "not modified" may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no other page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"
#: Captures of a time range, on average, and the most ranges.
RANGE_ROWS, MOST_RANGES = 20_000, 4096

RESPONSE, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www``, user and usual port, path without a last slash, other parameters in order.

    Scheme and fragment do not matter. A text that is no absolute URL stays as it is.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    server = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(server, r"^[^@]*@", "")), r":(80|443)?$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    asked = F.array_join(F.array_sort(F.filter(asked, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(server == "", F.trim(url)).otherwise(F.concat(host, path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked))))


def lower_names(headers: Column) -> Column:
    """Headers by their names in lower case; of names equal then the last one counts. Null headers are none."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(pairs, lambda p: F.lower(p["key"])))
    value = lambda name: F.element_at(F.filter(pairs, lambda p: F.lower(p["key"]) == name), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def _tag(headers: Column) -> Column:
    """The entity tag for a weak comparison."""
    return F.regexp_replace(F.trim(F.try_element_at(headers, F.lit("etag"))), r"^W/", "")


def outcome(stored: Column, sent: Column) -> Column:
    """Whether validators agree: entity tags if the revisit has one, else the times of modification."""
    tag, time = _tag(sent), F.try_element_at(sent, F.lit("last-modified"))
    return F.when(stored.isNull(), "no_response").when(
        tag.isNotNull(), F.when(tag.eqNullSafe(_tag(stored)), "resolved").otherwise("validator_mismatch")
    ).when(
        time.isNotNull(), F.when(time.eqNullSafe(F.try_element_at(stored, F.lit("last-modified"))), "resolved").otherwise("validator_mismatch")
    ).otherwise("no_validator")


def merged(stored: Column, sent: Column) -> Column:
    """Stored headers, with those that the revisit may bring up to date in their place."""
    fresh = F.map_filter(sent, lambda name, _: name.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda name, _: ~F.array_contains(F.map_keys(fresh), name)), fresh)


def resolve(captures: DataFrame) -> DataFrame:
    """For each revisit: ``record_id``, ``canonical_url``, ``at``, ``outcome``, ``response_id`` and merged ``headers``.

    ``captures`` has ``record_id``, ``kind`` (response or revisit), ``url``, ``at`` (a number) and ``headers`` (a map). The response
    and its id are null unless the outcome is ``resolved``. A response counts if it was captured strictly before; of several at
    one time the one with the largest id. Captures without a URL or time meet no response. Repeated revisits stay, other columns go.
    """
    rows = captures.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "at", lower_names(F.col("headers")).alias("headers"))
    timed = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    usable = rows.where(timed & F.col("kind").isin(RESPONSE, REVISIT))
    bounds = cuts(captures, "at", max(1, min(MOST_RANGES, captures.count() // RANGE_ROWS)))
    response = F.when(F.col("kind") == RESPONSE, F.struct("record_id", "headers"))
    ranged = usable.withColumn("range", range_of(F.col("at"), bounds)).withColumn("response", response)
    # At one time revisits come first, as a response of that time is not an earlier one.
    within = Window.partitionBy("canonical_url", "range").orderBy("at", F.col("kind") == RESPONSE, "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("stored", F.last("response", ignorenulls=True).over(within)).where(F.col("kind") == REVISIT)
    # The last response of each range, and of all ranges before one that has a revisit.
    lasts = ranged.groupBy("canonical_url", "range").agg(
        F.max_by("response", F.when(F.col("kind") == RESPONSE, F.struct("at", "record_id"))).alias("response"))
    earlier = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select("canonical_url", "range", F.last("response", ignorenulls=True).over(earlier).alias("before"))
    found = near.join(before, ["canonical_url", "range"], "left").withColumn("stored", F.coalesce("stored", "before"))
    lost = rows.where(~F.coalesce(timed, F.lit(False)) & (F.col("kind") == REVISIT)).withColumn("stored", F.lit(None).cast(found.schema["stored"].dataType))
    every = found.select(*rows.columns, "stored").union(lost).withColumn("outcome", outcome(F.col("stored.headers"), F.col("headers")))
    good = F.col("outcome") == "resolved"
    return every.select(
        "record_id", "canonical_url", "at", "outcome", F.when(good, F.col("stored.record_id")).alias("response_id"),
        F.when(good, merged(F.col("stored.headers"), F.col("headers"))).alias("headers"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds the columns of ``bodies`` (one row for each ``record_id``) of the response; null where none was found."""
    return resolved.join(bodies.withColumnRenamed("record_id", "response_id"), "response_id", "left")


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page once in full, a minute apart, and once more forty and a half minutes later, not modified.

    Every fifth revisit has a weak tag, every tenth one of another version. Bodies are left out; a page is record ``2 * page_id``.
    """
    number, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    at = number * 60
    full = pages.select(
        (2 * number).alias("record_id"), F.lit(RESPONSE).alias("kind"), "url", at.alias("at"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
            F.lit("ETag"), tag, F.lit("Date"), at.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    again = at + 40 * 60 + 30
    sent = F.when(number % 10 == 9, F.lit('"other"')).when(number % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    short = pages.select(
        (2 * number + 1).alias("record_id"), F.lit(REVISIT).alias("kind"), "url", again.alias("at"),
        F.create_map(
            F.lit("ETag"), sent, F.lit("Date"), again.cast("string"), F.lit("Cache-Control"), F.lit("max-age=120"),
            F.lit("Content-Length"), F.lit("0"), F.lit("X-Cache"), F.lit("HIT"),
        ).alias("headers"),
    )
    return full.union(short)


def digests(pages: DataFrame) -> DataFrame:
    """The revisits of a crawl of ``pages`` with their merged headers as text and the digest of the body they stand for."""
    bodies = pages.select((2 * F.col("page_id")).alias("record_id"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("body_sha256"))
    rows = with_bodies(resolve(captures_of(pages)), bodies)
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda h: F.concat_ws(": ", h["key"], h["value"]))
    return rows.select("record_id", "canonical_url", "at", "outcome", "response_id", F.array_join(lines, "\n").alias("headers"), "body_sha256")


_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, html, url, regexp_replace(trim(url), '#.*$', '') AS plain FROM pages
), cut AS (
  SELECT *, regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1) AS server,
    regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') AS asked
  FROM parts
), urls AS (
  SELECT page_id, html, md5(html) AS tag, page_id * 60 AS seen, page_id * 60 + 2430 AS again,
    CASE WHEN server = '' THEN trim(url) ELSE
      regexp_replace(regexp_replace(lower(regexp_replace(server, '^[^@]*@', '')), ':(80|443)?$', ''), '^www[0-9]*\.', '')
      || path || CASE WHEN asked = '' THEN '' ELSE '?' || asked END END AS canonical_url
  FROM cut
)"""

ORACLE = _URL_SQL + r""", met AS (
  SELECT v.page_id, v.canonical_url, v.again, v.tag AS own, r.page_id AS stored, r.tag, r.html
  FROM urls v ASOF LEFT JOIN urls r ON v.canonical_url = r.canonical_url AND v.again > r.seen
), judged AS (
  SELECT *, CASE WHEN stored IS NULL THEN 'no_response' WHEN page_id % 10 <> 9 AND own = tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM met
)
SELECT 2 * page_id + 1 AS record_id, canonical_url, again AS at, outcome,
  CASE WHEN outcome = 'resolved' THEN 2 * stored END AS response_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || strlen(html) || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: ' || again || chr(10) || 'etag: ' || CASE WHEN page_id % 5 = 0 THEN 'W/' ELSE '' END
    || '"' || own || '"' END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(html) END AS body_sha256
FROM judged
"""
