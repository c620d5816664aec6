"""Resolution of revisits."""

import pytest
from pyspark.sql import functions as F

from runlens.llm import revisits

SCHEMA = "record_id long, kind string, url string, at long, headers map<string,string>, extra string, stored string, range int"


def resolved(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return {r["record_id"]: r for r in revisits.resolve(frame).collect()}


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://User@WWW.Example.com:80/A/b/?utm_source=x&b=2&a=1#top", "example.com/A/b?a=1&b=2"), ("https://example.com", "example.com"),
        ("https://example.com:8443/x/", "example.com:8443/x"), ("not a url", "not a url"), ("", ""), (None, None), ("http://e.org/?ref=1", "e.org"),
    ]
    frame = spark.createDataFrame([(u, c) for u, c in pairs], "u string, c string")
    for r in frame.select("c", revisits.canonical_url(F.col("u")).alias("got")).collect():
        assert r["got"] == r["c"]


def test_latest_earlier_response(spark):
    got = resolved(spark, [
        (1, "response", "http://a.com/x", 10, {"ETag": '"1"', "Date": "d1", "Content-Length": "9", "X": "keep"}),
        (2, "response", "https://www.a.com/x/", 20, {"ETag": '"2"', "Date": "d2"}),
        (3, "revisit", "http://a.com/x", 15, {"etag": 'W/"1"', "Date": "new", "Content-Length": "0", "X": "drop"}),
        (4, "revisit", "http://a.com/x", 20, {"etag": '"1"'}),
        (5, "revisit", "http://a.com/x", 21, {"etag": '"1"'}),
        (6, "revisit", "http://a.com/x", 5, {"etag": '"1"'}),
        (7, "revisit", "http://a.com/x", 30, {}),
        (8, "revisit", None, 30, {"etag": '"1"'}),
        (9, "revisit", "http://a.com/x", None, None),
        (10, "response", "http://b.com", 1, {"Last-Modified": "m"}),
        (11, "revisit", "http://b.com", 2, {"last-modified": "m"}),
        (11, "revisit", "http://b.com", 2, {"last-modified": "m"}),
    ])
    assert {k: (r["outcome"], r["response_id"]) for k, r in got.items()} == {
        3: ("resolved", 1), 4: ("resolved", 1), 5: ("validator_mismatch", None), 6: ("no_response", None), 7: ("no_validator", None),
        8: ("no_response", None), 9: ("no_response", None), 11: ("resolved", 10),
    }
    assert got[3]["headers"] == {"etag": 'W/"1"', "date": "new", "content-length": "9", "x": "keep"}


@pytest.mark.parametrize("rows", [2, 7, 1000])
def test_ranges_of_a_hot_url_agree(spark, monkeypatch, rows):
    monkeypatch.setattr(revisits, "RANGE_ROWS", rows)
    given = [(i, "response" if i % 7 == 0 else "revisit", "http://a.com", i // 2, {"etag": "t"}) for i in range(60)]
    last, expected = {}, {}
    for i, kind, _, at, _ in given:
        if kind == "revisit":
            earlier = [(t, k) for k, k_kind, _, t, _ in given if k_kind == "response" and t < at]
            expected[i] = max(earlier)[1] if earlier else None
    assert {k: r["response_id"] for k, r in resolved(spark, given).items()} == expected and not last


def test_empty_and_repeated(spark):
    assert resolved(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://a.com", None), (1, "http://a.com", None), (None, None, "x")], "page_id long, url string, html string")
    assert revisits.digests(pages).count() >= 3
