import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from runlens.fixed_values import CATEGORY_RULES, ERROR_TYPE_RULES, SIGNATURE_RULES
from runlens.functions import failures as R
from runlens.functions import numbers as N
from runlens.functions import text as T
from runlens.functions import times, web

CATEGORIES = {
    "expect(received).toEqual(expected)": "ASSERTION_FAILURE",
    "browserType.launch: Executable does not exist": "CONFIGURATION_FAILURE",
    "net::ERR_CONNECTION_REFUSED": "NETWORK_FAILURE",
    "API call failed: response status is 500": "API_FAILURE",
    "Timeout 30000ms exceeded": "TIMEOUT_FAILURE",
    "strict mode violation: resolved to 2 elements": "LOCATOR_FAILURE",
    "waiting for locator('.x') - Timeout 5000ms exceeded": "TIMEOUT_FAILURE",
    "element one\nis not two\nfound": "UNKNOWN_FAILURE",
    "an element was\nELEMENT but not ever Found": "LOCATOR_FAILURE",
    "not element found not": "UNKNOWN_FAILURE",
    "no\u212a to\u212aen": "UNKNOWN_FAILURE",
    "   ": "UNKNOWN_FAILURE",
    "\u00a0\n": "UNKNOWN_FAILURE",
    "weird": "UNKNOWN_FAILURE",
}


def test_categories(many):
    assert many(R.failure_category, list(CATEGORIES)) == list(CATEGORIES.values())
    assert many(R.failure_category, [None]) == ["UNKNOWN_FAILURE"]


def test_one_pass_patterns_match_like_the_plain_ones(many):
    import re

    rng = random.Random(7)
    words = ["element", "not", "found", "api", "fail", "error", "status", "is", "500", "response", "ok", "\n", " ", "visible", "context", "already", "closed", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    patterns = {p for _, ps in CATEGORY_RULES for p in ps} | {p for _, rs in SIGNATURE_RULES for _, p in rs} | {p for _, ps in ERROR_TYPE_RULES for p in ps}
    for pattern in sorted(p for p in patterns if ".*" in p):
        expected = [bool(re.search(pattern, t, re.I)) for t in texts]
        assert many(lambda x, p=pattern: R.matches(x, p), texts) == expected, pattern


@pytest.mark.parametrize(
    "message, category, signature",
    [
        ("expect(page).toHaveURL(expected)", "ASSERTION_FAILURE", "EXPECT_TO_HAVE_URL"),
        ("expect(received).toBe(expected)", "ASSERTION_FAILURE", "EXPECT_TO_BE"),
        ("expect(something).someCustomMatcher()", "ASSERTION_FAILURE", "EXPECT_FAILURE"),
        ("Element is not visible - waiting for locator('.m')", "LOCATOR_FAILURE", "ELEMENT_NOT_VISIBLE"),
        ("page.waitForTimeout: Timeout 30000ms exceeded.", "TIMEOUT_FAILURE", "PAGE_WAIT_TIMEOUT"),
        ("net::ERR_NAME_NOT_RESOLVED - ENOTFOUND", "NETWORK_FAILURE", "NETWORK_DNS_FAILURE"),
        ("API request failed - status is 404", "API_FAILURE", "API_STATUS_4XX"),
        ("context already closed", "configuration_failure", "CONFIG_CONTEXT_CLOSED"),
        ("expect(page).toHaveURL(expected)", "LOCATOR_FAILURE", "UNKNOWN_SIGNATURE"),
        ("anything", "UNKNOWN_FAILURE", "UNKNOWN_SIGNATURE"),
        ("", "ASSERTION_FAILURE", "UNKNOWN_SIGNATURE"),
    ],
)
def test_signatures(one, message, category, signature):
    assert one(R.failure_signature(F.col("m"), F.col("c")), m=message, c=category) == signature


def test_error_types_and_origins(many):
    texts = ["expect (x)", "Timeout 5ms exceeded", "timeout only", "status of it is 404", "getByText('a')", None]
    assert many(R.error_type, texts) == ["AssertionError", "TimeoutError", "UnknownError", "StatusError", "LocatorError", "UnknownError"]
    stacks = [
        "boom\n    at LoginPage.verify (LoginPage.js:35:14)", "at C:\\work\\pages\\Order.tsx:7", "see CartPage.ts : 88", "no file", "at /srv/app/x.mjs", None,
    ]
    assert many(R.stack_origin, stacks) == ["LoginPage.js", "Order.tsx", "CartPage.ts", None, "x.mjs", None]


def test_status_forms(many):
    given = ["pass", "FAIL", "Skip", "timedOut", "", None, "FAILED:", "running"]
    assert many(R.canonical_status, given) == ["PASSED", "FAILED", "SKIPPED", "TIMEDOUT", "UNKNOWN", "UNKNOWN", "FAILED:", "RUNNING"]
    assert many(R.is_failure, given) == [False, True, False, True, False, False, True, False]
    assert many(R.is_failing, given) == [False, True, False, True, False, False, False, False]


def test_rounding_is_half_up_on_the_binary_value(many):
    rng = random.Random(1)
    values = [rng.randint(0, 5000) / rng.randint(1, 5000) * 100 for _ in range(2000)] + [0.125, 0.375, 1.005, 2.675, 1e15, 0.0, 33.335]
    expected = [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert many(N.to_fixed2, values, "double") == expected
    signed = many(N.to_fixed2_signed, [-v for v in values], "double")
    assert signed == [-e if e else 0.0 for e in expected]
    assert math.copysign(1, many(N.to_fixed2_signed, [-0.001], "double")[0]) == 1


def test_exact_durations(many):
    values = [0.3, 0.1 + 0.2, 0.0001, 125.125, -1.0, 9007199254740991.0, 9007199254740992.0]
    assert [None if v is None else float(v) for v in many(N.exact_duration, values, "double")] == [
        0.3, None, None, 125.125, None, 9007199254740991.0, None,
    ]
    assert many(lambda x: N.is_adjacent_double(x, F.lit(0.3)), [0.1 + 0.2, 0.3, 0.3001], "double") == [True, False, False]


def test_totals_fail_closed(spark):
    frame = spark.createDataFrame([(9007199254740991,), (1,)], "n bigint").agg(F.sum("n").alias("n"))
    with pytest.raises(Exception, match="Numeric range exceeded for things"):
        frame.select(N.checked_total(F.col("n"), "things")).collect()


def test_texts(many, one):
    assert many(T.clean_message, ["\u001b[31mred\u001b[0m\r\nline \n", "", None, "  "]) == ["red\nline", None, None, ""]
    assert many(T.title_case, ["loginButton_now", "foo-bar  baz", "(hello", "élan", ""]) == ["Login Button Now", "Foo Bar Baz", "(Hello", "éLan", ""]
    selectors = ['[aria-label="Sign in"]', "#user-name", "[data-test=login]", ".cart_link", "text='Add'", "button", "div > p", ""]
    assert many(T.selector_name, selectors) == ["Sign In", "User Name", "Login", "Cart Link", "Add", "Button", "", ""]
    assert many(T.safe_name, ["a b/c", "__x__", "", None]) == ["a_b_c", "x", "Step", "Step"]
    assert many(T.duration_text, [12.4, 999.5, 1500.0, 59999.0, 125000.0, None], "double") == ["12ms", "1000ms", "1.50s", "60.00s", "2m 5.0s", "0ms"]
    assert many(T.file_size_text, [0, 1023, 1024, 1536, 1048576, 5242880], "bigint") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 MB"]
    assert many(T.version_token, ["2.0.0", "2.0.0-next.1", "2.x", None]) == ["2.0.0", "2.0.0-next.1", "invalid-version-token", "invalid-version-token"]


def test_step_names(spark):
    target = T.target_from_factory(F.col("f"), F.col("v"), F.col("n"))
    rows = [("fill", "locator", "#user-name", None), ("click", "getByRole", "button", "Sign in"), ("dblclick", "getByText", "my item", None),
            ("dragAndDrop", "locator", "x", None), ("setInputFiles", "locator", "div > p", None), ("hover", "locator", "div > p", None)]
    frame = spark.createDataFrame(rows, "a string, f string, v string, n string").withColumn("t", target)
    got = [r[0] for r in frame.select(T.step_name(F.col("a"), F.col("t"), F.lit("#a"), F.lit("#b"))).collect()]
    assert got == ["Fill User Name", "Click Sign In", "Double Click My Item", "Drag A To B", "Upload File", "Hover Element"]
    chain = F.array(F.struct(F.lit("nth").alias("method"), F.lit("2").alias("value")))
    texts = [r[0] for r in frame.limit(2).select(T.target_text(F.col("t"), chain)).collect()]
    assert texts == ["selector=#user-name.nth(2)", "role=button name=Sign in.nth(2)"]


def test_week_buckets(many):
    days = ["2020-12-31T12:00:00Z", "2021-01-04T00:00:00Z", "2021-01-03T23:59:59Z", "0100-01-01T00:00:00Z"]
    keys = many(lambda x: times.bucket_key("week", times.bucket_start("week", times.parse_timestamp(x))), days)
    assert keys == ["2020-W53", "2021-W01", "2020-W53", "0099-W53"]


def test_time_texts(many):
    given = ["2024-02-30T00:00:00Z", "2024-01-01T00:00:00.5+02:00", "2024-01-01T00:00:00", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00+24:00"]
    assert many(lambda x: times.iso_text(times.parse_timestamp(x)), given) == [None, "2023-12-31T22:00:00.500Z", None, None, None]
    stored = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123Z", "2024-01-01T00:00:00.1Z", "2024-02-30T00:00:00Z", None]
    assert many(lambda x: times.parse_stored_timestamp(x).isNotNull(), stored) == [True, True, False, False, False]


def test_time_texts_cost_no_failing_cast(many):
    """A cast that fails inside makes an exception for each text, which takes longer than all the rest."""
    given = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5Z", "2024-01-01T00:00:00.123-01:30", "2024-01-01T00:00:00Z\n", "2024-01-01T00:00:00+02:60",
             "2024-1-1T00:00:00Z", "2024-01-01T00:00:00.1234Z", " 2024-01-01T00:00:00Z", "2024-01-01T00:00:00.Z", "", None]
    read = ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.500Z", "2024-01-01T01:30:00.123Z", "2024-01-01T00:00:00.000Z", *[None] * 7]
    assert many(lambda x: times.iso_text(times.parse_timestamp(x)), given) == read
    assert "try_cast" not in str(times.parse_timestamp(F.col("x"))).lower()


def test_urls(many):
    urls = ["https://a.b/app.JS?x=1", "https://a.b/api/x.json", "https://sentry.io/api", "https://a.b/assets/api", None]
    assert many(web.is_api_call, urls) == [False, True, False, False, True]
    long = "https://a.b/" + "p" * 200
    assert many(web.api_endpoint, ["https://a.b", "https://a.b/x?q=1#f", "nonsense", long]) == ["/", "/x?q=1", "nonsense", "/" + "p" * 89]
