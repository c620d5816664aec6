"""Adapters: the driver's tables read as test-run data.

One projection per table and no join, so that every query on top starts from a pruned scan.
A run is an order, a test record is a line item, a lifecycle event is an event, an API call is a page,
a step is a conversation turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.numbers import mean, rate
from runlens.functions.times import iso_text, run_id_prefix

# Error texts as a browser test would report them; each rule family occurs.
MESSAGES = (
    "browserType.launch: Executable does not exist at /opt/browsers/chrome",
    "browser.newContext: Target page has been closed",
    "browser.newPage: crashed",
    "fixture setup for browser failed to start",
    "browser chromium not found on this host",
    "context already closed while reading the page",
    "expect(received).toEqual(expected) // deep equality",
    "expect(page).toHaveURL(expected) failed",
    "expect(page).toHaveTitle(\"Shop\") received \"Home\"",
    "expect(locator).toHaveText(\"Cart\")",
    "expect(received).toBe(expected)",
    "expect (value).someMatcher()",
    "assertion toContain was not met",
    "assertion toMatch was not met",
    "net::ERR_CONNECTION_REFUSED while opening the shop",
    "connect ECONNREFUSED 127.0.0.1:8080",
    "getaddrinfo ENOTFOUND shop.example.com",
    "read ECONNRESET",
    "connect ETIMEDOUT 10.0.0.7:443",
    "socket hang up",
    "fetch failed",
    "API call failed: response status is 500",
    "api returned an error",
    "status of the order is 404",
    "request was aborted by the client",
    "response was not ok",
    "Timeout 30000ms exceeded.",
    "page.waitForTimeout: Timeout 5000ms exceeded",
    "the step timed out",
    "waiting for locator('.modal') - Timeout 5000ms exceeded",
    "strict mode violation: locator resolved to 2 elements",
    "waiting for locator(\"#pay\")",
    "locator('#cart') was not found",
    "element is not visible",
    "element is not attached to the DOM",
    "no element matches the selector",
    "unable to locate the basket",
    "page.locator('.total') has no match",
    "getByRole('button') has no match",
    "Login failed for user demo",
    "invalid session token",
    "something unexpected happened",
    "received 403 from the gateway",
    "   ",
)

# Where an error text says it came from.
ORIGINS = (
    "\n    at LoginPage.verify (/srv/app/pages/LoginPage.js:35:14)",
    "\n    at tests/checkout.spec.ts:12:3",
    " (CartPage.ts:88)",
    "",
    "\n    at Object.<anonymous> (C:\\work\\OrderPage.tsx:7:1)",
)

STATUS_SPELLINGS = ("FAILED", "fail", "timedOut", "interrupted")
BROWSERS = ("chromium", "firefox", "webkit")
AUTO_ACTIONS = (
    "fill", "click", "check", "uncheck", "selectOption", "press", "dragAndDrop", "setInputFiles", "hover", "dblclick",
    "tap", "focus", "blur",
)


#: What the recorder of the test tables takes, and how their steps are described (name, title, action, expected result).
API_INCLUDE = ("/api/", "shop.example")
STEP_DESCRIPTIONS = (
    ("Step01_Open_Login_Page", "Open the form", "The page with the form is opened.", "Both fields can be seen."),
    ("Step02_Input_Username", "Name", "A known name is typed into its field.", "The field holds the name."),
    ("Step04_Click_Login", "Send the form", "The button below the form is pressed.", "The form is sent."),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """The value at a zero-based position of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test records: run_id, ordinal, test_case, status, duration, feature, error and trace columns."""
    c = F.col
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    failing = c("l_returnflag") == "R"
    message = F.concat(pick(MESSAGES, c("l_suppkey") % len(MESSAGES)), pick(ORIGINS, c("l_partkey") % len(ORIGINS)))
    coloured = F.concat(F.lit("\u001b[31m"), message, F.lit("\u001b[39m\r\n"))
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("run_id"),
        (
            c("l_linenumber") * F.lit(10**18) + (c("l_partkey") % 1000000) * F.lit(10**12) + (c("l_suppkey") % 10000) * F.lit(10**8) + cents % F.lit(10**8)
        ).alias("ordinal"),
        F.concat(F.lit("TC"), F.lpad((c("l_partkey") % 60).cast("string"), 3, "0")).alias("test_case"),
        F.when(failing, pick(STATUS_SPELLINGS, c("l_linenumber") % len(STATUS_SPELLINGS)))
        .when((c("l_returnflag") == "A") & (c("l_linenumber") % 3 == 0), "skipped")
        .when(c("l_linestatus") == "O", "PASS")
        .otherwise("passed")
        .alias("status"),
        F.when((c("l_linenumber") == 7) & (c("l_suppkey") % 10 == 0), cents / 100.0)
        .otherwise((cents % 1000000) / 1000.0)
        .alias("duration"),
        F.when(c("l_partkey") % 13 == 0, None)
        .when(c("l_partkey") % 13 == 1, "")
        .otherwise(F.concat(F.lit("Suite "), (c("l_partkey") % 8).cast("string")))
        .alias("feature"),
        F.when(failing & (c("l_suppkey") % 19 != 0), F.when(c("l_partkey") % 11 == 0, coloured).otherwise(message)).alias(
            "error_message"
        ),
        F.when(failing & (c("l_suppkey") % 7 == 0), "EXTERNAL_FAILURE").alias("stored_category"),
        (c("l_partkey") % 3).cast("bigint").alias("retry_count"),
        F.when(c("l_linenumber") % 3 == 0, True).when(c("l_linenumber") % 3 == 1, False).alias("trace_available"),
        F.when(c("l_suppkey") % 10 == 0, cents % 1024).otherwise(cents).alias("trace_size"),
        F.concat_ws("-", c("l_partkey").cast("string"), c("l_suppkey").cast("string")).alias("output_dir"),
    )


def _start_ms() -> Column:
    return F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400000


def _run_key() -> Column:
    serial = F.translate(F.hex(F.floor(F.col("o_orderkey") / F.lit(86400000)).cast("bigint")), "ABCDEF", "abcdef")
    return F.concat(run_id_prefix(F.timestamp_millis(_start_ms())), F.lit("-"), F.lpad(serial, 8, "0"))


def runs(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = (), orders: DataFrame | None = None) -> DataFrame:
    """Run metadata: run_id, run_key, start and end, five metadata texts, migration and artifact flags, and ``more`` columns of the order."""
    c = F.col
    start_ms = _start_ms()
    start = F.timestamp_millis(start_ms)
    source = table(spark, sf_dir, "orders") if orders is None else orders
    return source.select(
        c("o_orderkey").alias("run_id"),
        _run_key().alias("run_key"),
        start.alias("started_at"),
        F.timestamp_millis(start_ms + (c("o_custkey") % 7200) * 1000 + c("o_orderkey") % 1000).alias("ended_at"),
        F.when(c("o_custkey") % 29 != 0, c("o_orderpriority")).alias("project"),
        F.concat(F.lit("Area "), (c("o_custkey") % 9).cast("string")).alias("feature"),
        c("o_orderstatus").alias("environment"),
        F.when(c("o_custkey") % 31 != 0, pick(BROWSERS, c("o_custkey") % 3)).alias("browser"),
        F.concat(F.lit("agent-"), (c("o_custkey") % 25).cast("string")).alias("executed_by"),
        F.lit("1.0.0").alias("schema_version"),
        (c("o_orderkey") % 17 == 0).alias("migrated"),
        (c("o_custkey") % 4).alias("trace_preserved"),
        (c("o_orderkey") % 2 == 0).alias("has_pdf"),
        (c("o_orderkey") % 3 == 0).alias("has_dashboard"),
        (c("o_orderkey") % 5 == 0).alias("has_evidence"),
        (c("o_custkey") % 4 > 0).alias("has_traces"),
        *more,
    )


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API log: run_id, test_case, seq, method, status, duration, url."""
    c = F.col
    kind = c("page_id") % 12
    url = c("url")
    return table(spark, sf_dir, "pages").select(
        (c("page_id") % 40).alias("run_id"),
        F.concat(F.lit("TC"), F.lpad((c("page_id") % 60).cast("string"), 3, "0")).alias("test_case"),
        c("page_id").alias("seq"),
        pick(("GET", "POST", "PUT"), c("page_id") % 3).alias("method"),
        pick((200, 201, 404, 500), c("page_id") % 4).cast("bigint").alias("status"),
        (F.length(c("html")) * 3).cast("bigint").alias("duration"),
        F.when(kind == 0, F.concat(url, F.lit("/app.CSS?v=1")))
        .when(kind == 1, F.concat(url, F.lit("/static/logo")))
        .when(kind == 2, F.concat(F.lit("https://www.google-analytics.com/collect?u="), url))
        .when(kind == 3, F.concat(F.lit("not a url "), url))
        .when(kind == 4, F.concat(F.lit("https://api.example.com/api/v1/items/"), c("page_id").cast("string"), F.lit("?from="), F.substring_index(url, "//", -1)))
        .when(kind == 5, F.lit("https://www.shop.example"))
        .when(kind == 6, F.concat(url, F.lit("/Sentry/x")))
        .otherwise(url)
        .alias("url"),
    )


def lifecycle_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Recorder events: run_id, test_case, event_time, seq, kind, retry, status, duration, error, action, phase."""
    c = F.col
    source = table(spark, sf_dir, "events") if events is None else events
    number = F.regexp_extract(c("props"), r"(\d+)", 1).cast("int")
    kind = (
        F.when(c("event_type") == "signup", "test_start")
        .when(c("event_type") == "purchase", "complete")
        .when(c("event_type") == "view", "run_update")
        .otherwise("step")
    )
    end_status = pick(("passed", "FAIL", "timedOut", "interrupted", "skipped", "PASS"), number % 6)
    is_step = kind == "step"
    return source.withColumn("n", number).select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.concat(F.lit("T"), F.lpad((c("user_id") % 20).cast("string"), 2, "0")).alias("test_case"),
        c("ts").cast("timestamp").alias("event_time"),
        c("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(kind == "test_start", c("n") % 3).cast("bigint").alias("retry"),
        F.when(kind == "complete", end_status)
        .when(is_step, F.when(c("event_type") == "error", "FAIL").otherwise("PASS"))
        .alias("status"),
        F.when(kind.isin("complete", "step"), c("value")).alias("duration"),
        F.when((kind == "complete") & (c("n") % 6).isin(1, 2, 3) & (c("n") % 4 != 0), pick(MESSAGES, c("n") % len(MESSAGES))).alias(
            "error_message"
        ),
        F.when(is_step, pick(AUTO_ACTIONS, c("n") % len(AUTO_ACTIONS))).alias("action"),
        F.when(is_step, F.when(c("n") % 5 == 0, "detected").otherwise("captured")).alias("phase"),
        F.when((kind == "run_update") & (c("n") % 4 == 0), F.concat(F.lit("Project "), (c("n") % 7).cast("string"))).alias("project"),
        F.when((kind == "run_update") & (c("n") % 3 == 0), pick(BROWSERS, c("n") % 3)).alias("browser"),
        ((kind == "run_update") & (c("n") % 25 == 0)).alias("reset"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps: test_case, step_no, name, status, action, target, error_message, screenshot."""
    c = F.col
    described = pick(
        ("Step01_Open_Login_Page", "Step02_Input_Username", "Step04_Click_Login", "Check_the_basket", "Open_Page"),
        (c("conv_id") + c("turn")) % 5,
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), c("conv_id").cast("string")).alias("test_case"),
        c("turn").alias("step_no"),
        described.alias("name"),
        F.when((c("conv_id") + c("turn")) % 4 == 0, "FAIL").otherwise("PASS").alias("status"),
        F.when(c("role") == "user", pick(AUTO_ACTIONS, (c("conv_id") + c("turn")) % len(AUTO_ACTIONS))).alias("action"),
        F.when(c("conv_id") % 3 != 0, F.concat(F.lit("selector=#field-"), c("turn").cast("string"))).alias("target"),
        F.when(((c("conv_id") + c("turn")) % 4 == 0) & (c("turn") % 2 == 0), c("text")).alias("error_message"),
        F.when(c("turn") % 2 == 1, F.concat(F.lit("evidence/shot-"), (c("conv_id") % 50).cast("string"), F.lit(".png"))).alias(
            "screenshot"
        ),
    )


SUMMARY_VARIANTS = 40


def _summary_dir(key: str, run_key: Column) -> Column:
    return F.when(F.col(key) % SUMMARY_VARIANTS == 4, F.concat(F.lit("bad "), run_key)).otherwise(run_key)


def orders_by_summary_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the orders of each ``run_dir`` of ``summary_files``."""
    return table(spark, sf_dir, "orders").withColumn("dir", _summary_dir("o_orderkey", _run_key())).dropDuplicates(["dir"])


def summary_files(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Stored summary texts (run_dir, content, read_error), one per order; the key decides what is wrong with each."""
    c = F.col
    r = c("run_id") % SUMMARY_VARIANTS
    base = (
        runs(spark, sf_dir, ("o_custkey",), orders).withColumn("passed", c("o_custkey") % 7)
        .withColumn("failed", c("run_id") % 3)
        .withColumn("skipped", c("o_custkey") % 2)
        .withColumn("timed_out", F.floor(c("run_id") / 3).cast("bigint") % 2)
        .withColumn("interrupted", F.when(c("o_custkey") % 3 == 0, 1).otherwise(0).cast("bigint"))
        .withColumn("total", c("passed") + c("failed") + c("skipped") + c("timed_out") + c("interrupted"))
        .withColumn("rate", F.coalesce(rate(c("passed"), c("total")), F.lit(0.0)))
    )
    has_tests = c("total") > 0

    def at(number: int, value, otherwise) -> Column:
        return F.when(r == number, value).otherwise(otherwise)

    started, ended = iso_text(c("started_at")), iso_text(c("ended_at"))
    duration = F.when(r == 12, 0.0001).when(r == 13, 0.30000000000000004).otherwise(c("total") * 125.5)
    average = F.when(~has_tests, 0.0).when(r == 13, mean(F.lit(0.3), c("total"))).otherwise(125.5)
    migration = F.when(
        r.isin(11, 19),
        F.struct(
            F.concat(F.lit("sha256:"), at(11, F.lit("bad"), F.sha2(c("run_key"), 256))).alias("identity"),
            F.lit("legacy.json").alias("source"),
            F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256)).alias("sourceChecksum"),
        ),
    )
    summary = F.struct(
        at(5, F.concat(c("run_key"), F.lit("x")), c("run_key")).alias("runId"),
        F.when(r == 2, "2.0.0").when(r == 20, "2.x; drop").otherwise("1.0.0").alias("schemaVersion"),
        at(23, F.lit("2024-01-01T00:00:00+00:00"), started).alias("createdAt"),
        at(22, F.lit("2024-02-30T00:00:00Z"), started).alias("timestamp"),
        started.alias("startTime"),
        at(6, F.lit("1990-01-01T00:00:00.000Z"), ended).alias("endTime"),
        (c("total") + at(3, F.lit(1), F.lit(0))).alias("total"),
        c("passed"), c("failed"),
        at(8, F.lit(-1).cast("bigint"), c("skipped")).alias("skipped"),
        c("timed_out").alias("timedOut"), c("interrupted"),
        (c("failed") + c("timed_out") + c("interrupted") + at(27, F.lit(1), F.lit(0))).alias("unsuccessful"),
        F.when(r == 7, 101.0).when(r == 14, c("rate") / 2 + 1).otherwise(c("rate")).alias("passRate"),
        duration.alias("totalDuration"), average.alias("averageDuration"),
        F.when(r != 15, F.coalesce(c("project"), F.lit("none"))).alias("project"),
        c("feature"), c("environment"),
        at(17, F.lit("  "), F.coalesce(c("browser"), F.lit("none"))).alias("browser"),
        c("executed_by").alias("executedBy"),
        F.create_map(at(26, F.lit("__proto__"), F.lit("UNKNOWN_FAILURE")), at(25, F.lit(1.5), c("failed").cast("double"))).alias("failureCategoryCounts"),
        at(21, F.lit(9007199254740992), c("trace_preserved")).alias("traceReportedCount"),
        c("trace_preserved").alias("tracePreservedCount"),
        (c("trace_preserved") + at(28, F.lit(1), F.lit(0))).alias("traceAvailableCount"),
        F.struct(c("has_pdf").alias("pdf"), c("has_dashboard").alias("dashboard"), c("has_evidence").alias("evidence"), c("has_traces").alias("traces")).alias(
            "reportAvailability"
        ),
        migration.alias("migration"),
    )
    base, text = base.withColumn("text", F.to_json(summary)), c("text")
    content = (
        F.when(r.isin(0, 10), None)
        .when(r == 1, "{ broken")
        .when(r == 9, F.regexp_replace(text, r'"passed":(\d+)', '"passed":"$1"'))
        .when(r == 16, F.regexp_replace(text, r'"project":"[^"]*"', '"project":5'))
        .when(r == 24, F.regexp_replace(text, r'"project":"[^"]*"', '"project":null'))
        .when(r == 18, F.regexp_replace(text, r'"pdf":\w+', '"pdf":"yes"'))
        .when(r == 29, F.regexp_replace(text, r'"total":(\d+)', '"total":$1.0'))
        .when(r == 30, "[]")
        .when(r == 31, F.regexp_replace(text, r'"schemaVersion":"1.0.0"', '"schemaVersion":5'))
        .otherwise(text)
    )
    error = F.when(r == 10, F.when(c("run_id") % 80 == 10, "EACCES").otherwise("ESTRANGE"))
    return base.select(_summary_dir("run_id", c("run_key")).alias("run_dir"), content.alias("content"), error.alias("read_error"), "run_id")


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy execution files (name, content, modified_at): bare arrays, wrapped objects and broken texts."""
    c = F.col
    key = c("o_orderkey").cast("string")
    records = F.concat(
        F.lit('[{"testCase":"TC'), key, F.lit('","status":"passed","duration":1.5},{"testCase":"TC2","status":"timedOut","duration":'),
        (c("o_custkey") % 100).cast("string"), F.lit("}]"),
    )
    r = c("o_orderkey") % 6
    content = (
        F.when(r == 0, records)
        .when(r == 1, F.concat(F.lit('{"execution":'), records, F.lit(',"metadata":{"executionStartTime":"2024-03-01T10:00:00+02:00"}}')))
        .when(r == 2, F.concat(F.lit('{"execution":'), records, F.lit("}")))
        .when(r == 3, F.lit("{ broken"))
        .when(r == 4, F.lit('{"metadata":{}}'))
        .otherwise(F.concat(F.lit('{"execution":'), records, F.lit(',"metadata":{"executionStartTime":"yesterday"}}')))
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("legacy-"), key, F.lit(".json")).alias("name"), content.alias("content"), c("o_orderdate").cast("timestamp").alias("modified_at"),
        c("o_orderkey").alias("key"),
    )


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files kept with each run: run_key, path, size, sha256; line items stand for files."""
    c = F.col
    kind = c("l_linenumber") % 4
    name = F.concat_ws("-", c("l_partkey").cast("string"), c("l_suppkey").cast("string"))
    path = (
        F.when(kind == 0, F.concat(F.lit("artifacts/evidence/TC"), (c("l_partkey") % 60).cast("string"), F.lit("/"), c("l_quantity").cast("int").cast("string"),
                                   F.when(c("l_suppkey") % 2 == 0, "_FAILED_").otherwise("_"), name, F.lit(".png")))
        .when(kind == 1, F.concat(F.lit("artifacts/traces/"), name, F.lit(".zip")))
        .when(kind == 2, F.concat(F.lit("artifacts/dashboard/"), name, F.lit(".html")))
        .otherwise(F.concat(F.lit("artifacts/reports/"), name, F.lit(".pdf")))
    )
    size = F.round(c("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("run_key"), path.alias("path"), size.alias("size"), F.sha2(F.concat(path, size.cast("string")), 256).alias("sha256"),
        c("l_linenumber").alias("line"), c("l_partkey").alias("part"),
    )
