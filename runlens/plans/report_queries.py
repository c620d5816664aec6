"""Queries over lifecycle events, API calls, steps and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens import fixed_values as V
from runlens.functions import text as T
from runlens.functions.times import iso_text
from runlens.operators import failures, lifecycle, reports, summaries
from runlens.plans import sql as S
from runlens.plans.api_sql import CALLS_SQL, KEPT_SQL, STATIC_SQL
from runlens.plans.metric_queries import duration_text
from runlens.sources import tables


def _events(spark, sf_dir):
    return tables.lifecycle_events(spark, sf_dir)


def _folded(spark, sf_dir):
    return lifecycle.fold_attempts(_events(spark, sf_dir))


def lifecycle_attempts(spark, sf_dir):
    rows = lifecycle.attempts(_folded(spark, sf_dir))
    return rows.withColumns({n: iso_text(F.col(n)) for n in ("started_at", "finished_at")})


def lifecycle_records(spark, sf_dir):
    rows = lifecycle.test_records(_folded(spark, sf_dir))
    return rows.withColumn("execution_date", iso_text(F.col("execution_date"))).drop("was_running")


def lifecycle_open_records(spark, sf_dir):
    return lifecycle.test_records(_folded(spark, sf_dir), finished=False).groupBy("status").agg(F.count("*").alias("records"))


def completion_categories(spark, sf_dir):
    return lifecycle.completion_categories(_events(spark, sf_dir), lifecycle.test_records(_folded(spark, sf_dir)))


def run_metadata(spark, sf_dir):
    rows = lifecycle.run_metadata(_events(spark, sf_dir))
    return rows.withColumn("execution_start", iso_text(F.col("execution_start")))


def run_updates(spark, sf_dir):
    """All fields of the run metadata, from updates that give one or the other."""
    c = F.col
    update, n = c("kind") == "run_update", c("seq")
    events = (
        _events(spark, sf_dir).withColumn("feature", F.when(update & (n % 5 == 0), F.concat(F.lit("Area "), (n % 6).cast("string"))))
        .withColumn("environment", F.when(update & (n % 6 == 0), F.concat(F.lit("Env "), (n % 4).cast("string"))))
        .withColumn("executed_by", F.when(update & (n % 7 == 0), F.concat(F.lit("agent-"), (n % 9).cast("string"))))
        .withColumn("run_status", F.when(update & (n % 11 == 0), tables.pick(("RUNNING", "PASSED", "FAILED"), n % 3)))
    )
    rows = lifecycle.run_metadata(events)
    return rows.select("run_id", "feature", "environment", "executed_by", "run_status", iso_text(c("execution_end")).alias("execution_end"), "updates")


def trace_times(spark, sf_dir):
    """Trace archives with the time of their last change."""
    modified = F.timestamp_millis(F.lit(1700000000000) + F.col("size") * 1000)
    found = reports.detect_traces(tables.executions(spark, sf_dir), _trace_files(spark, sf_dir).withColumn("modified_at", modified))
    return found.select("run_id", "ordinal", "trace_file", iso_text(F.col("trace_modified")).alias("trace_modified"))


def automation_health(spark, sf_dir):
    events = _events(spark, sf_dir)
    records = lifecycle.test_records(lifecycle.fold_attempts(events)).withColumn("trace_available", F.lit(None).cast("boolean"))
    counts = summaries.status_counts(records)
    rated = counts.withColumn("pass_rate", F.coalesce(summaries.rate(F.col("passed"), F.col("total")), F.lit(0.0)))
    return summaries.automation_health(rated, lifecycle.run_coverage(events))


def api_activity(spark, sf_dir):
    return reports.api_activity(tables.executions(spark, sf_dir), tables.api_calls(spark, sf_dir))


def recent_failures(spark, sf_dir):
    return reports.recent_failures(failures.classify_failures(tables.executions(spark, sf_dir)))


def _trace_files(spark, sf_dir):
    files = tables.artifact_files(spark, sf_dir).filter(F.contains("path", F.lit("/traces/")))
    return files.select(F.col("run_key").alias("run_id"), F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("output_dir"), "path", "size")


def trace_lookup(spark, sf_dir):
    return reports.detect_traces(tables.executions(spark, sf_dir), _trace_files(spark, sf_dir))


def trace_counts(spark, sf_dir):
    return reports.trace_counts(tables.executions(spark, sf_dir), _trace_files(spark, sf_dir))


def _described(spark, sf_dir):
    return reports.describe_steps(tables.steps(spark, sf_dir), reports.step_descriptions(spark, tables.STEP_DESCRIPTIONS))


def failed_test_analysis(spark, sf_dir):
    return reports.failed_test_analysis(_described(spark, sf_dir))


def step_screenshots(spark, sf_dir):
    steps = tables.steps(spark, sf_dir)
    kept = steps.filter(F.col("test_case").rlike("[02468]$")).select(F.col("screenshot").alias("path")).filter(F.col("path").isNotNull())
    return reports.with_existing_file(steps, kept, "screenshot").select("test_case", "step_no", "screenshot")


SELECTORS = (
    ('[aria-label="{}"]', "a"), ("label='{}'", "b"), ("#{}", "c"), ("[data-test={}]", "d"), (".{}", "e"), ("text={}", "f"),
    ("[name={}]", "g"), ("{}", "h"), ("div > {}", "i"), ('[placeholder="{}"]', "j"),
)
FACTORIES = ("locator", "getByRole", "getByText", "getByTestId", "getByLabel")


def _shaped(index, value):
    shapes = [F.concat(F.lit(s.split("{}")[0]), value, F.lit(s.split("{}")[1])) for s, _ in SELECTORS]
    return F.element_at(F.array(*shapes), (index % len(SELECTORS) + 1).cast("int"))


def step_names(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).when(key % 3 == 1, F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    factory = tables.pick(FACTORIES, key % len(FACTORIES))
    selector = F.when(factory == "locator", _shaped(key, name)).when(factory == "getByRole", "button").otherwise(name)
    target = T.target_from_factory(factory, selector, F.when(key % 2 == 0, name))
    chain = F.when(key % 4 == 0, F.array(F.struct(F.lit("first").alias("method"), F.lit(None).cast("string").alias("value")),
                                        F.struct(F.lit("nth").alias("method"), (key % 9).cast("string").alias("value"))))
    action = tables.pick(tables.AUTO_ACTIONS, key % len(tables.AUTO_ACTIONS))
    return tables.table(spark, sf_dir, "part").withColumn("target", target).select(
        "p_partkey", T.step_name(action, F.col("target"), _shaped(key + 2, name), F.lit("#basket-area")).alias("step_name"),
        T.target_text(F.col("target"), chain).alias("target_text"),
    )


def safe_names(spark, sf_dir):
    raw = F.concat(F.lit(" /"), "p_brand", F.lit(": "), "p_name", F.lit("! "))
    return tables.table(spark, sf_dir, "part").select("p_partkey", T.safe_name(raw).alias("safe_name"), T.title_case(F.col("p_type")).alias("title"))


QUERIES = {
    "lifecycle_attempts": lifecycle_attempts,
    "lifecycle_records": lifecycle_records,
    "lifecycle_open_records": lifecycle_open_records,
    "lifecycle_steps": lambda spark, sf_dir: lifecycle.step_numbers(_events(spark, sf_dir)),
    "completion_categories": completion_categories,
    "capture_coverage": lambda spark, sf_dir: lifecycle.capture_coverage(_events(spark, sf_dir)),
    "capture_top_actions": lambda spark, sf_dir: lifecycle.top_actions(_events(spark, sf_dir)),
    "run_metadata": run_metadata,
    "run_updates": run_updates,
    "trace_times": trace_times,
    "automation_health": automation_health,
    "api_log": lambda spark, sf_dir: reports.api_log(tables.api_calls(spark, sf_dir)),
    "api_recorded": lambda spark, sf_dir: reports.recorded_calls(tables.api_calls(spark, sf_dir), tables.API_INCLUDE).select("seq", "url"),
    "api_activity": api_activity,
    "test_case_table": lambda spark, sf_dir: reports.test_case_table(tables.executions(spark, sf_dir)),
    "slowest_tests": lambda spark, sf_dir: summaries.slowest_tests(tables.executions(spark, sf_dir)),
    "recent_failures": recent_failures,
    "trace_table": lambda spark, sf_dir: reports.trace_table(tables.executions(spark, sf_dir)),
    "trace_overview": lambda spark, sf_dir: reports.trace_overview(tables.executions(spark, sf_dir)),
    "trace_lookup": trace_lookup,
    "trace_counts": trace_counts,
    "step_summary": _described,
    "failed_test_analysis": failed_test_analysis,
    "step_screenshots": step_screenshots,
    "step_names": step_names,
    "safe_names": safe_names,
}

_EVENTS = f"""
    SELECT *, {S.canonical('status')} AS canonical, {S.clean('error_message')} AS message,
           count(*) FILTER (kind = 'test_start') OVER (PARTITION BY run_id, test_case ORDER BY event_time, seq) AS attempt,
           CASE WHEN kind = 'test_start' THEN CAST(n % 3 AS BIGINT) END AS retry
    FROM lifecycle WHERE kind IN ('test_start', 'step', 'complete')"""
_FOLDED = f"""
    SELECT run_id, test_case, attempt, min(event_time) FILTER (kind = 'test_start') AS started_at, max(retry) AS retry,
           count(*) FILTER (kind = 'step') AS steps, count(*) FILTER (kind = 'step' AND status = 'FAIL') AS failed_steps,
           arg_max(canonical, seq) FILTER (kind = 'complete') AS status, arg_max(value, seq) FILTER (kind = 'complete') AS duration,
           arg_max(message, seq) FILTER (kind = 'complete' AND message IS NOT NULL) AS error_message,
           arg_max({S.category('message')}, seq) FILTER (kind = 'complete' AND canonical IN {S.FAILING}) AS category,
           max(event_time) FILTER (kind = 'complete') AS finished_at, min(event_time) AS first_event
    FROM numbered GROUP BY run_id, test_case, attempt"""
_RECORDS = f"""
    SELECT run_id, test_case, coalesce(status, 'FAILED') AS status, coalesce(duration, 0.0) AS duration,
           CASE WHEN status IS NULL THEN coalesce(error_message, {S.text(V.UNFINISHED_MESSAGE)}) ELSE error_message END AS error_message,
           CASE WHEN status IS NULL THEN 'TIMEOUT_FAILURE' ELSE any_category END AS failure_category, attempts,
           coalesce(retry, 0) AS retry_count, steps, coalesce(started_at, first_event) AS executed_at, status IS NULL AS was_running
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, test_case ORDER BY attempt DESC) AS back FROM folded)
    JOIN (SELECT run_id, test_case, count(*) FILTER (attempt > 0) AS attempts, arg_max(category, attempt) FILTER (category IS NOT NULL) AS any_category
          FROM folded GROUP BY run_id, test_case) USING (run_id, test_case) WHERE back = 1"""


def lifecycle_sql(body):
    return S.with_ctes("lifecycle", body, numbered=_EVENTS, folded=_FOLDED, records=_RECORDS)


_MISSED = "greatest(0, detected - captured) AS missed, " + f"coalesce({S.rate('captured', 'detected')}, 0.0) AS capture_rate"
_REST = "regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"
_ENDPOINT = f"""CASE WHEN regexp_matches(url, '^[a-z]+://[^ ]+$') THEN left(CASE WHEN {_REST} = '' THEN '/' ELSE {_REST} END, 90) ELSE left(url, 90) END"""
_SIZE = f"""CASE WHEN trace_size < 1024 THEN trace_size || ' B' WHEN trace_size < 1048576 THEN {S.fixed_text('CAST(trace_size AS DOUBLE) / 1024', 1)} || ' KB'
    ELSE {S.fixed_text('CAST(trace_size AS DOUBLE) / 1048576', 1)} || ' MB' END"""
_TRACES = f"""
    SELECT l_orderkey AS run_id, l_partkey || '-' || l_suppkey AS output_dir, 'artifacts/traces/' || l_partkey || '-' || l_suppkey || '.zip' AS path,
           {S.CENTS} AS size FROM lineitem WHERE l_linenumber % 4 = 1"""
_STEPS = f"""
    SELECT *, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
           CASE WHEN role = 'user' THEN {S.pick(tables.AUTO_ACTIONS, f'(conv_id + turn) % {len(tables.AUTO_ACTIONS)}')} END AS action,
           CASE WHEN conv_id % 3 <> 0 THEN 'selector=#field-' || turn END AS target,
           CASE WHEN (conv_id + turn) % 4 = 0 AND turn % 2 = 0 THEN text END AS error_message,
           CASE WHEN turn % 2 = 1 THEN 'evidence/shot-' || (conv_id % 50) || '.png' END AS screenshot, replace(name, '_', ' ') AS plain
    FROM (SELECT *, 'conv-' || conv_id AS test_case, turn AS step_no,
                 {S.pick(('Step01_Open_Login_Page', 'Step02_Input_Username', 'Step04_Click_Login', 'Check_the_basket', 'Open_Page'), '(conv_id + turn) % 5')} AS name
          FROM conversations)"""


def _described_as(index, fallback):
    return "CASE name " + " ".join(f"WHEN '{r[0]}' THEN {S.text(r[index])}" for r in tables.STEP_DESCRIPTIONS) + f" ELSE {fallback} END"


_TITLE = _described_as(1, "plain")
_DESCRIBED = f"""
    SELECT name, test_case, step_no, action, target, error_message, screenshot, status, {_TITLE} AS title,
           CASE WHEN action IS NOT NULL THEN 'Perform ' || action || ' on ' || coalesce(target, 'element') || '.' ELSE {_described_as(2, "'Execute ' || plain || '.'")} END AS action_text,
           CASE WHEN action IS NOT NULL THEN {_TITLE} || ' action completes successfully.' ELSE {_described_as(3, "plain || ' completes successfully.'")} END AS expected,
           coalesce(nullif(error_message, ''), {_TITLE} || ' ' || lower(status) || '.') AS actual
    FROM steps"""


def _title_sql(x):
    spaced = f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')"
    words = f"string_split(trim(regexp_replace({spaced}, '\\s+', ' ', 'g')), ' ')"
    lead = "regexp_extract(w, '^([^A-Za-z0-9_]*)', 1)"
    return f"array_to_string(list_transform({words}, lambda w: {lead} || upper(w[len({lead}) + 1]) || lower(w[len({lead}) + 2:])), ' ')"


def _selector_sql(x):
    found = ", ".join(f"nullif(regexp_extract({x}, {S.text(p)}, 1), '')" for p in V.SELECTOR_NAME_PATTERNS)
    return f"coalesce({_title_sql(f'coalesce({found}, CASE WHEN regexp_matches({x}, {S.text('^[A-Za-z]+$')}) THEN {x} END)')}, '')"


def _shape_sql(index):
    shapes = ", ".join(f"{S.text(s.split('{}')[0])} || name || {S.text(s.split('{}')[1])}" for s, _ in SELECTORS)
    return f"([{shapes}])[CAST({index} % {len(SELECTORS)} + 1 AS INTEGER)]"


_PARTS = f"""
    SELECT *, CASE factory WHEN 'locator' THEN {_shape_sql('p_partkey')} WHEN 'getByRole' THEN 'button' ELSE name END AS selector,
           {_shape_sql('(p_partkey + 2)')} AS drag_from
    FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-')
                  WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') ELSE p_name END AS name,
                 {S.pick(FACTORIES, 'p_partkey % 5')} AS factory, {S.pick(tables.AUTO_ACTIONS, f'p_partkey % {len(tables.AUTO_ACTIONS)}')} AS action FROM part)"""
_READABLE = f"""CASE WHEN factory = 'getByRole' THEN CASE WHEN p_partkey % 2 = 0 THEN {_title_sql('name')} ELSE 'Button' END
    WHEN factory = 'locator' THEN {_selector_sql('selector')} ELSE {_title_sql('selector')} END"""

ORACLES = {
    "lifecycle_attempts": lifecycle_sql(f"""
        SELECT run_id, test_case, attempt, retry + 1 AS attempt_number, retry, steps, failed_steps,
               CASE WHEN ended THEN 'FAILED' ELSE coalesce(status, 'RUNNING') END AS status, coalesce(duration, 0.0) AS duration,
               CASE WHEN ended THEN coalesce(error_message, {S.text(V.UNFINISHED_MESSAGE)}) ELSE error_message END AS error_message,
               {S.iso('started')} AS started_at, {S.iso('CASE WHEN ended THEN run_end ELSE finished END')} AS finished_at
        FROM (SELECT *, started_at AS started, finished_at AS finished, status IS NULL AND attempt = max(attempt) OVER (PARTITION BY run_id, test_case) AS ended
              FROM folded JOIN (SELECT run_id, max(event_time) AS run_end FROM numbered GROUP BY run_id) USING (run_id))
        WHERE attempt > 0"""),
    "lifecycle_records": lifecycle_sql(f"""
        SELECT run_id, test_case, status, duration, error_message, failure_category, attempts, retry_count, steps, {S.iso('executed_at')} AS execution_date
        FROM records"""),
    "lifecycle_open_records": lifecycle_sql("""
        SELECT CASE WHEN was_running THEN 'RUNNING' ELSE status END AS status, count(*) AS records FROM records GROUP BY ALL"""),
    "lifecycle_steps": S.with_ctes("lifecycle", """
        SELECT run_id, test_case, row_number() OVER (PARTITION BY run_id, test_case ORDER BY event_time, seq) AS step_no, seq, action, status, value AS duration
        FROM lifecycle WHERE kind = 'step'"""),
    "completion_categories": lifecycle_sql(f"""
        SELECT run_id, category, count(*) AS failures FROM (
          SELECT run_id, {S.category('message')} AS category FROM numbered WHERE kind = 'complete' AND canonical IN {S.FAILING}
          UNION ALL SELECT run_id, 'TIMEOUT_FAILURE' FROM records WHERE was_running) GROUP BY ALL"""),
    "capture_coverage": S.with_ctes("lifecycle", f"""
        SELECT run_id, action, is_total, detected, captured, {_MISSED} FROM (
          SELECT run_id, action, grouping(action) = 1 AS is_total, count(*) AS detected, count(*) FILTER (phase = 'captured') AS captured
          FROM lifecycle WHERE action IS NOT NULL GROUP BY GROUPING SETS ((run_id, action), (run_id)))"""),
    "capture_top_actions": S.with_ctes("lifecycle", """
        SELECT run_id, position, action, captured, detected FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY captured DESC, first_seq) AS position FROM (
            SELECT run_id, action, count(*) AS detected, count(*) FILTER (phase = 'captured') AS captured, min(seq) AS first_seq
            FROM lifecycle WHERE action IS NOT NULL GROUP BY run_id, action)) WHERE position <= 5"""),
    "run_metadata": S.with_ctes("lifecycle", f"""
        SELECT run_id, project, browser, {S.iso('start')} AS execution_start, updates FROM (
          SELECT run_id, arg_max(project, seq) FILTER (project IS NOT NULL) AS project, arg_max(browser, seq) FILTER (browser IS NOT NULL) AS browser,
                 coalesce(max(event_time) FILTER (reset), min(event_time)) AS start, count(*) AS updates
          FROM lifecycle WHERE kind = 'run_update' GROUP BY run_id)"""),
    "run_updates": S.with_ctes("lifecycle", f"""
        SELECT run_id, feature, environment, executed_by, run_status, CASE WHEN run_status <> 'RUNNING' THEN {S.iso('ended')} END AS execution_end, updates FROM (
          SELECT run_id, arg_max('Area ' || (seq % 6), seq) FILTER (seq % 5 = 0) AS feature, arg_max('Env ' || (seq % 4), seq) FILTER (seq % 6 = 0) AS environment,
                 arg_max('agent-' || (seq % 9), seq) FILTER (seq % 7 = 0) AS executed_by,
                 arg_max({S.pick(('RUNNING', 'PASSED', 'FAILED'), 'seq % 3')}, seq) FILTER (seq % 11 = 0) AS run_status,
                 max(event_time) FILTER (seq % 11 = 0) AS ended, count(*) AS updates
          FROM lifecycle WHERE kind = 'run_update' GROUP BY run_id)"""),
    "automation_health": lifecycle_sql(f"""
        SELECT run_id, CASE WHEN failed > passed THEN 'critical' WHEN ok THEN 'healthy' ELSE 'attention' END AS health,
               CASE WHEN failed > passed THEN 'Critical Issues Detected' WHEN ok THEN 'Healthy Run' ELSE 'Attention Required' END AS heading,
               CASE WHEN failed > passed THEN 'Multiple failures require investigation.' WHEN ok THEN 'All tests passed. | Auto-capture coverage is excellent.'
                    ELSE array_to_string(list_filter([CASE WHEN failed > 0 THEN failed || ' failed test' || CASE WHEN failed <> 1 THEN 's' ELSE '' END || ' detected.' END,
                         CASE WHEN pass_rate < 95 THEN 'Pass rate below target.' END, CASE WHEN capture_rate < 95 THEN 'Coverage below target.' END], lambda x: x IS NOT NULL), ' | ') END AS reasons
        FROM (SELECT *, failed = 0 AND pass_rate >= 95 AND capture_rate >= 95 AS ok FROM (
          SELECT run_id, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PASSED') AS passed,
                 {S.rate("count(*) FILTER (status = 'PASSED')", 'count(*)')} AS pass_rate FROM records GROUP BY run_id)
          JOIN (SELECT run_id, {S.rate("count(*) FILTER (phase = 'captured')", 'count(*)')} AS capture_rate FROM lifecycle WHERE action IS NOT NULL GROUP BY run_id) USING (run_id))"""),
    "api_log": S.with_ctes((), f"SELECT * FROM calls WHERE {KEPT_SQL}", calls=CALLS_SQL),
    "api_recorded": S.with_ctes((), f"""
        SELECT seq, url FROM calls WHERE ({' OR '.join(f"contains(url, '{p}')" for p in tables.API_INCLUDE)}) AND NOT {STATIC_SQL}""", calls=CALLS_SQL),
    "api_activity": S.with_ctes("executions", f"""
        SELECT e.run_id, e.test_case, e.ordinal, k.seq, k.method, k.endpoint, k.http_status, k.time FROM executions e
        LEFT JOIN (SELECT run_id, test_case, seq, method, {_ENDPOINT} AS endpoint, CAST(status AS VARCHAR) AS http_status,
                          {duration_text('CAST(duration AS DOUBLE)')} AS time FROM calls WHERE {KEPT_SQL}) k USING (run_id, test_case)""", calls=CALLS_SQL),
    "test_case_table": S.with_ctes("executions", f"""
        SELECT run_id, ordinal, test_case, coalesce(nullif(feature, ''), '-') AS feature, {S.canonical('status')} AS status,
               {duration_text('e.duration')} AS duration, retry_count AS retries FROM executions e"""),
    "slowest_tests": S.with_ctes("executions", f"""
        SELECT run_id, position, test_case, duration, {duration_text('duration')} AS duration_text FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration DESC, ordinal) AS position FROM executions WHERE duration > 0) WHERE position <= 5"""),
    "recent_failures": S.with_ctes("classified", """
        SELECT run_id, ordinal, test_case, failure_category AS category, coalesce(nullif(c.message, ''), 'No error message captured.') AS message
        FROM classified c WHERE failing"""),
    "trace_table": S.with_ctes("executions", f"SELECT run_id, ordinal, test_case, {_SIZE} AS size, output_dir AS location FROM executions WHERE trace_available"),
    "trace_overview": S.with_ctes("executions", """
        SELECT run_id, count(*) FILTER (trace_available) AS with_trace, count(*) FILTER (NOT trace_available) AS without_trace,
               count(*) FILTER (trace_available IS NULL) AS unknown FROM executions GROUP BY run_id"""),
    "trace_lookup": S.with_ctes("executions", """
        SELECT e.run_id, e.ordinal, e.test_case, t.path IS NOT NULL AS trace_available, t.path AS trace_file, t.size AS trace_size FROM executions e
        LEFT JOIN (SELECT run_id, output_dir, max(path) AS path, max(size) AS size FROM traces GROUP BY ALL) t USING (run_id, output_dir)""", traces=_TRACES),
    "trace_times": S.with_ctes("executions", f"""
        SELECT e.run_id, e.ordinal, t.path AS trace_file, {S.iso('make_timestamp((1700000000000 + t.size * 1000) * 1000)')} AS trace_modified FROM executions e
        LEFT JOIN (SELECT run_id, output_dir, max(path) AS path, max(size) AS size FROM traces GROUP BY ALL) t USING (run_id, output_dir)""", traces=_TRACES),
    "trace_counts": S.with_ctes("executions", """
        SELECT run_id, reported, coalesce(preserved, 0) AS preserved FROM (SELECT run_id, count(*) FILTER (trace_available) AS reported FROM executions GROUP BY run_id)
        LEFT JOIN (SELECT run_id, count(DISTINCT path) AS preserved FROM traces GROUP BY run_id) USING (run_id)""", traces=_TRACES),
    "step_summary": S.with_ctes((), _DESCRIBED, steps=_STEPS),
    "failed_test_analysis": S.with_ctes((), """
        SELECT test_case, step_no, title AS failed_step, coalesce(error_message, 'N/A') AS error_message, screenshot FROM (
          SELECT *, row_number() OVER (PARTITION BY test_case ORDER BY step_no) AS n FROM described WHERE status = 'FAILED') WHERE n = 1""",
        steps=_STEPS, described=_DESCRIBED),
    "step_screenshots": S.with_ctes((), """
        SELECT test_case, step_no, screenshot FROM steps WHERE screenshot IN (SELECT screenshot FROM steps WHERE conv_id % 2 = 0 AND screenshot IS NOT NULL)""", steps=_STEPS),
    "step_names": S.with_ctes((), f"""
        SELECT p_partkey, CASE action WHEN 'dragAndDrop' THEN 'Drag ' || coalesce(nullif({_selector_sql('drag_from')}, ''), 'Element') || ' To Basket Area'
                 WHEN 'setInputFiles' THEN 'Upload ' || CASE WHEN factory = 'getByRole' THEN 'File' ELSE coalesce(nullif({_selector_sql('selector')}, ''), 'File') END
                 ELSE CASE action WHEN 'dblclick' THEN 'Double Click' ELSE {_title_sql('action')} END || ' ' || coalesce(nullif({_READABLE}, ''), 'Element') END AS step_name,
               CASE factory WHEN 'getByRole' THEN 'role=button' || CASE WHEN p_partkey % 2 = 0 THEN ' name=' || name ELSE '' END
                    ELSE CASE factory WHEN 'getByText' THEN 'text' WHEN 'getByTestId' THEN 'testId' WHEN 'getByLabel' THEN 'label' ELSE 'selector' END || '=' || selector END
               || CASE WHEN p_partkey % 4 = 0 THEN '.first().nth(' || (p_partkey % 9) || ')' ELSE '' END AS target_text
        FROM parts""", parts=_PARTS),
    "safe_names": f"""
        SELECT p_partkey, trim(regexp_replace(' /' || p_brand || ': ' || p_name || '! ', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS safe_name, {_title_sql('p_type')} AS title FROM part""",
}
