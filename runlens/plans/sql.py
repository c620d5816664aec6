"""SQL forms of the table adapters and shared expressions, for checking results with another engine."""

from __future__ import annotations

from runlens import fixed_values as V
from runlens.sources.tables import AUTO_ACTIONS, BROWSERS, MESSAGES, ORIGINS, STATUS_SPELLINGS


def text(value: str | None) -> str:
    """A SQL text literal; control characters are spelled with chr()."""
    if value is None:
        return "NULL"
    parts, plain = [], ""
    for ch in value:
        if ord(ch) < 32 or ord(ch) > 126:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def pick(values, index: str) -> str:
    items = ", ".join(text(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST(({index}) + 1 AS INTEGER)]"


def fixed_text(x: str, digits: int) -> str:
    tie = f"((({x}) * {2 ** (digits + 1)}) % 2.0 = 1)"
    return f"printf('%.{digits}f', CASE WHEN {tie} THEN round({x}, {digits}) ELSE ({x}) END)"


def fixed2(x: str) -> str:
    return f"CAST({fixed_text(x, 2)} AS DOUBLE)"


def fixed2_signed(x: str) -> str:
    size = fixed2(f"abs({x})")
    return f"CASE WHEN ({x}) < 0 AND {size} > 0 THEN -{size} ELSE {size} END"


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 END"


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN {fixed2(f'CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100')} END"


def mean(total: str, count: str) -> str:
    return f"CASE WHEN ({count}) > 0 THEN {fixed2(f'CAST({total} AS DOUBLE) / CAST({count} AS DOUBLE)')} END"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text('(?i)' + pattern)})"


def strip(x: str) -> str:
    return f"trim({x}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


def canonical(status: str) -> str:
    return (
        f"CASE upper(coalesce({status}, '')) WHEN 'PASS' THEN 'PASSED' WHEN 'FAIL' THEN 'FAILED' WHEN 'SKIP' THEN 'SKIPPED' "
        f"WHEN '' THEN 'UNKNOWN' ELSE upper({status}) END"
    )


FAILING = "('" + "', '".join(V.FAILING_STATUSES) + "')"
FAILURE_SPELLINGS = "('" + "', '".join(V.FAILING_STATUS_SPELLINGS) + "')"


def category(x: str) -> str:
    whens = " ".join(
        f"WHEN {matches(x, p)} THEN '{name}'" for name, patterns in V.CATEGORY_RULES for p in patterns
    )
    return f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN 'UNKNOWN_FAILURE' {whens} ELSE 'UNKNOWN_FAILURE' END"


def category_rule(x: str) -> str:
    whens = " ".join(f"WHEN {matches(x, p)} THEN {text(p)}" for _, patterns in V.CATEGORY_RULES for p in patterns)
    return f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN NULL {whens} END"


def signature(x: str, cat: str, rule: bool = False) -> str:
    whens = " ".join(
        f"WHEN {cat} = '{name}' AND {matches(x, p)} THEN {text(p) if rule else text(sig)}"
        for name, rules in V.SIGNATURE_RULES
        for sig, p in rules
    )
    none = "NULL" if rule else "'UNKNOWN_SIGNATURE'"
    return f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN {none} {whens} ELSE {none} END"


def error_type(x: str) -> str:
    whens = " ".join(
        "WHEN " + " AND ".join(matches(x, p) for p in patterns) + f" THEN '{label}'" for label, patterns in V.ERROR_TYPE_RULES
    )
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'UnknownError' {whens} ELSE 'UnknownError' END"


def stack_origin(x: str) -> str:
    frame = f"nullif(regexp_extract({x}, {text('(?i)' + V.STACK_FRAME_PATTERN)}, 1), '')"
    file = f"nullif(regexp_extract({x}, {text('(?i)' + V.STACK_FILE_PATTERN)}, 1), '')"
    return f"coalesce(regexp_replace({frame}, {text('^.*[/' + chr(92) * 2 + ']')}, ''), {file})"


def clean(x: str) -> str:
    plain = f"regexp_replace(nullif({x}, ''), chr(27) || '\\[[0-9;]*m', '', 'g')"
    return strip(f"replace({plain}, chr(13) || chr(10), chr(10))")


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_MESSAGE = f"({pick(MESSAGES, f'l_suppkey % {len(MESSAGES)}')} || {pick(ORIGINS, f'l_partkey % {len(ORIGINS)}')})"

# Named sub-queries; each lists the ones it reads.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "executions": ((), f"""
        SELECT l_orderkey AS run_id,
               l_linenumber * 1000000000000000000 + (l_partkey % 1000000) * 1000000000000 + (l_suppkey % 10000) * 100000000 + {CENTS} % 100000000 AS ordinal,
               'TC' || lpad(CAST(l_partkey % 60 AS VARCHAR), 3, '0') AS test_case,
               CASE WHEN l_returnflag = 'R' THEN {pick(STATUS_SPELLINGS, 'l_linenumber % 4')}
                    WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN 'skipped'
                    WHEN l_linestatus = 'O' THEN 'PASS' ELSE 'passed' END AS status,
               CASE WHEN l_linenumber = 7 AND l_suppkey % 10 = 0 THEN CAST({CENTS} AS DOUBLE) / 100.0
                    ELSE CAST({CENTS} % 1000000 AS DOUBLE) / 1000.0 END AS duration,
               CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 13 = 1 THEN ''
                    ELSE 'Suite ' || CAST(l_partkey % 8 AS VARCHAR) END AS feature,
               CASE WHEN l_returnflag = 'R' AND l_suppkey % 19 <> 0 THEN
                    CASE WHEN l_partkey % 11 = 0 THEN chr(27) || '[31m' || {_MESSAGE} || chr(27) || '[39m' || chr(13) || chr(10)
                         ELSE {_MESSAGE} END END AS error_message,
               CASE WHEN l_returnflag = 'R' AND l_suppkey % 7 = 0 THEN 'EXTERNAL_FAILURE' END AS stored_category,
               CAST(l_partkey % 3 AS BIGINT) AS retry_count,
               CASE WHEN l_linenumber % 3 = 0 THEN TRUE WHEN l_linenumber % 3 = 1 THEN FALSE END AS trace_available,
               CASE WHEN l_suppkey % 10 = 0 THEN {CENTS} % 1024 ELSE {CENTS} END AS trace_size,
               l_partkey || '-' || l_suppkey AS output_dir
        FROM lineitem"""),
    "lifecycle": ((), f"""
        SELECT *, CASE WHEN kind = 'complete' AND n % 6 IN (1, 2, 3) AND n % 4 <> 0 THEN {pick(MESSAGES, f'n % {len(MESSAGES)}')} END AS error_message,
               CASE WHEN kind = 'step' THEN {pick(AUTO_ACTIONS, f'n % {len(AUTO_ACTIONS)}')} END AS action,
               CASE WHEN kind = 'step' THEN CASE WHEN n % 5 = 0 THEN 'detected' ELSE 'captured' END END AS phase,
               CASE WHEN kind = 'complete' THEN {pick(('passed', 'FAIL', 'timedOut', 'interrupted', 'skipped', 'PASS'), 'n % 6')}
                    WHEN kind = 'step' THEN CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END END AS status,
               CASE WHEN kind = 'run_update' AND n % 4 = 0 THEN 'Project ' || (n % 7) END AS project,
               CASE WHEN kind = 'run_update' AND n % 3 = 0 THEN {pick(BROWSERS, 'n % 3')} END AS browser,
               kind = 'run_update' AND n % 25 = 0 AS reset
        FROM (SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, 'T' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS test_case, ts AS event_time,
                     event_id AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS n, event_type, value,
                     CASE event_type WHEN 'signup' THEN 'test_start' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'run_update' ELSE 'step' END AS kind
              FROM events)"""),
    "runs": ((), f"""
        SELECT o_orderkey AS run_id,
               strftime(o_orderdate + to_milliseconds(o_orderkey % 86400000), '%Y%m%d-%H%M%S-%g') || '-' ||
                 lpad(lower(to_hex(o_orderkey // 86400000)), 8, '0') AS run_key,
               o_orderdate + to_milliseconds(o_orderkey % 86400000) AS started_at,
               o_orderdate + to_milliseconds(o_orderkey % 86400000) + to_milliseconds((o_custkey % 7200) * 1000 + o_orderkey % 1000) AS ended_at,
               CASE WHEN o_custkey % 29 <> 0 THEN o_orderpriority END AS project,
               'Area ' || CAST(o_custkey % 9 AS VARCHAR) AS feature,
               o_orderstatus AS environment,
               CASE WHEN o_custkey % 31 <> 0 THEN {pick(BROWSERS, 'o_custkey % 3')} END AS browser,
               'agent-' || CAST(o_custkey % 25 AS VARCHAR) AS executed_by,
               '1.0.0' AS schema_version,
               o_orderkey % 17 = 0 AS migrated,
               o_custkey % 4 AS trace_preserved,
               o_orderkey % 2 = 0 AS has_pdf, o_orderkey % 3 = 0 AS has_dashboard,
               o_orderkey % 5 = 0 AS has_evidence, o_custkey % 4 > 0 AS has_traces
        FROM orders"""),
    "classified": (("executions",), f"""
        SELECT * REPLACE (CASE WHEN ordinal % 29 <> 0 THEN coalesce(nullif(stored_category, ''), failure_category) END AS stored_category)
        FROM (SELECT *, CASE WHEN failing THEN {category('message')} END AS failure_category
              FROM (SELECT *, {clean('error_message')} AS message, {canonical('status')} AS canonical,
                           {canonical('status')} IN {FAILING} AS failing FROM executions))"""),
    "failures": (("classified",), f"""
        SELECT run_id, ordinal, test_case, feature, message, coalesce(stored_category, 'UNKNOWN_FAILURE') AS category,
               {signature('message', "coalesce(stored_category, 'UNKNOWN_FAILURE')")} AS signature
        FROM classified WHERE upper(status) IN {FAILURE_SPELLINGS}"""),
    "groups": (("failures",), """
        SELECT run_id, category, signature, count(*) AS occurrences,
               row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, category, signature) AS position
        FROM failures GROUP BY run_id, category, signature"""),
    "status_counts": (("executions",), f"""
        SELECT run_id, count(*) AS total,
               count(*) FILTER ({canonical('status')} = 'PASSED') AS passed,
               count(*) FILTER ({canonical('status')} = 'FAILED') AS failed,
               count(*) FILTER ({canonical('status')} = 'SKIPPED') AS skipped,
               count(*) FILTER ({canonical('status')} = 'TIMEDOUT') AS timed_out,
               count(*) FILTER ({canonical('status')} = 'INTERRUPTED') AS interrupted,
               sum(CAST(duration AS DECIMAL(19, 3))) AS total_duration,
               count(*) FILTER (trace_available) AS trace_reported
        FROM executions GROUP BY run_id"""),
    "summaries": (("runs", "status_counts"), f"""
        SELECT r.*, epoch_ms(ended_at) - epoch_ms(started_at) AS elapsed_ms,
               coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed,
               coalesce(skipped, 0) AS skipped, coalesce(timed_out, 0) AS timed_out, coalesce(interrupted, 0) AS interrupted,
               coalesce(failed + timed_out + interrupted, 0) AS unsuccessful,
               coalesce(total_duration, 0) AS total_duration, coalesce(trace_reported, 0) AS trace_reported
        FROM runs r LEFT JOIN status_counts USING (run_id)"""),
}


def with_ctes(names: tuple[str, ...] | str, body: str, **more: str) -> str:
    """``body`` behind the named sub-queries and all they read; further ones by keyword."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in (names,) if isinstance(names, str) else names:
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
