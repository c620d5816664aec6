"""Queries over classified failures, groups and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens import fixed_values as V
from runlens.functions import failures as rules
from runlens.functions.text import clean_message
from runlens.operators import clusters, failures
from runlens.plans import sql as S
from runlens.session import written
from runlens.sources import tables


def _classified(spark, sf_dir):
    """Records as completed tests leave them; every 29th is from a recorder that stored no category."""
    completed = failures.complete_categories(failures.classify_failures(tables.executions(spark, sf_dir)))
    return completed.withColumn("stored_category", F.when(F.col("ordinal") % 29 != 0, F.col("stored_category")))


def status_forms(spark, sf_dir):
    status = F.col("status")
    return tables.executions(spark, sf_dir).groupBy("status").agg(F.count("*").alias("records")).select(
        "status",
        rules.canonical_status(status).alias("canonical"),
        rules.step_status(status).alias("step_form"),
        rules.is_failing(status).alias("is_failing"),
        rules.is_failure(status).alias("is_failure"),
        "records",
    )


def clean_messages(spark, sf_dir):
    return (
        tables.executions(spark, sf_dir)
        .filter(F.col("error_message").isNotNull())
        .groupBy("error_message")
        .agg(F.count("*").alias("records"))
        .select(clean_message(F.col("error_message")).alias("message"), "records")
    )


def failure_categories(spark, sf_dir):
    classified = _classified(spark, sf_dir).filter("failing")
    return (
        classified.withColumn("rule", rules.category_rule(F.col("message"), F.col("failure_category"), F.col("folded")))
        .groupBy("failure_category", "rule")
        .agg(F.count("*").alias("records"))
    )


def failure_signatures(spark, sf_dir):
    records = failures.failed_records(_classified(spark, sf_dir))
    return (
        records.withColumn("rule", rules.signature_rule(F.col("message"), F.col("category"), rules.folded(F.col("message"))))
        .groupBy("category", "signature", "rule")
        .agg(F.count("*").alias("records"))
    )


def error_types(spark, sf_dir):
    records = _classified(spark, sf_dir).filter("failing")
    return records.groupBy(rules.error_type(F.col("message"), F.col("folded")).alias("error_type")).agg(F.count("*").alias("records"))


def stack_origins(spark, sf_dir):
    records = _classified(spark, sf_dir).filter("failing")
    return records.groupBy(rules.stack_origin(F.col("message"), F.col("folded")).alias("stack_origin")).agg(F.count("*").alias("records"))


def auth_mentions(spark, sf_dir):
    records = _classified(spark, sf_dir).filter("failing")
    return records.groupBy(
        rules.mentions_auth(F.col("message"), F.col("folded")).alias("mentions_auth"), rules.mentions_url_check(F.col("message"), F.col("folded")).alias("mentions_url_check")
    ).agg(F.count("*").alias("records"))


def failure_group_totals(spark, sf_dir):
    return failures.group_totals(failures.failure_groups(_classified(spark, sf_dir)))


def group_compatibility(spark, sf_dir):
    tokens = clusters.numbered_tokens(_classified(spark, sf_dir))
    return clusters.compatible_earlier(tokens, written(clusters.groups_of(tokens))).select(
        "run_id", F.col("group_no").cast("bigint").alias("group_no"), F.array_join(F.col("earlier").cast("array<string>"), ",").alias("earlier")
    )


def _over_classified(operator):
    return lambda spark, sf_dir: operator(_classified(spark, sf_dir))


QUERIES = {
    "status_forms": status_forms,
    "clean_messages": clean_messages,
    "failure_categories": failure_categories,
    "failure_signatures": failure_signatures,
    "error_types": error_types,
    "stack_origins": stack_origins,
    "auth_mentions": auth_mentions,
    "failure_groups": _over_classified(failures.failure_groups),
    "failure_group_members": _over_classified(failures.failure_group_members),
    "failure_top_groups": _over_classified(failures.top_groups),
    "failure_group_totals": failure_group_totals,
    "failure_distribution": _over_classified(failures.failure_distribution),
    "impacted_suites": _over_classified(failures.impacted_suites),
    "failure_insights": _over_classified(failures.failure_insights),
    "group_profiles": _over_classified(clusters.group_profiles),
    "group_compatibility": group_compatibility,
    "root_cause_clusters": _over_classified(clusters.root_cause_clusters),
    "root_cause_evidence": _over_classified(clusters.cluster_evidence),
    "root_cause_members": _over_classified(clusters.cluster_members),
    "root_cause_totals": _over_classified(clusters.cluster_totals),
}

_AUTH = " OR ".join(S.matches("message", w) for w in V.AUTH_WORDS)
_RANKS = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(V.CATEGORIES))
_KNOWN = "('" + "', '".join(V.CATEGORIES) + "')"
_NUMBER = "regexp_replace(CAST(percentage AS VARCHAR), '\\.0$', '')"

_DISTRIBUTION = f"""
    SELECT run_id, category, n, {S.rate('n', 'total_failed')} AS percentage,
           row_number() OVER (PARTITION BY run_id ORDER BY n DESC, CASE category {_RANKS} END) AS position
    FROM (SELECT run_id, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY run_id) AS total_failed
          FROM failures GROUP BY run_id, category)
    WHERE category IN {_KNOWN}"""

_FIRST = """
    SELECT run_id, test_case, feature AS first_feature, message AS first_message
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, test_case ORDER BY ordinal) AS n FROM classified) WHERE n = 1"""
_MEMBERS = f"""
    SELECT g.run_id, g.category, g.signature, CAST(g.position - 1 AS INTEGER) AS group_no, f.ordinal,
           nullif(first_feature, '') AS suite, {S.stack_origin('first_message')} AS stack, {S.error_type('first_message')} AS type,
           coalesce({_AUTH.replace('message', 'first_message')}, FALSE) AS auth,
           coalesce({S.matches('first_message', 'toHaveURL')}, FALSE) AS url
    FROM failures f JOIN groups g USING (run_id, category, signature) JOIN first_records USING (run_id, test_case)"""
_SETS = """
    SELECT run_id, group_no, category, signature, list(DISTINCT suite) FILTER (suite IS NOT NULL) AS suites,
           list(DISTINCT stack) FILTER (stack IS NOT NULL) AS stacks, list(DISTINCT type) AS types
    FROM members GROUP BY run_id, group_no, category, signature"""
_EARLIER = """
    SELECT b.run_id, b.group_no, list(a.group_no ORDER BY a.group_no) AS earlier
    FROM sets a JOIN sets b ON a.run_id = b.run_id AND a.group_no < b.group_no
    WHERE list_has_any(a.suites, b.suites)
      AND (coalesce(list_has_any(a.stacks, b.stacks), FALSE) OR list_has_any(a.types, b.types) OR a.category <> b.category)
    GROUP BY b.run_id, b.group_no"""
_FOLD = """
    SELECT run_id, 0 AS group_no, 0 AS leader, [0] AS leaders FROM sets WHERE group_no = 0
    UNION ALL
    SELECT run_id, group_no, coalesce(found, group_no), CASE WHEN found IS NULL THEN list_append(leaders, group_no) ELSE leaders END
    FROM (SELECT s.run_id, s.group_no, f.leaders, list_min(list_filter(e.earlier, lambda i: list_contains(f.leaders, i))) AS found
          FROM fold f JOIN sets s ON s.run_id = f.run_id AND s.group_no = f.group_no + 1
          LEFT JOIN earlier e ON e.run_id = s.run_id AND e.group_no = s.group_no)"""
_LED = """
    SELECT f.run_id, f.group_no, f.leader, dense_rank() OVER (PARTITION BY f.run_id ORDER BY f.leader) AS number,
           g.category, g.signature, g.occurrences
    FROM fold f JOIN groups g ON g.run_id = f.run_id AND g.position = f.group_no + 1"""
_ID = "'RC-' || lpad(CAST(number AS VARCHAR), 3, '0')"
_LABELS = " ".join(f"WHEN '{n}' THEN {S.text(label)}" for n, label, _ in V.ROOT_CAUSES)
_ADVICE = " ".join(f"WHEN '{n}' THEN {S.text(a)}" for n, _, a in V.ROOT_CAUSES)
_CAUSES = " ".join(f"WHEN category = '{c}' THEN '{r}'" for c, r in V.CATEGORY_ROOT_CAUSES)
_CLUSTERS = f"""
    SELECT run_id, number, occurrences, category, signatures, n_suites, total_failed,
           CASE WHEN auth THEN 'AUTH_FLOW_REGRESSION' {_CAUSES}
                WHEN category = 'ASSERTION_FAILURE' AND (signatures[1] ILIKE '%url%' OR url) THEN 'AUTH_FLOW_REGRESSION'
                ELSE 'UNKNOWN_ROOT_CAUSE' END AS root_cause,
           CAST((CASE WHEN len(signatures) = 1 THEN 40 ELSE 0 END) + (CASE WHEN n_suites = 1 AND occurrences > 1 THEN 20 ELSE 0 END)
             + (CASE WHEN n_stacks = 1 AND occurrences > 1 THEN 20 ELSE 0 END) + (CASE WHEN n_types = 1 AND occurrences > 1 THEN 10 ELSE 0 END)
             + (CASE WHEN n_categories > 1 THEN 10 ELSE 0 END) AS BIGINT) AS confidence
    FROM (SELECT run_id, number, CAST(sum(occurrences) AS BIGINT) AS occurrences, arg_min(category, group_no) AS category,
                 list_distinct(list(signature)) AS all_signatures,
                 list_transform(list_sort(list_transform(list_distinct(list(signature)),
                    lambda s: {{'at': list_position(list(signature ORDER BY group_no), s), 's': s}})), lambda x: x.s) AS signatures,
                 count(DISTINCT category) AS n_categories
          FROM led GROUP BY run_id, number)
    JOIN (SELECT l.run_id, l.number, count(DISTINCT suite) AS n_suites, count(DISTINCT stack) AS n_stacks, count(DISTINCT type) AS n_types,
                 bool_or(auth) AS auth, bool_or(url) AS url
          FROM led l JOIN members m ON m.run_id = l.run_id AND m.group_no = l.group_no GROUP BY l.run_id, l.number) USING (run_id, number)
    JOIN (SELECT run_id, CAST(sum(occurrences) AS BIGINT) AS total_failed FROM groups GROUP BY run_id) USING (run_id)"""


def _clustered(body: str) -> str:
    out = S.with_ctes(
        ("groups", "classified"), body, first_records=_FIRST, members=_MEMBERS, sets=_SETS, earlier=_EARLIER, fold=_FOLD,
        led=_LED, clusters=_CLUSTERS,
    )
    return out.replace("WITH ", "WITH RECURSIVE ", 1)


def _unclustered(body: str) -> str:
    return S.with_ctes(("groups", "classified"), body, first_records=_FIRST, members=_MEMBERS, sets=_SETS, earlier=_EARLIER)


ORACLES = {
    "status_forms": S.with_ctes("executions", f"""
        SELECT status, {S.canonical('status')} AS canonical,
               CASE WHEN {S.canonical('status')} IN {S.FAILING} THEN 'FAIL' ELSE 'PASS' END AS step_form,
               {S.canonical('status')} IN {S.FAILING} AS is_failing, upper(status) IN {S.FAILURE_SPELLINGS} AS is_failure,
               count(*) AS records
        FROM executions GROUP BY status"""),
    "clean_messages": S.with_ctes("executions", f"""
        SELECT {S.clean('error_message')} AS message, count(*) AS records FROM executions
        WHERE error_message IS NOT NULL GROUP BY error_message"""),
    "failure_categories": S.with_ctes("classified", f"""
        SELECT failure_category, {S.category_rule('message')} AS rule, count(*) AS records FROM classified WHERE failing GROUP BY ALL"""),
    "failure_signatures": S.with_ctes("failures", f"""
        SELECT category, signature, {S.signature('message', 'category', rule=True)} AS rule, count(*) AS records FROM failures GROUP BY ALL"""),
    "error_types": S.with_ctes("classified", f"""
        SELECT {S.error_type('message')} AS error_type, count(*) AS records FROM classified WHERE failing GROUP BY ALL"""),
    "stack_origins": S.with_ctes("classified", f"""
        SELECT {S.stack_origin('message')} AS stack_origin, count(*) AS records FROM classified WHERE failing GROUP BY ALL"""),
    "auth_mentions": S.with_ctes("classified", f"""
        SELECT coalesce({_AUTH}, FALSE) AS mentions_auth, coalesce({S.matches('message', 'toHaveURL')}, FALSE) AS mentions_url_check,
               count(*) AS records FROM classified WHERE failing GROUP BY ALL"""),
    "failure_groups": S.with_ctes("groups", "SELECT run_id, category, signature, occurrences, position FROM groups"),
    "failure_group_members": S.with_ctes("failures", "SELECT run_id, category, signature, ordinal, test_case FROM failures"),
    "failure_top_groups": S.with_ctes("groups", "SELECT run_id, category, signature, occurrences, position FROM groups WHERE position <= 5"),
    "failure_group_totals": S.with_ctes("groups", """
        SELECT run_id, CAST(sum(occurrences) AS BIGINT) AS failures, count(*) AS groups FROM groups GROUP BY run_id"""),
    "failure_distribution": S.with_ctes("failures", f"SELECT run_id, position, category, n, percentage FROM ({_DISTRIBUTION})"),
    "impacted_suites": S.with_ctes("failures", f"""
        SELECT run_id, position, suite, failed_count, {S.rate('failed_count', 'total_failed')} AS percentage
        FROM (SELECT run_id, suite, failed_count, CAST(sum(failed_count) OVER (PARTITION BY run_id) AS BIGINT) AS total_failed,
                     row_number() OVER (PARTITION BY run_id ORDER BY failed_count DESC, first_seen) AS position
              FROM (SELECT run_id, coalesce(nullif(feature, ''), 'Uncategorized') AS suite, count(*) AS failed_count, min(ordinal) AS first_seen
                    FROM failures GROUP BY ALL))
        WHERE position <= 5"""),
    "failure_insights": S.with_ctes("failures", f"""
        SELECT run_id, total_failed, total_failed > 0 AS has_failures,
               CASE WHEN total_failed = 0 OR pass_rate >= 95 THEN 'HEALTHY' WHEN pass_rate >= 80 THEN 'WARNING' ELSE 'CRITICAL' END AS health_status,
               category AS dominant_category, percentage AS dominant_percentage,
               CASE WHEN category IS NULL THEN {S.text(V.NO_FAILURE_ADVICE)}
                    WHEN percentage >= 40 THEN category || ' failures dominate (' || {_NUMBER} || '%). ' ||
                      CASE category {' '.join(f"WHEN '{c}' THEN {S.text(t)}" for c, t, _ in V.CATEGORY_ADVICE)} END
                    ELSE {S.text(V.MIXED_ADVICE)} END AS recommendation,
               CASE WHEN category IS NULL THEN ''
                    WHEN percentage >= 40 THEN CASE category {' '.join(f"WHEN '{c}' THEN {S.text(' | '.join(d))}" for c, _, d in V.CATEGORY_ADVICE)} END
                    ELSE {S.text(' | '.join(V.MIXED_ADVICE_DETAILS))} END AS details
        FROM (SELECT run_id, total_failed, {S.rate('passed', 'total')} AS pass_rate
              FROM (SELECT run_id, count(*) AS total, count(*) FILTER (canonical = 'PASSED') AS passed,
                           count(*) FILTER (upper(status) IN {S.FAILURE_SPELLINGS}) AS total_failed FROM classified GROUP BY run_id))
        LEFT JOIN (SELECT * FROM ({_DISTRIBUTION}) WHERE position = 1) USING (run_id)"""),
    "group_profiles": _unclustered("""
        SELECT run_id, category, signature, count(DISTINCT suite) AS suites, count(DISTINCT stack) AS stack_origins,
               count(DISTINCT type) AS error_types, bool_or(auth) AS mentions_auth, bool_or(url) AS mentions_url_check
        FROM members GROUP BY run_id, category, signature"""),
    "group_compatibility": _unclustered("""
        SELECT run_id, CAST(group_no AS BIGINT) AS group_no, array_to_string(earlier, ',') AS earlier FROM earlier"""),
    "root_cause_clusters": _clustered(f"""
        SELECT run_id, {_ID} AS cluster_id, root_cause, CASE root_cause {_LABELS} END AS label, confidence,
               CASE WHEN confidence >= 80 THEN 'HIGH' WHEN confidence >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label,
               category, occurrences, {S.rate('occurrences', 'total_failed')} AS percentage,
               array_to_string(signatures, ', ') AS signatures, n_suites AS suite_count, CASE root_cause {_ADVICE} END AS recommendation
        FROM clusters"""),
    "root_cause_evidence": _clustered(f"""
        SELECT run_id, {_ID} AS cluster_id, kind, item, CAST(group_no AS BIGINT) AS group_no, first_seen FROM (
          SELECT run_id, number, 'signature' AS kind, '1 ' || signature || ' occurrence' AS item, min(group_no) AS group_no, 0 AS first_seen
          FROM led GROUP BY run_id, number, signature
          UNION ALL
          SELECT run_id, number, 'stack', 'Common stack origin: ' || stack, group_no, ordinal
          FROM (SELECT l.run_id, l.number, m.stack, m.group_no, m.ordinal,
                       row_number() OVER (PARTITION BY l.run_id, l.number ORDER BY m.group_no, m.ordinal) AS n
                FROM led l JOIN members m ON m.run_id = l.run_id AND m.group_no = l.group_no WHERE m.stack IS NOT NULL) WHERE n = 1
          UNION ALL
          SELECT run_id, number, 'suite', suite, group_no, ordinal
          FROM (SELECT l.run_id, l.number, m.suite, m.group_no, m.ordinal,
                       row_number() OVER (PARTITION BY l.run_id, l.number, m.suite ORDER BY m.group_no, m.ordinal) AS n
                FROM led l JOIN members m ON m.run_id = l.run_id AND m.group_no = l.group_no WHERE m.suite IS NOT NULL) WHERE n = 1)"""),
    "root_cause_members": _clustered(f"""
        SELECT run_id, {_ID} AS cluster_id, CAST(group_no AS BIGINT) AS group_no, ordinal, test_case
        FROM led JOIN failures USING (run_id, category, signature)"""),
    "root_cause_totals": _clustered(f"""
        SELECT run_id, coalesce(n, 0) AS total_clusters, coalesce(clustered, 0) AS failures_clustered,
               coalesce({S.rate('coalesce(clustered, 0)', 'total_failed')}, 100.0) AS coverage, total_failed - coalesce(clustered, 0) AS unclustered
        FROM (SELECT run_id, count(*) FILTER (upper(status) IN {S.FAILURE_SPELLINGS}) AS total_failed FROM classified GROUP BY run_id)
        LEFT JOIN (SELECT run_id, count(*) AS n, CAST(sum(occurrences) AS BIGINT) AS clustered FROM clusters GROUP BY run_id) USING (run_id)"""),
}
