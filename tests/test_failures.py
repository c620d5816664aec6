import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import clusters, failures, summaries

SCHEMA = "run_id string, ordinal bigint, test_case string, status string, feature string, error_message string"


def records(spark, rows):
    given = [("r", i, *row) for i, row in enumerate(rows)]
    stored = spark.createDataFrame(given, SCHEMA).withColumn("stored_category", F.lit(None).cast("string"))
    return failures.complete_categories(failures.classify_failures(stored))


def test_groups_trust_the_stored_category(spark):
    rows = [("r", i, f"t{i}", "FAILED", "A", "Timeout 1ms exceeded", c) for i, c in enumerate(["EXTERNAL_FAILURE", None, "", "TIMEOUT_FAILURE", "EXTERNAL_FAILURE"])]
    data = failures.classify_failures(spark.createDataFrame(rows, SCHEMA + ", stored_category string"))
    groups = {r.category: r.occurrences for r in failures.failure_groups(data).collect()}
    assert groups == {"EXTERNAL_FAILURE": 2, "UNKNOWN_FAILURE": 2, "TIMEOUT_FAILURE": 1}
    shares = {r.category: r.percentage for r in failures.failure_distribution(data).collect()}
    assert shares == {"UNKNOWN_FAILURE": 40.0, "TIMEOUT_FAILURE": 20.0}
    completed = {r.category for r in failures.failure_groups(failures.complete_categories(data)).collect()}
    assert completed == {"EXTERNAL_FAILURE", "TIMEOUT_FAILURE"}


def test_groups_count_and_order(spark):
    data = records(spark, [
        ("t1", "FAILED", "A", "Timeout 1ms exceeded"), ("t2", "passed", "A", None), ("t3", "timedOut", "A", "Timeout 2ms exceeded"),
        ("t4", "interrupted", "B", "net::ERR_FAILED"), ("t5", "SKIPPED", "B", "Timeout 2ms exceeded"), ("t6", "FAILED", "B", None),
    ])
    groups = [tuple(r) for r in failures.failure_groups(data).orderBy("position").select("category", "signature", "occurrences").collect()]
    assert groups == [("TIMEOUT_FAILURE", "TIMEOUT", 2), ("NETWORK_FAILURE", "NETWORK_ERROR", 1), ("UNKNOWN_FAILURE", "UNKNOWN_SIGNATURE", 1)]
    members = failures.failure_group_members(data).filter("signature = 'TIMEOUT'").orderBy("ordinal")
    assert [r.test_case for r in members.collect()] == ["t1", "t3"]


def test_suites_keep_first_appearance_on_ties(spark):
    rows = [(f"t{i}", "FAILED", s, "x") for i, s in enumerate(["S3", "S1", "S2", None, "", "S4", "S5", "S1"])]
    top = failures.impacted_suites(records(spark, rows)).orderBy("position").collect()
    assert [(r.suite, r.failed_count) for r in top] == [("S1", 2), ("Uncategorized", 2), ("S3", 1), ("S2", 1), ("S4", 1)]
    assert top[0].percentage == 25.0


def test_insight_texts(spark):
    rows = [("a", "FAILED", "A", "Timeout")] * 2 + [("b", "FAILED", "A", "net::ERR_X")] + [("p", "passed", "A", None)] * 57
    row = failures.failure_insights(records(spark, rows)).first()
    assert row.health_status == "HEALTHY" and row.total_failed == 3
    assert row.recommendation.startswith("TIMEOUT_FAILURE failures dominate (66.67%). Review application response")
    calm = failures.failure_insights(records(spark, [("p", "passed", "A", None)])).first()
    assert (calm.health_status, calm.recommendation, calm.has_failures) == ("HEALTHY", "All tests passed. No issues detected.", False)


def cluster_rows(spark, rows):
    return clusters.root_cause_clusters(records(spark, rows)).orderBy("cluster_id").collect()


def test_cross_category_groups_of_one_suite_merge(spark):
    rows = [("t1", "FAILED", "Login", "locator not found"), ("t2", "FAILED", "Login", "locator not found"), ("t3", "FAILED", "Login", "Timeout 1 ms")]
    found = cluster_rows(spark, rows)
    assert [(r.cluster_id, r.occurrences, r.percentage) for r in found] == [("RC-001", 3, 100.0)]
    assert found[0].signatures == "LOCATOR_NOT_FOUND, TIMEOUT"


def test_other_suites_stay_apart(spark):
    rows = [("t1", "FAILED", "A", "locator not found"), ("t2", "FAILED", "B", "Timeout 1 ms")]
    assert [r.occurrences for r in cluster_rows(spark, rows)] == [1, 1]


def test_confidence(spark):
    stack = "\n    at Page.verify (OrderPage.js:35:14)"
    same = [("t1", "FAILED", "A", "expect(x).toEqual(y)" + stack), ("t2", "FAILED", "A", "expect(x).toEqual(y)" + stack)]
    high = cluster_rows(spark, same)[0]
    assert (high.confidence, high.confidence_label) == (90, "HIGH")
    two = [("t1", "FAILED", "A", "expect(x).toEqual(y)" + stack), ("t2", "FAILED", "A", "expect(x).toContain(y)" + stack)]
    medium = cluster_rows(spark, two)[0]
    assert (medium.confidence, medium.confidence_label) == (50, "MEDIUM")


def test_groups_compare_with_the_leader_only(spark):
    # B shares a suite with A and C, A and C share none: C must not follow B into A's cluster.
    rows = [("a1", "FAILED", "S1", "ECONNREFUSED")] * 3 + [("b1", "FAILED", "S1", "Timeout")] + [("b2", "FAILED", "S2", "Timeout")] + [("c1", "FAILED", "S2", "net::ERR_Z")]
    data = records(spark, [(f"{n}{i}", *rest) for i, (n, *rest) in enumerate(rows)])
    found = clusters.root_cause_clusters(data).orderBy("cluster_id").collect()
    assert [r.occurrences for r in found] == [5, 1]


def test_first_record_of_a_name_speaks_for_all(spark):
    rows = [("same", "passed", "Home", None), ("same", "FAILED", "Cart", "ECONNREFUSED"), ("other", "FAILED", "Home", "Timeout")]
    assert [r.occurrences for r in cluster_rows(spark, rows)] == [2]


def test_many_groups_use_several_mask_words(spark):
    rows = [("r", i, f"t{i}", "FAILED", "S" if i % 2 else "T", "x", f"CAT_{i:03}") for i in range(200)]
    data = spark.createDataFrame(rows, SCHEMA + ", stored_category string").withColumn("message", F.col("error_message"))
    data = data.withColumn("canonical", F.lit("FAILED")).withColumn("failing", F.lit(True)).withColumn("folded", F.col("message"))
    found = clusters.root_cause_clusters(data).collect()
    assert sorted(r.occurrences for r in found) == [100, 100]


def test_evidence(spark):
    rows = [("t1", "FAILED", "B", "ECONNREFUSED\n at x (A.js:1)"), ("t2", "FAILED", "A", "ECONNREFUSED")]
    lines = clusters.evidence_lines(clusters.cluster_evidence(records(spark, rows))).first().lines
    assert lines == ["1 NETWORK_CONNECTION_REFUSED occurrence", "Common stack origin: A.js", "Affected suites: B, A"]


def test_summary_of_live_run(spark):
    data = spark.createDataFrame([("r", 0.1, "PASS", True), ("r", 0.2, "fail", None), ("r", 1.0, "skip", False)],
                                 "run_id string, duration double, status string, trace_available boolean")
    row = summaries.current_summaries(data).first()
    assert (row.total, row.passed, row.failed, row.skipped, row.pass_rate, row.total_duration) == (3, 1, 1, 1, "33.33", 1.3)


def plain_leaders(tokens):
    """Leaders by going through the groups in order; tokens: {group: (category, suites, stacks, types)}."""
    leaders, out = [], {}
    for g in sorted(tokens):
        c, suites, stacks, types = tokens[g]
        fits = [h for h in leaders if suites & tokens[h][1] and (stacks & tokens[h][2] or types & tokens[h][3] or c != tokens[h][0])]
        out[g] = fits[0] if fits else g
        leaders += [] if fits else [g]
    return {g: (leader, leaders.index(leader) + 1) for g, leader in out.items()}


def token_rows(run, tokens):
    return [(run, g, c, f"s{g}", 1, kind, t) for g, (c, *sets) in tokens.items() for kind, values in zip(("suite", "stack", "type"), sets) for t in values]


TOKENS = "run_id string, group_no int, category string, signature string, occurrences bigint, kind string, token string"


@pytest.mark.parametrize("seed", range(3))
def test_leaders_in_rounds_are_those_of_the_fold(spark, seed):
    rng = random.Random(seed)

    def some(name, number, most):
        return {f"{name}{rng.randint(0, number)}" for _ in range(rng.randint(0, most))}

    runs = {f"r{n}": {g: (rng.choice("abc"), some("u", 6, 2), some("k", 20, 2), some("t", 30, 1) | {f"own{g % 90}"}) for g in range(n)} for n in (3, 40, 63, 64, 150)}
    tokens = spark.createDataFrame([row for run, own in runs.items() for row in token_rows(run, own)], TOKENS)
    groups = clusters.groups_of(tokens)
    expected = {(run, g): found for run, own in runs.items() for g, found in plain_leaders(own).items()}
    assert {(r.run_id, r.group_no): (r.leader, r.number) for r in clusters.assign_leaders(tokens, groups).collect()} == expected
    rounds = clusters.leaders_in_rounds(groups.select("run_id", "group_no"), clusters.compatibility(tokens, groups))
    assert {(r.run_id, r.group_no): (r.leader, r.number) for r in rounds.collect()} == expected


def test_groups_of_small_runs_meet_without_a_join(spark):
    tokens = {g: (f"c{g % 2}", {f"u{g % 3}"}, {f"k{g % 4}"}, {f"t{g}"}) for g in range(63)}
    frame = spark.createDataFrame(token_rows("r", tokens), TOKENS)
    masks = clusters.compatibility(frame, clusters.groups_of(frame))
    assert "Join" not in masks._jdf.queryExecution().optimizedPlan().toString()
    got = {r.group_no: r.compatible for r in masks.collect()}
    want = {g: sum(1 << k for k in range(g) if (g - k) % 3 == 0 and ((g - k) % 4 == 0 or (g - k) % 2)) for g in range(63)}
    assert got == {g: m for g, m in want.items() if m}


def test_tokens_travel_in_one_row(spark):
    frame = spark.sql("SELECT 'r' AS run_id, id AS ordinal, concat('t', id % 4) AS test_case, 'FAILED' AS status, concat('F', id % 2) AS feature, "
                      "'fetch failed at a.js:1' AS error_message, 'API_FAILURE' AS stored_category FROM range(8)")
    plan = clusters.group_tokens(failures.classify_failures(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")


def test_a_run_of_thousands_of_foreign_categories(spark):
    tokens = {g: (f"c{g}", {f"u{g % 700}", f"v{g // 1000}"}, {f"k{g % 50}"}, {f"t{g}"}) for g in range(5000)}
    frame = spark.createDataFrame(token_rows("r", tokens), TOKENS)
    found = clusters.assign_leaders(frame, clusters.groups_of(frame))
    assert {r.group_no: (r.leader, r.number) for r in found.collect()} == plain_leaders(tokens)


def test_first_records_are_joined_where_they_were_found(spark):
    """One shuffle of all records, one of failures, and two of the tests of groups; a missing name is not the empty one."""
    data = records(spark, [(None, "FAILED", "A", "net::ERR_X"), ("", "passed", "B", None), ("", "FAILED", "C", "net::ERR_X"), (None, "FAILED", "D", "net::ERR_X"),
                           ("t", "passed", "E", None)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alike = clusters._alike_tests(data)
        assert alike._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        suites = {(r.token, r.first_seen, r.token_failures) for r in clusters.group_tokens(data).where("kind = 'suite'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert suites == {("A", 0, 2), ("B", 2, 1)}
    numbered = clusters.numbered_tokens(data).where("kind = 'type'").collect()
    assert {(r.group_no, r.occurrences, r.first_ordinal) for r in numbered} == {(0, 3, 0)}


def test_clusters_count_categories_in_one_shuffle(spark):
    rows = [("r", i, f"t{i}", "FAILED", "A", "net::ERR_X", c) for i, c in enumerate(["EXTERNAL_FAILURE", "NETWORK_FAILURE", "EXTERNAL_FAILURE"])]
    data = failures.classify_failures(spark.createDataFrame(rows, SCHEMA + ", stored_category string"))
    found = clusters.root_cause_clusters(data)
    assert [(r.occurrences, r.percentage, r.suite_count) for r in found.collect()] == [(3, 100.0, 1)]
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
