"""Root-cause clusters: failure groups of one run merged around leaders.

Groups are taken in list order. A group joins the first leader it is compatible with, or leads a cluster
of its own. Two groups are compatible when they share a suite and also share a source file or an error
type, or differ in category.

Records are reduced to distinct (group, kind, token) rows first. Which groups share a token is then kept
as bit masks over group numbers, so no pair of groups and no set of suites is ever listed. At most 63 groups
of a run meet in one row for the ordered fold; a run with more is taken in rounds over its masks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.fixed_values import CATEGORY_ROOT_CAUSES, ROOT_CAUSES
from runlens.functions import failures as rules
from runlens.functions.numbers import rate
from runlens.functions.text import none_if_empty
from runlens.operators.failures import GROUP_KEY, failed_records
from runlens.session import written

WORD = 63


def group_tests(classified: DataFrame) -> DataFrame:
    """Distinct test names of each group with their number of failures and first position."""
    return failed_records(classified).groupBy(*GROUP_KEY, "test_case").agg(
        F.count("*").alias("failures"), F.min("ordinal").alias("ordinal")
    )


TOKEN_KINDS = ("suite", "stack", "type", "auth", "url")


def _alike_tests(classified: DataFrame) -> DataFrame:
    """Tests of a group that have all tokens in common as one row: least ordinal, failures and a token of each kind.

    A test name stands for the first record of that name in the run, whatever its status.
    """
    # Tests are dealt by the parts of a name that equals a missing one as well, so that first records are joined where they were found.
    named, unnamed = F.coalesce("test_case", F.lit("")), F.col("test_case").isNull()
    first = classified.groupBy(F.col("run_id").alias("first_run"), named.alias("first_test"), unnamed.alias("first_unnamed")).agg(
        F.min_by(F.struct("feature", "message"), F.col("ordinal")).alias("record"), F.bool_or(rules.is_failure(F.col("status"))).alias("fails")
    ).filter("fails")
    same_test = (F.col("run_id") == F.col("first_run")) & (named == F.col("first_test")) & (unnamed == F.col("first_unnamed"))
    members = group_tests(classified)
    message, lower = F.col("record.message"), F.col("folded")

    tokens = {
        "suite": none_if_empty(F.col("record.feature")),
        "stack": rules.stack_origin(message, lower),
        "type": rules.error_type(message, lower),
        "auth": F.when(rules.mentions_auth(message, lower), "yes"),
        "url": F.when(rules.mentions_url_check(message, lower), "yes"),
    }
    return (
        members.join(first, same_test)
        .withColumn("folded", rules.folded(message))
        .select(*GROUP_KEY, "ordinal", "failures", *(value.alias(f"{kind}_token") for kind, value in tokens.items()))
        .groupBy(*GROUP_KEY, *(f"{kind}_token" for kind in tokens))
        .agg(F.min("ordinal").alias("ordinal"), F.sum("failures").alias("failures"))
    )


def _tokens_of(alike: DataFrame) -> DataFrame:
    """One row for each token of a group. The rows travel before they are taken apart, once and not once for each token."""
    listed = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_token").alias("token")) for kind in TOKEN_KINDS))
    return (
        alike.repartition(*GROUP_KEY).select(*GROUP_KEY, "ordinal", "failures", F.explode(listed).alias("t"))
        .filter(F.col("t.token").isNotNull())
        .groupBy(*GROUP_KEY, F.col("t.kind").alias("kind"), F.col("t.token").alias("token"))
        .agg(F.min("ordinal").alias("first_seen"), F.sum("failures").alias("token_failures"))
    )


def group_tokens(classified: DataFrame) -> DataFrame:
    """Distinct suites, source files, error types and message flags of each group."""
    return _tokens_of(_alike_tests(classified))


def numbered_tokens(classified: DataFrame) -> DataFrame:
    """Tokens with zero-based number and occurrences of their group, written once for all later steps.

    Every group has an error type, so the ``type`` rows also list the groups. The tests are written first: what was shuffled to find them
    is gone when the tokens are.
    """
    alike = written(_alike_tests(classified))
    order = Window.partitionBy("run_id").orderBy(F.desc("occurrences"), "category", "signature")
    groups = alike.groupBy(*GROUP_KEY).agg(F.sum("failures").alias("occurrences"), F.min("ordinal").alias("first_ordinal"))
    numbered = groups.withColumn("group_no", (F.row_number().over(order) - 1).cast("int"))
    return written(_tokens_of(alike).join(numbered, list(GROUP_KEY)))


def groups_of(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("kind") == "type").select("run_id", "group_no", "category", "signature", "occurrences").distinct()


def group_profiles(classified: DataFrame) -> DataFrame:
    """Number of distinct suites, source files and error types of each group, and its message flags."""
    kind = F.col("kind")
    return group_tokens(classified).groupBy(*GROUP_KEY).agg(
        F.count_if(kind == "suite").alias("suites"),
        F.count_if(kind == "stack").alias("stack_origins"),
        F.count_if(kind == "type").alias("error_types"),
        F.bool_or(kind == "auth").alias("mentions_auth"),
        F.bool_or(kind == "url").alias("mentions_url_check"),
    )


def compatibility(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """``run_id``, ``group_no``, ``word`` and ``compatible``: a bit for each earlier group of the run that a group is compatible with.

    Bit ``k`` of a word stands for group ``63 * word + k``; words without a bit are left out.
    """
    by_category = groups.select("run_id", "group_no", F.lit("category").alias("kind"), F.col("category").alias("token"))
    shared = tokens.filter(F.col("kind").isin("suite", "stack", "type")).select("run_id", "group_no", "kind", "token")
    placed = shared.unionByName(by_category)
    # Numbers have no gaps, so only runs with more groups than a word has bits have a number beyond it.
    large = groups.filter(F.col("group_no") >= WORD).select("run_id").distinct()
    if large.isEmpty():
        return _within_a_word(placed)
    large = written(large)
    return _within_a_word(placed.join(large, "run_id", "left_anti")).unionByName(_over_words(placed.join(large, "run_id")))


def _compatible() -> Column:
    return F.col("suite").bitwiseAND(F.col("stack").bitwiseOR(F.col("type")).bitwiseOR(F.bitwise_not(F.col("category"))))


def _kinds(mask: Column) -> list[Column]:
    return [F.coalesce(F.bit_or(F.when(F.col("kind") == k, mask)), F.lit(0).cast("bigint")).alias(k) for k in ("suite", "stack", "type", "category")]


def _within_a_word(placed: DataFrame) -> DataFrame:
    """For runs of at most 63 groups: the mask of a token lists the groups that have it, so it need not be joined to them."""
    masks = placed.groupBy("run_id", "kind", "token").agg(F.expr("bit_or(shiftleft(1L, group_no))").alias("mask"))
    holders = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("mask"), i).bitwiseAND(1) == 1)
    # A token that one group has, and the first group of a token, say nothing about earlier groups.
    met = masks.filter(F.bit_count("mask") > 1).select("run_id", "kind", "mask", F.explode(holders).alias("group_no"))
    ahead = met.withColumn("mask", F.expr("mask & (shiftleft(1L, group_no) - 1)")).filter("mask != 0")
    found = ahead.groupBy("run_id", "group_no").agg(*_kinds(F.col("mask"))).withColumn("compatible", _compatible())
    return found.filter("compatible != 0").select("run_id", "group_no", F.lit(0).alias("word"), "compatible")


def _over_words(placed: DataFrame) -> DataFrame:
    token_masks = placed.groupBy("run_id", "kind", "token", F.floor(F.col("group_no") / WORD).cast("int").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, group_no % {WORD}))").alias("mask")
    )
    masks = placed.join(token_masks, ["run_id", "kind", "token"]).groupBy("run_id", "group_no", "word").agg(*_kinds(F.col("mask")))
    base = F.col("word") * WORD
    ahead = F.expr(f"CASE WHEN group_no - word * {WORD} >= {WORD} THEN {(1 << WORD) - 1}L ELSE shiftleft(1L, cast(group_no - word * {WORD} AS int)) - 1 END")
    earlier = masks.filter(base < F.col("group_no")).withColumn("compatible", _compatible().bitwiseAND(ahead))
    return earlier.filter("compatible != 0").select("run_id", "group_no", "word", "compatible")


def compatible_earlier(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group, the ascending numbers of the earlier groups of its run it is compatible with."""
    return _listed(compatibility(tokens, groups))


def _listed(masks: DataFrame) -> DataFrame:
    base = F.col("word") * WORD
    places = F.sequence(base, F.least(base + WORD, F.col("group_no")))
    hits = F.filter(
        places,
        lambda i: (i < F.col("group_no")) & (i < base + WORD)
        & (F.call_function("shiftrightunsigned", F.col("compatible"), i - base).bitwiseAND(1) == 1),
    )
    return masks.withColumn("earlier", hits).groupBy("run_id", "group_no").agg(F.flatten(F.array_sort(F.collect_list("earlier"))).alias("earlier"))


def assign_leaders(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """``leader`` of every group, and its ``number`` among the leaders of the run.

    Runs whose groups fit one word of bits are folded in order, each in a row of at most 63 groups. The others are taken in rounds.
    """
    numbers = groups.select("run_id", "group_no")
    masks = compatibility(tokens, groups)
    large = numbers.filter(F.col("group_no") >= WORD).select("run_id").distinct()
    if large.isEmpty():
        return _by_fold(numbers, masks)
    masks, large = written(masks), written(large)
    small = (numbers.join(large, "run_id", "left_anti"), masks.join(large, "run_id", "left_anti"))
    return _by_fold(*small).unionByName(leaders_in_rounds(numbers.join(large, "run_id"), masks.join(large, "run_id")))


def _bits(groups: DataFrame) -> DataFrame:
    """The groups of each run as bits of words."""
    return groups.groupBy("run_id", F.floor(F.col("group_no") / WORD).cast("int").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, group_no % {WORD}))").alias("bits"))


def leaders_in_rounds(groups: DataFrame, masks: DataFrame) -> DataFrame:
    """As the ordered fold, for runs of any number of groups.

    In each round the open groups that are compatible with no earlier open group become leaders, and the groups compatible with them
    close. A group's leader is chosen at the end, as an earlier one may turn out to be a leader later. Groups meet as bits, so no row
    holds the groups of a run.
    """
    open_, masks, found = written(groups), written(masks), []
    while not open_.isEmpty():
        blocked = masks.join(open_, ["run_id", "group_no"], "left_semi").join(_bits(open_), ["run_id", "word"]).filter(
            F.col("compatible").bitwiseAND(F.col("bits")) != 0).select("run_id", "group_no").distinct()
        leaders = written(open_.join(blocked, ["run_id", "group_no"], "left_anti"))
        found.append(leaders)
        closed = masks.join(_bits(leaders), ["run_id", "word"]).filter(F.col("compatible").bitwiseAND(F.col("bits")) != 0)
        gone = closed.select("run_id", "group_no").union(leaders).distinct()
        open_ = written(open_.join(gone, ["run_id", "group_no"], "left_anti"))
    leaders = reduce(DataFrame.union, found)
    hits = F.col("compatible").bitwiseAND(F.col("bits"))
    lowest = F.bit_count(hits.bitwiseAND(-hits) - 1)
    joined = masks.join(_bits(leaders), ["run_id", "word"]).filter(hits != 0).groupBy("run_id", "group_no").agg(
        F.min(F.col("word") * WORD + lowest).cast("int").alias("leader"))
    order = Window.partitionBy("run_id").orderBy("group_no")
    numbered = leaders.withColumn("number", F.row_number().over(order).cast("bigint")).withColumnRenamed("group_no", "leader")
    led = groups.join(joined, ["run_id", "group_no"], "left").withColumn("leader", F.coalesce("leader", "group_no"))
    return led.join(numbered, ["run_id", "leader"]).select("run_id", "group_no", "leader", "number")


def _by_fold(numbers: DataFrame, masks: DataFrame) -> DataFrame:
    """The fold over the bits of at most 63 groups of a run; ``masks`` have the word 0 alone."""
    zero = F.lit(0).cast("bigint")
    entries = numbers.select("run_id", "group_no", zero.alias("compatible")).unionByName(masks.select("run_id", "group_no", "compatible"))
    listed = entries.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("compatible") == 0, F.col("group_no")))).alias("groups"),
        F.map_from_entries(F.collect_list(F.when(F.col("compatible") != 0, F.struct("group_no", "compatible")))).alias("masks"),
    )
    begin = F.struct(zero.alias("bits"), F.array().cast("array<int>").alias("leaders"))

    def step(done, g):
        hits = F.coalesce(F.try_element_at(F.col("masks"), g), zero).bitwiseAND(done["bits"])
        lowest = F.bit_count(hits.bitwiseAND(-hits) - 1).cast("int")
        bits = F.when(hits != 0, done["bits"]).otherwise(done["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), g)))
        return F.struct(bits.alias("bits"), F.array_append(done["leaders"], F.when(hits != 0, lowest).otherwise(g)).alias("leaders"))

    ordered = F.array_sort(F.array_distinct("leaders"))
    return (
        listed.select("run_id", F.aggregate("groups", begin, step)["leaders"].alias("leaders"))
        .select("run_id", ordered.alias("ordered"), F.posexplode("leaders").alias("group_no", "leader"))
        .select("run_id", "group_no", "leader", F.array_position("ordered", F.col("leader")).alias("number"))
    )


def cluster_id(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("RC-"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def _root_cause(category: Column, signature: Column, auth: Column, url: Column) -> Column:
    cause = F.when(auth, "AUTH_FLOW_REGRESSION")
    for name, value in CATEGORY_ROOT_CAUSES:
        cause = cause.when(category == name, value)
    assertion_on_url = (category == "ASSERTION_FAILURE") & (rules.matches(signature, "url") | url)
    return cause.when(assertion_on_url, "AUTH_FLOW_REGRESSION").otherwise("UNKNOWN_ROOT_CAUSE")


def confidence(signatures: Column, suites: Column, stacks: Column, types: Column, categories: Column, occurrences: Column) -> Column:
    several = occurrences > 1

    def points(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    return (
        points(signatures == 1, 40)
        + points((suites == 1) & several, 20)
        + points((stacks == 1) & several, 20)
        + points((types == 1) & several, 10)
        + points(categories > 1, 10)
    ).cast("bigint")


def confidence_label(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


def _clustered(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with their leader and the failures of their run, and the distinct tokens of each cluster in order of appearance."""
    tokens = numbered_tokens(classified)
    groups = written(groups_of(tokens))
    total = F.sum("occurrences").over(Window.partitionBy("run_id"))
    led = written(groups.withColumn("total_failed", total).join(assign_leaders(tokens, groups), ["run_id", "group_no"]))
    cluster_tokens = (
        tokens.join(led.select("run_id", "group_no", "number"), ["run_id", "group_no"])
        .groupBy("run_id", "number", "kind", "token")
        .agg(F.min(F.struct("group_no", "first_seen")).alias("seen"))
    )
    return led, cluster_tokens


def root_cause_clusters(classified: DataFrame) -> DataFrame:
    """One row per cluster with cause, confidence and share of the run's failures."""
    led, tokens = _clustered(classified)
    first, last = F.col("first_group"), F.col("last_group")
    # The groups of a cluster meet in one list whatever comes before; as rows they are smaller than as lists of one.
    per_cluster = led.repartition("run_id", "number").groupBy("run_id", "number").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min_by(F.struct("category", "occurrences", "signature"), "group_no").alias("first_group"),
        F.max_by(F.struct("category", "occurrences"), "group_no").alias("last_group"),
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("group_no", "signature"))), lambda g: g["signature"])
        ).alias("signatures"),
        F.size(F.collect_set("category")).alias("categories"),
        F.max("total_failed").alias("total_failed"),
    )
    kind = F.col("kind")
    facts = tokens.groupBy("run_id", "number").agg(
        F.count_if(kind == "suite").alias("suites"),
        F.count_if(kind == "stack").alias("stacks"),
        F.count_if(kind == "type").alias("types"),
        F.bool_or(kind == "auth").alias("auth"),
        F.bool_or(kind == "url").alias("url"),
    )
    labels = F.create_map(*[F.lit(v) for name, label, _ in ROOT_CAUSES for v in (name, label)])
    advice = F.create_map(*[F.lit(v) for name, _, text in ROOT_CAUSES for v in (name, text)])
    return (
        per_cluster.join(facts, ["run_id", "number"])
        .withColumn("category", F.when(first["occurrences"] >= last["occurrences"], first["category"]).otherwise(last["category"]))
        .withColumn("root_cause", _root_cause(F.col("category"), first["signature"], F.col("auth"), F.col("url")))
        .withColumn(
            "confidence",
            confidence(F.size("signatures"), F.col("suites"), F.col("stacks"), F.col("types"), F.col("categories"), F.col("occurrences")),
        )
        .select(
            "run_id",
            cluster_id(F.col("number")).alias("cluster_id"),
            "root_cause",
            F.element_at(labels, F.col("root_cause")).alias("label"),
            "confidence",
            confidence_label(F.col("confidence")).alias("confidence_label"),
            "category",
            "occurrences",
            rate(F.col("occurrences"), F.col("total_failed")).alias("percentage"),
            F.array_join("signatures", ", ").alias("signatures"),
            F.col("suites").alias("suite_count"),
            F.element_at(advice, F.col("root_cause")).alias("recommendation"),
        )
    )


def cluster_evidence(classified: DataFrame) -> DataFrame:
    """Evidence of each cluster, one item per row: signatures, first source file, suites."""
    led, tokens = _clustered(classified)
    signatures = led.groupBy("run_id", "number", "signature").agg(F.min("group_no").alias("group_no")).select(
        "run_id", "number", F.lit("signature").alias("kind"), F.concat(F.lit("1 "), "signature", F.lit(" occurrence")).alias("item"),
        "group_no", F.lit(0).cast("bigint").alias("first_seen"),
    )
    stacks = (
        tokens.filter(F.col("kind") == "stack")
        .groupBy("run_id", "number")
        .agg(F.min_by("token", "seen").alias("token"), F.min("seen").alias("seen"))
        .select("run_id", "number", F.lit("stack").alias("kind"), F.concat(F.lit("Common stack origin: "), "token").alias("item"),
                "seen.group_no", "seen.first_seen")
    )
    suites = tokens.filter(F.col("kind") == "suite").select(
        "run_id", "number", F.lit("suite").alias("kind"), F.col("token").alias("item"), "seen.group_no", "seen.first_seen"
    )
    return signatures.unionByName(stacks).unionByName(suites).select(
        "run_id", cluster_id(F.col("number")).alias("cluster_id"), "kind", "item", F.col("group_no").cast("bigint"), "first_seen"
    )


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """Evidence texts of chosen clusters as a list; the suites, distinct names, share one line."""
    ordered = F.array_sort(F.collect_list(F.struct("group_no", "first_seen", "item")))
    texts = evidence.groupBy("run_id", "cluster_id", "kind").agg(F.transform(ordered, lambda e: e["item"]).alias("items"))
    line = F.when(
        F.col("kind") == "suite", F.array(F.concat(F.lit("Affected suites: "), F.array_join("items", ", ")))
    ).otherwise(F.col("items"))
    return texts.groupBy("run_id", "cluster_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", line.alias("lines")))), lambda k: k["lines"])).alias("lines")
    )


def cluster_members(classified: DataFrame) -> DataFrame:
    """The affected tests of each cluster, one row per failed record."""
    led, _ = _clustered(classified)
    keyed = led.select(*GROUP_KEY, F.col("group_no").cast("bigint").alias("group_no"), cluster_id(F.col("number")).alias("cluster_id"))
    return failed_records(classified).join(keyed, list(GROUP_KEY)).select("run_id", "cluster_id", "group_no", "ordinal", "test_case")


def cluster_totals(classified: DataFrame) -> DataFrame:
    """Per run with records: number of clusters, failures in them, coverage and failures outside."""
    failures = classified.groupBy("run_id").agg(F.count_if(rules.is_failure(F.col("status"))).alias("total_failed"))
    clusters = root_cause_clusters(classified).groupBy("run_id").agg(
        F.count("*").alias("clusters"), F.sum("occurrences").alias("clustered")
    )
    clustered = F.coalesce("clustered", F.lit(0).cast("bigint"))
    return failures.join(clusters, "run_id", "left").select(
        "run_id",
        F.coalesce("clusters", F.lit(0).cast("bigint")).alias("total_clusters"),
        clustered.alias("failures_clustered"),
        F.coalesce(rate(clustered, F.col("total_failed")), F.lit(100.0)).alias("coverage"),
        (F.col("total_failed") - clustered).alias("unclustered"),
    )
