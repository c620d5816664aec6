"""Failure analysis per run: classification, groups, distribution, suites and insight.

A run may hold a large part of all records. Every result here is an aggregate with partial sums before
the shuffle or a top-k whose candidates are limited before the shuffle; lists of tests stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.fixed_values import (
    CATEGORIES,
    CATEGORY_ADVICE,
    MIXED_ADVICE,
    MIXED_ADVICE_DETAILS,
    NO_FAILURE_ADVICE,
    TOP_LIST_SIZE,
    UNKNOWN_CATEGORY,
)
from runlens.functions import failures as rules
from runlens.functions.numbers import rate
from runlens.functions.text import clean_message, none_if_empty

GROUP_KEY = ("run_id", "category", "signature")


def number_text(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def classify_failures(executions: DataFrame) -> DataFrame:
    """Add the cleaned message, the canonical status and, for failing records, the failure category."""
    return (
        executions.withColumn("message", clean_message(F.col("error_message")))
        .withColumn("canonical", rules.canonical_status(F.col("status")))
        .withColumn("failing", rules.is_failing(F.col("status")))
        .withColumn("folded", F.when(F.col("failing") | rules.is_failure(F.col("status")), rules.folded(F.col("message"))))
        .withColumn(
            "failure_category", F.when(F.col("failing"), rules.failure_category(F.col("message"), F.col("folded")))
        )
    )


def complete_categories(classified: DataFrame) -> DataFrame:
    """What the completion of a test stores: a record without a category gets the one its error text is classified as."""
    return classified.withColumn("stored_category", F.coalesce(none_if_empty(F.col("stored_category")), F.col("failure_category")))


def recorded_category() -> Column:
    """The category a record was stored with; groups and shares trust it and never classify anew."""
    return F.coalesce(none_if_empty(F.col("stored_category")), F.lit(UNKNOWN_CATEGORY))


def failed_records(classified: DataFrame) -> DataFrame:
    """One row per failed record with its group key."""
    return (
        classified.filter(rules.is_failure(F.col("status")))
        .withColumn("category", recorded_category())
        .select(
            "run_id", "ordinal", "test_case", "feature", "message", "category",
            rules.failure_signature(F.col("message"), F.col("category"), F.col("folded")).alias("signature"),
        )
    )


def failure_groups(classified: DataFrame) -> DataFrame:
    """Occurrences per run, category and signature with the position in the run's group list."""
    order = Window.partitionBy("run_id").orderBy(F.desc("occurrences"), "category", "signature")
    counted = failed_records(classified).groupBy(*GROUP_KEY).agg(F.count("*").alias("occurrences"))
    return counted.withColumn("position", F.row_number().over(order).cast("bigint"))


def failure_group_members(classified: DataFrame) -> DataFrame:
    """The tests of each group, one row each; ``ordinal`` gives their order."""
    return failed_records(classified).select(*GROUP_KEY, "ordinal", "test_case")


def top_groups(classified: DataFrame, size: int = TOP_LIST_SIZE) -> DataFrame:
    return failure_groups(classified).filter(F.col("position") <= size)


def group_totals(groups: DataFrame) -> DataFrame:
    """Failures and number of groups per run."""
    return groups.groupBy("run_id").agg(F.sum("occurrences").alias("failures"), F.count("*").alias("groups"))


def _failure_counts(classified: DataFrame) -> DataFrame:
    """One row per run: totals and one count per fixed category, in one shuffle."""
    failed = rules.is_failure(F.col("status"))
    category = recorded_category()
    return classified.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("canonical") == "PASSED").alias("passed"),
        F.count_if(failed).alias("total_failed"),
        *[F.count_if(failed & (category == name)).alias(name) for name in CATEGORIES],
    )


def _distribution(counts: DataFrame) -> DataFrame:
    """Add the sorted array of (category, n, percentage) of one run."""
    entries = F.array(
        *[
            F.struct(
                (-F.col(name)).alias("order_n"), F.lit(rank).alias("rank"), F.lit(name).alias("category"),
                F.col(name).alias("n"), rate(F.col(name), F.col("total_failed")).alias("percentage"),
            )
            for rank, name in enumerate(CATEGORIES)
        ]
    )
    return counts.withColumn("distribution", F.array_sort(F.filter(entries, lambda e: e["n"] > 0)))


def failure_distribution(classified: DataFrame) -> DataFrame:
    """Share of each fixed category in a run's failures, largest first."""
    spread = _distribution(_failure_counts(classified))
    return spread.select("run_id", F.posexplode("distribution").alias("at", "entry")).select(
        "run_id", (F.col("at") + 1).cast("bigint").alias("position"), "entry.category", "entry.n", "entry.percentage"
    )


def impacted_suites(classified: DataFrame, size: int = TOP_LIST_SIZE) -> DataFrame:
    """The suites with most failures of each run; ties keep the order of first appearance."""
    suites = (
        failed_records(classified)
        .groupBy("run_id", F.coalesce(none_if_empty(F.col("feature")), F.lit("Uncategorized")).alias("suite"))
        .agg(F.count("*").alias("failed_count"), F.min("ordinal").alias("first_seen"))
    )
    order = Window.partitionBy("run_id").orderBy(F.desc("failed_count"), "first_seen")
    top = suites.withColumn("position", F.row_number().over(order).cast("bigint")).filter(F.col("position") <= size)
    totals = suites.groupBy("run_id").agg(F.sum("failed_count").alias("total_failed"))
    return top.join(totals, "run_id").select(
        "run_id", "position", "suite", "failed_count", rate(F.col("failed_count"), F.col("total_failed")).alias("percentage")
    )


def health_status(total_failed: Column, pass_rate: Column) -> Column:
    return (
        F.when(total_failed == 0, "HEALTHY")
        .when(pass_rate >= 95, "HEALTHY")
        .when(pass_rate >= 80, "WARNING")
        .otherwise("CRITICAL")
    )


def failure_insights(classified: DataFrame) -> DataFrame:
    """One row per run: health, dominating category and advice."""
    spread = _distribution(_failure_counts(classified))
    dominant = F.try_element_at(F.col("distribution"), F.lit(1))
    advice = F.create_map(*[F.lit(v) for name, text, _ in CATEGORY_ADVICE for v in (name, text)])
    details = F.create_map(*[v for name, _, d in CATEGORY_ADVICE for v in (F.lit(name), F.lit(" | ".join(d)))])
    pass_rate = F.coalesce(rate(F.col("passed"), F.col("total")), F.lit(0.0))
    dominates = F.col("dominant.percentage") >= 40
    nothing = F.col("dominant").isNull()
    return spread.withColumn("dominant", dominant).select(
        "run_id",
        "total_failed",
        (F.col("total_failed") > 0).alias("has_failures"),
        health_status(F.col("total_failed"), pass_rate).alias("health_status"),
        F.col("dominant.category").alias("dominant_category"),
        F.col("dominant.percentage").alias("dominant_percentage"),
        F.when(nothing, NO_FAILURE_ADVICE)
        .when(
            dominates,
            F.concat(
                F.col("dominant.category"), F.lit(" failures dominate ("), number_text(F.col("dominant.percentage")),
                F.lit("%). "), F.element_at(advice, F.col("dominant.category")),
            ),
        )
        .otherwise(MIXED_ADVICE)
        .alias("recommendation"),
        F.when(nothing, "")
        .when(dominates, F.element_at(details, F.col("dominant.category")))
        .otherwise(" | ".join(MIXED_ADVICE_DETAILS))
        .alias("details"),
    )
