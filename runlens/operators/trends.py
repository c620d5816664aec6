"""Pass-rate trends: points in time order, moving rate, comparisons and direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.fixed_values import GRANULARITIES, MAX_SAFE_INTEGER
from runlens.functions.numbers import rate, to_fixed2_signed
from runlens.functions.times import iso_text
from runlens.operators.metrics import RunQuery, group_runs, selected_runs
from runlens.session import written


@dataclass(frozen=True)
class TrendOptions:
    """Trend settings, checked before any plan is built."""

    granularity: str = "day"
    window: int | None = None
    stable_threshold: float = 0.5
    minimum_points: int = 2

    def __post_init__(self):
        if self.granularity not in GRANULARITIES:
            raise TypeError(f"Unsupported trend granularity: {self.granularity}")
        for name, optional in (("window", True), ("minimum_points", False)):
            value = getattr(self, name)
            if value is None and optional:
                continue
            if isinstance(value, bool) or not isinstance(value, int) or not 2 <= value <= MAX_SAFE_INTEGER:
                raise TypeError(f"{name} must be an integer of at least 2.")
        threshold = self.stable_threshold
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 100:
            raise TypeError("stable_threshold must be a number from 0 through 100.")


def _points(runs: DataFrame, options: TrendOptions, query: RunQuery) -> DataFrame:
    if options.granularity == "run":
        own = rate(F.col("passed"), F.col("total"))
        return selected_runs(runs, query).select(
            F.col("run_key").alias("key"), iso_text(F.col("started_at")).alias("start"), F.lit(None).cast("string").alias("end_exclusive"),
            F.lit(1).cast("bigint").alias("run_count"), F.col("total").alias("total_tests"), "passed",
            own.alias("weighted_pass_rate"), own.alias("average_run_pass_rate"),
        )
    return group_runs(runs, options.granularity, query, with_total=False).select(
        "key", "start", "end_exclusive", "run_count", F.col("tests").alias("total_tests"), "passed",
        "weighted_pass_rate", "average_run_pass_rate",
    )


def _moving_rate(size: int) -> Column:
    last = Window.orderBy("start", "key").rowsBetween(1 - size, 0)
    passed, total = F.sum("passed").over(last), F.sum("total_tests").over(last)
    return F.when(F.count("*").over(last) == size, rate(passed, total))


def moving_rate_by_slice(points: DataFrame, size: int, slices: int | None = None) -> DataFrame:
    """The moving rate over any number of points and for any window, without one global window.

    Points are written in range-partitioned slices of time order. Each is numbered and summed within its slice, the few slice
    totals give what lies before it, and a window's sum is the difference of two such running sums ``size`` points apart.
    """
    slices = slices or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = written(written(points).repartitionByRange(slices, "start", "key").withColumn("slice", F.spark_partition_id()))
    within = Window.partitionBy("slice").orderBy("start", "key").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("slice").agg(F.count("*").alias("n"), F.sum("passed").alias("p"), F.sum("total_tests").alias("t"))
    bases = totals.select("slice", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in "npt"])
    run = sliced.select("*", F.row_number().over(Window.partitionBy("slice").orderBy("start", "key")).alias("n"),
                        F.sum("passed").over(within).alias("p"), F.sum("total_tests").over(within).alias("t")).join(bases, "slice")
    summed = run.select(*points.columns, *[(F.col(x) + F.col(f"{x}_before")).alias(f"sum_{x}") for x in "npt"])
    back = summed.select((F.col("sum_n") + size).alias("sum_n"), F.col("sum_p").alias("old_p"), F.col("sum_t").alias("old_t"))
    both = summed.join(back, "sum_n", "left")
    passed, total = (F.col(f"sum_{x}") - F.coalesce(F.col(f"old_{x}"), F.lit(0)) for x in "pt")
    return both.select(*points.columns, F.when(F.col("sum_n") >= size, rate(passed, total)).alias("moving_weighted_pass_rate"))


def trend_series(runs: DataFrame, options: TrendOptions | None = None, query: RunQuery | None = None) -> DataFrame:
    """Trend points with their moving rate; null until the window is full and without tests."""
    options, query = options or TrendOptions(), query or RunQuery()
    points = _points(runs, options, query)
    if options.window is None:
        return points.withColumn("moving_weighted_pass_rate", F.lit(None).cast("double"))
    if options.granularity == "run":
        return moving_rate_by_slice(points, options.window)
    # At most one point per bucket of the calendar, so one partition holds them all.
    return points.withColumn("moving_weighted_pass_rate", _moving_rate(options.window))


def _change(baseline: Column, latest: Column) -> tuple[Column, Column]:
    """Change in points and, unless the baseline is zero, in percent."""
    return to_fixed2_signed(latest - baseline), to_fixed2_signed(F.when(baseline != 0, (latest - baseline) / baseline * 100))


def compared_points(series: DataFrame, field: str) -> DataFrame:
    """One row: number of rate-bearing points with the first, previous and latest of them."""
    point = F.struct("start", "key", F.col(field).alias("rate"))
    rated = series.filter(F.col(field).isNotNull()).select("start", "key", field)
    newest = rated.orderBy(F.desc("start"), F.desc("key")).limit(2)
    ends = newest.agg(F.min(point).alias("previous"), F.max(point).alias("latest"), F.count("*").alias("n"))
    whole = rated.agg(F.min(point).alias("first"), F.count("*").alias("analyzable"))
    both = whole.unionByName(ends, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in ("analyzable", "first", "previous", "latest", "n")])
    return both.select("analyzable", "first", F.when(F.col("n") == 2, F.col("previous")).alias("previous"), "latest")


def trend_summary(series: DataFrame, options: TrendOptions | None = None, field: str = "weighted_pass_rate") -> DataFrame:
    """One row: first, previous and latest rate, their changes and the direction."""
    options = options or TrendOptions()
    c = F.col
    points, relative = _change(c("first.rate"), c("latest.rate"))
    back_points, back_relative = _change(c("previous.rate"), c("latest.rate"))
    several = c("analyzable") > 1
    change = F.when(several, points)
    direction = (
        F.when(c("analyzable") < options.minimum_points, "insufficient-data")
        .when(change > options.stable_threshold, "improving")
        .when(change < -options.stable_threshold, "declining")
        .otherwise("stable")
    )
    return compared_points(written(series.select("start", "key", field)), field).select(
        "analyzable",
        c("first.key").alias("first_key"), c("first.rate").alias("first_rate"),
        c("previous.key").alias("previous_key"), c("previous.rate").alias("previous_rate"),
        c("latest.key").alias("latest_key"), c("latest.rate").alias("latest_rate"),
        change.alias("point_change"),
        F.when(several, relative).alias("relative_change"),
        back_points.alias("previous_point_change"),
        back_relative.alias("previous_relative_change"),
        direction.alias("direction"),
    )


def trend_warnings(series: DataFrame, options: TrendOptions | None = None) -> DataFrame:
    """Warnings about too few points, points without tests and changes from zero, each once."""
    options = options or TrendOptions()
    c = F.col
    # Compared in several ways, computed once.
    series = written(series.select("start", "key", "total_tests", "weighted_pass_rate", "average_run_pass_rate"))

    def warning(code: str, field: str, detail: Column) -> list[Column]:
        return [F.lit(code).alias("code"), F.lit(field).alias("field"), detail.alias("detail")]

    def numbers(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    totals = series.agg(
        F.count("*").alias("points"), F.count("weighted_pass_rate").alias("analyzable"), F.count_if(c("total_tests") == 0).alias("empty")
    )
    few = totals.filter(c("analyzable") < options.minimum_points).select(
        *warning("INSUFFICIENT_DATA", "weighted_pass_rate", numbers(c("analyzable"), " of ", c("points"), " points"))
    )
    empty = totals.filter(c("empty") > 0).select(*warning("ZERO_TEST_POINT", "weighted_pass_rate", numbers(c("empty"), " points")))
    result = few.unionByName(empty)
    for field in ("weighted_pass_rate", "average_run_pass_rate"):
        compared = compared_points(series, field)
        for name in ("first", "previous"):
            undefined = compared.filter((c(f"{name}.rate") == 0) & (c(f"{name}.key") != c("latest.key")))
            result = result.unionByName(
                undefined.select(*warning("UNDEFINED_RELATIVE_CHANGE", field, numbers(c(f"{name}.key"), " to ", c("latest.key"))))
            )
    return result.distinct()
