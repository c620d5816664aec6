"""Exact rounding, durations and checked totals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.fixed_values import MAX_SAFE_INTEGER

DURATION_TYPE = "decimal(19,3)"
RATE_TYPE = "decimal(18,12)"


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` >= 0 as text, rounded half up on its exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    # Only k/2^(digits+1) with odd k lies exactly between two results; the formatter would go to even there.
    steps = 2 ** (digits + 1)
    tie = F.pmod(value * steps, F.lit(2.0)) == 1
    return F.when(tie, F.call_function("format_number", F.round(value, digits), F.lit(pattern))).otherwise(text)


def to_fixed2(value: Column) -> Column:
    """``value`` >= 0 rounded to two decimals, half up on its exact binary value."""
    return fixed_text(value, 2).cast("double")


def to_fixed2_signed(value: Column) -> Column:
    """As ``to_fixed2`` for any sign; never yields minus zero."""
    size = to_fixed2(F.abs(value))
    return F.when((value < 0) & (size > 0), -size).otherwise(size)


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage; null without a denominator."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100)


def rate(part: Column, whole: Column) -> Column:
    return to_fixed2(percent(part, whole))


def mean(total: Column, count: Column) -> Column:
    return to_fixed2(F.when(count > 0, total.cast("double") / count.cast("double")))


def exact_duration(value: Column) -> Column:
    """Milliseconds as exact thousandths; null where the double is no exact thousandth in range."""
    units = F.when((value >= 0) & (value <= MAX_SAFE_INTEGER), value.cast(DURATION_TYPE))
    return F.when(units.cast("double") == value, units)


def is_adjacent_double(left: Column, right: Column) -> Column:
    """True when no double lies between two different doubles."""
    middle = (left + right) / 2
    return (left != right) & ((middle == left) | (middle == right))


def checked_total(total: Column, name: str) -> Column:
    """Fail the query when a count total leaves the safe integer range."""
    message = F.lit(f"Numeric range exceeded for {name}.")
    return F.when(total <= MAX_SAFE_INTEGER, total).when(total.isNotNull(), F.raise_error(message).cast("bigint"))


def checked_duration(total: Column, name: str) -> Column:
    """Exact duration total as double; fail when it has no exact double."""
    message = F.lit(f"Numeric range exceeded for {name}.")
    value = total.cast("double")
    fits = (total <= MAX_SAFE_INTEGER) & (value.cast("decimal(29,3)") == total)
    return F.when(fits, value).when(total.isNotNull(), F.raise_error(message).cast("double"))
