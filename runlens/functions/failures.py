"""Rule-based reading of status and error texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.fixed_values import (
    AUTH_WORDS,
    CATEGORY_RULES,
    ERROR_TYPE_RULES,
    FAILING_STATUSES,
    FAILING_STATUS_SPELLINGS,
    SIGNATURE_RULES,
    STACK_FILE_PATTERN,
    STACK_FRAME_PATTERN,
    UNKNOWN_CATEGORY,
    UNKNOWN_ERROR_TYPE,
    UNKNOWN_SIGNATURE,
)
from runlens.functions.text import is_blank, none_if_empty


def line_pattern(pattern: str) -> str:
    """Same matches as ``pattern`` in one pass per line.

    ``a.*b.*c`` tries every ``a`` and backtracks over the whole line. Anchoring at the line start and
    keeping the first ``a`` and the first ``b`` after it finds a match exactly when there is one.
    """
    *leading, last = pattern.split(".*")
    if not leading:
        return pattern
    return "^" + "".join(f"(?>.*?{part})" for part in leading) + ".*?" + last


def literal_parts(pattern: str) -> tuple[list[str], bool]:
    """The plain texts every match contains, and whether one text is the whole pattern."""
    parts = re.split(r"\.\*|\\[sdb](?:[*+]|\{\d\})?", pattern)
    plain = [re.sub(r"\\(.)", r"\1", part).lower() for part in parts if part]
    return plain, len(parts) == 1


def folded(text: Column) -> Column:
    """Text with ASCII letters in lower case; keeps two letters whose lower case would become ASCII apart."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(is_ascii, text).otherwise(F.translate(text, "\u0130\u212a", "__")))


def matches(text: Column, pattern: str, lower: Column | None = None) -> Column:
    """True when the pattern occurs, ignoring case.

    Plain texts are searched in the folded text; a regular expression runs only where they all occur.
    """
    lower = folded(text) if lower is None else lower
    plain, whole = literal_parts(pattern)
    tests = [F.contains(lower, F.lit(part)) for part in plain]
    if not whole:
        tests.append(text.rlike("(?im)" + line_pattern(pattern)))
    return reduce(lambda a, b: a & b, tests)


def _any_of(text: Column, patterns, lower: Column | None) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p, lower) for p in patterns])


def _first_match(text: Column, rules, default, lower: Column | None) -> Column:
    """Value of the first rule (value, pattern) that matches."""
    result = default
    for value, pattern in reversed(rules):
        result = F.when(matches(text, pattern, lower), F.lit(value)).otherwise(result)
    return result


def canonical_status(status: Column) -> Column:
    value = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(value == "PASS", "PASSED")
        .when(value == "FAIL", "FAILED")
        .when(value == "SKIP", "SKIPPED")
        .when(value == "", "UNKNOWN")
        .otherwise(value)
    )


def step_status(status: Column) -> Column:
    return F.when(canonical_status(status).isin(*FAILING_STATUSES), "FAIL").otherwise("PASS")


def is_failing(status: Column) -> Column:
    """Failure test of reports and history: one of the three canonical failing statuses."""
    return canonical_status(status).isin(*FAILING_STATUSES)


def is_failure(status: Column) -> Column:
    """Failure test of the analytics, which also take two further spellings."""
    return F.upper(F.coalesce(status, F.lit(""))).isin(*FAILING_STATUS_SPELLINGS)


def failure_category(message: Column, lower: Column | None = None) -> Column:
    """Category of an error text; ``lower`` is its folded form where a column holds it."""
    result = F.lit(UNKNOWN_CATEGORY)
    for category, patterns in reversed(CATEGORY_RULES):
        result = F.when(_any_of(message, patterns, lower), category).otherwise(result)
    return F.when(is_blank(message), UNKNOWN_CATEGORY).otherwise(result)


def category_rule(message: Column, category: Column, lower: Column | None = None) -> Column:
    """The pattern that decided ``category``; null for the unknown category."""
    none = F.lit(None).cast("string")
    result = none
    for name, patterns in CATEGORY_RULES:
        rules = [(p, p) for p in patterns]
        result = F.when(category == name, _first_match(message, rules, none, lower)).otherwise(result)
    return F.when(~is_blank(message), result)


def _by_signature_rules(message: Column, category: Column, pick, default: Column, lower: Column | None) -> Column:
    name = F.upper(F.coalesce(category, F.lit("")))
    result = default
    for rule_category, rules in SIGNATURE_RULES:
        picked = [(pick(signature, pattern), pattern) for signature, pattern in rules]
        result = F.when(name == rule_category, _first_match(message, picked, default, lower)).otherwise(result)
    return F.when(is_blank(message), default).otherwise(result)


def failure_signature(message: Column, category: Column, lower: Column | None = None) -> Column:
    """Signature of an error text, by the rules of its category."""
    return _by_signature_rules(message, category, lambda signature, _: signature, F.lit(UNKNOWN_SIGNATURE), lower)


def signature_rule(message: Column, category: Column, lower: Column | None = None) -> Column:
    """The pattern that decided the signature."""
    return _by_signature_rules(message, category, lambda _, pattern: pattern, F.lit(None).cast("string"), lower)


def error_type(message: Column, lower: Column | None = None) -> Column:
    result = F.lit(UNKNOWN_ERROR_TYPE)
    for label, patterns in reversed(ERROR_TYPE_RULES):
        hit = reduce(lambda a, b: a & b, [matches(message, p, lower) for p in patterns])
        result = F.when(hit, label).otherwise(result)
    return F.when(none_if_empty(message).isNull(), UNKNOWN_ERROR_TYPE).otherwise(result)


def stack_origin(message: Column, lower: Column | None = None) -> Column:
    """Base name of the first source file in an error text, or null."""
    lower = folded(message) if lower is None else lower
    has_file = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(e)) for e in (".js", ".ts", ".mjs", ".cjs")])
    frame = none_if_empty(F.regexp_extract(message, "(?i)" + STACK_FRAME_PATTERN, 1))
    file = none_if_empty(F.regexp_extract(message, "(?i)" + STACK_FILE_PATTERN, 1))
    return F.when(has_file, F.coalesce(F.regexp_replace(frame, r"^.*[/\\]", ""), file))


def mentions_auth(message: Column, lower: Column | None = None) -> Column:
    return F.coalesce(_any_of(message, AUTH_WORDS, lower), F.lit(False))


def mentions_url_check(message: Column, lower: Column | None = None) -> Column:
    return F.coalesce(matches(message, "toHaveURL", lower), F.lit(False))
