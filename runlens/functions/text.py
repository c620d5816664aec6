"""Text helpers: message cleaning, names, sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.fixed_values import INVALID_VERSION_TOKEN, SELECTOR_NAME_PATTERNS, TARGET_TYPES, VERSION_TOKEN_PATTERN
from runlens.functions.numbers import fixed_text

# White space removed at both ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITE_SPACE_CLASS = "[" + WHITE_SPACE + "]"


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITE_SPACE))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def none_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def clean_message(message: Column) -> Column:
    """Error text without terminal colours, with plain line ends, stripped; null if there was no text."""
    given = none_if_empty(message)
    coloured = F.contains(given, F.lit("\u001b["))
    plain = F.when(coloured, F.regexp_replace(given, "\u001b\\[[0-9;]*m", "")).otherwise(given)
    return strip(F.replace(plain, F.lit("\r\n"), F.lit("\n")))


def safe_name(value: Column) -> Column:
    """File-name form: runs of other characters become one underscore."""
    named = F.coalesce(none_if_empty(value), F.lit("Step"))
    return F.trim(F.regexp_replace(named, r"[^\w.-]+", "_"), F.lit("_"))


def _capitalize(word: Column) -> Column:
    lead = F.regexp_extract(word, r"^(\W*)", 1)
    rest = F.substr(word, F.length(lead) + 1)
    return F.concat(lead, F.upper(F.left(rest, F.lit(1))), F.lower(F.substr(rest, F.lit(2))))


def title_case(value: Column) -> Column:
    """Words with a capital each; camel case, underscores and dashes separate words."""
    spaced = F.regexp_replace(F.coalesce(value, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    spaced = strip(F.regexp_replace(F.regexp_replace(spaced, "[_-]+", " "), WHITE_SPACE_CLASS + "+", " "))
    return F.array_join(F.transform(F.split(spaced, " "), _capitalize), " ")


def selector_name(selector: Column) -> Column:
    """Readable element name from a selector text; empty when none can be read."""
    plain = strip(F.coalesce(selector, F.lit("")))
    found = F.coalesce(*[none_if_empty(F.regexp_extract(plain, p, 1)) for p in SELECTOR_NAME_PATTERNS])
    word = F.when(plain.rlike("^[A-Za-z]+$"), plain)
    return title_case(F.coalesce(found, word))


def target_name(target: Column) -> Column:
    """Readable name of a target struct (type, value, role, name)."""
    kind = target["type"]
    value = target["value"]
    return (
        F.when(kind == "mouse", F.concat(F.lit("Mouse "), value))
        .when(kind == "role", title_case(F.coalesce(none_if_empty(target["name"]), target["role"])))
        .when(kind.isin("keyboard", *[t for _, t in TARGET_TYPES if t != "role"]), title_case(value))
        .otherwise(selector_name(value))
    )


def target_from_factory(factory: Column, value: Column, name: Column) -> Column:
    """Target struct for a locator factory call."""
    kind = F.lit("selector")
    for factory_name, target_type in TARGET_TYPES:
        kind = F.when(factory == factory_name, target_type).otherwise(kind)
    is_role = factory == "getByRole"
    return F.struct(
        kind.alias("type"),
        F.when(is_role, None).otherwise(value).alias("value"),
        F.when(is_role, value).alias("role"),
        F.when(is_role, name).alias("name"),
    )


def chain_text(chain: Column) -> Column:
    """Text of the chained calls (method, value), in call order."""
    return F.coalesce(
        F.array_join(
            F.transform(chain, lambda c: F.concat(F.lit("."), c["method"], F.lit("("), F.coalesce(c["value"], F.lit("")), F.lit(")"))),
            "",
        ),
        F.lit(""),
    )


def target_text(target: Column, chain: Column) -> Column:
    """Stored text of a target struct followed by its chained calls."""
    named = F.when(
        F.coalesce(target["name"], F.lit("")) != "", F.concat(F.lit(" name="), target["name"])
    ).otherwise("")
    role = F.concat(F.lit("role="), target["role"], named)
    other = F.concat(F.coalesce(target["type"], F.lit("target")), F.lit("="), F.coalesce(target["value"], F.lit("")))
    return F.concat(F.when(target["type"] == "role", role).otherwise(other), chain_text(chain))


def step_name(action: Column, target: Column, drag_source: Column, drag_target: Column) -> Column:
    """Step title from an action and its target."""
    name = target_name(target)

    def or_else(value: Column, fallback: str) -> Column:
        return F.coalesce(none_if_empty(value), F.lit(fallback))

    verb = F.when(action == "dblclick", F.lit("Double Click")).otherwise(title_case(action))
    return (
        F.when(
            action == "dragAndDrop",
            F.concat(F.lit("Drag "), or_else(selector_name(drag_source), "Element"),
                     F.lit(" To "), or_else(selector_name(drag_target), "Element")),
        )
        .when(action == "setInputFiles", F.concat(F.lit("Upload "), or_else(selector_name(target["value"]), "File")))
        .otherwise(F.concat(verb, F.lit(" "), or_else(name, "Element")))
    )


def duration_text(milliseconds: Column) -> Column:
    """Duration as ``12ms``, ``3.40s`` or ``2m 5.0s``."""
    value = F.coalesce(milliseconds.cast("double"), F.lit(0.0))
    seconds = F.concat(fixed_text(value / 1000, 2), F.lit("s"))
    minutes = F.concat(
        F.floor(value / 60000).cast("string"), F.lit("m "), fixed_text(F.pmod(value, F.lit(60000.0)) / 1000, 1), F.lit("s")
    )
    return (
        F.when(value < 1000, F.concat(F.floor(value + 0.5).cast("string"), F.lit("ms")))
        .when(value < 60000, seconds)
        .otherwise(minutes)
    )


def file_size_text(size: Column) -> Column:
    """File size in B, KB or MB."""
    value = F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))
    return (
        F.when(value < 1024, F.concat(value.cast("string"), F.lit(" B")))
        .when(value < 1048576, F.concat(fixed_text(value.cast("double") / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed_text(value.cast("double") / 1048576, 1), F.lit(" MB")))
    )


def version_token(value: Column) -> Column:
    """A version text that is safe to show, or a fixed mask."""
    safe = (F.length(value) <= 64) & value.rlike(VERSION_TOKEN_PATTERN)
    return F.when(safe, value).otherwise(INVALID_VERSION_TOKEN)
