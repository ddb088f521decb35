"""Names, slugs, hashes and small text rules."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_IDENTIFIER = 64
DEFAULT_GROUP = "default"
DEFAULT_PRIORITY = 99
#: Microseconds.
_DAY = 86_400_000_000


def identifier_slug(text: Column, max_length: int = MAX_IDENTIFIER) -> Column:
    """F1: lower-case letters, digits and single underscores, at most ``max_length`` long."""
    words = F.btrim(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    short = F.rtrim(F.substring(F.lower(words), 1, max_length), F.lit("_"))
    return F.when(F.length(short) > 0, short).otherwise(F.lit("unnamed"))


def leaf_name(full_name: Column) -> Column:
    """last part of a dotted name."""
    return F.element_at(F.split(full_name, r"\."), -1)


def full_name_slug(full_name: Column) -> Column:
    """slug of the whole dotted name."""
    return identifier_slug(F.replace(full_name, F.lit("."), F.lit("_")))


def group_slug(group: Column) -> Column:
    """slug of a monitor group; no name means the default group."""
    return identifier_slug(F.coalesce(F.nullif(group, F.lit("")), F.lit(DEFAULT_GROUP)))


def priority(tag: Column) -> Column:
    """The tag as an integer, 99 when missing or not a whole number."""
    number = F.btrim(tag)
    whole = F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("int"))
    return F.coalesce(whole, F.lit(DEFAULT_PRIORITY))


def glob_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Does any shell glob match the whole text?"""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike("^" + _java_regex(pattern))
    return hit


def _java_regex(pattern: str) -> str:
    # Python ends its translation with \Z (or \z); both mean the end of the text in Java too, the latter strictly.
    return re.sub(r"\\[zZ]$", r"\\z", translate(pattern))


def anchored(pattern: str) -> str:
    """A regular expression that has to match from the start of the text."""
    return f"^(?:{pattern})"


def settings_hash(settings: Column) -> Column:
    """16 hex digits of a struct whose fields stand in alphabetical order."""
    text = F.to_json(settings, {"ignoreNullFields": "false"})
    return F.substring(F.sha2(text, 256), 1, 16)


def whole_days_between(earlier: Column, later: Column) -> Column:
    """completed days from one instant to another."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.round((micros - F.pmod(micros, F.lit(_DAY))) / F.lit(_DAY)).cast("int")


def duration_text(seconds: Column) -> Column:
    """seconds, minutes or hours with one decimal."""
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )
