"""Text and JSON expressions for prompts and for checking explanations."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE = "decimal(38,18)"
# Digits of all scripts, and what they stand for.
DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)

# Decisions, levels, numbers and units.
DECISIONS = ("future_poor_qoe", "future_acceptable_qoe", "abstain")
LEVELS = ("low", "medium", "high")
NUMBER = r"-?\d+(?:\.\d+)?"
UNIT = (
    r"percentage points?|percentage|percent|mbps|kbps|gbps|bps|"
    r"milliseconds?|seconds?|ms|dbm?|%"
)
# How each causal field is mentioned, and the units it may carry.
FIELD_MENTIONS = {
    "current_mos": r"\b(?:current\s+)?mos\b",
    "throughput_mbps": (
        r"\bthroughput\b(?![ _-]to[ _-]bitrate[ _-]ratio|[ _-]bitrate[ _-]ratio|[ _-]ratio)"
    ),
    "bitrate_kbps": r"\bbitrate\b(?![ _-]ratio)",
    "capacity_margin_mbps": r"\bcapacity[ _-]margin\b",
    "throughput_to_bitrate_ratio": (
        r"\bthroughput(?:[ _-]to[ _-]bitrate|[ _-]bitrate)[ _-]ratio\b"
    ),
    "plr_percent": r"\b(?:packet[ _-]loss|plr)\b",
}
FIELD_UNITS = {
    "current_mos": (),
    "throughput_mbps": ("mbps",),
    "bitrate_kbps": ("kbps",),
    "capacity_margin_mbps": ("mbps",),
    "throughput_to_bitrate_ratio": (),
    "plr_percent": ("%", "percent", "percentage", "percentage point", "percentage points"),
}
# Forecasts of the opposite outcome, and negated forecasts.
SAYS_POOR = (
    r"\b(?:predicts?|forecasts?|expects?)\s+(?:future\s+)?(?:poor|degraded|unacceptable)\s+qoe\b|"
    r"\b(?:poor\s+qoe|qoe\s+degradation)\s+(?:is\s+)?(?:predicted|expected|forecast|likely)\b|"
    r"\bqoe\s+(?:is\s+expected\s+to|will)\s+(?:degrade|deteriorate)\b|"
    r"\bqoe\s+is\s+(?:poor|degraded|unacceptable)\b"
)
SAYS_ACCEPTABLE = (
    r"\b(?:predicts?|forecasts?|expects?)\s+(?:future\s+)?(?:acceptable|good)\s+qoe\b|"
    r"\b(?:acceptable|good)\s+qoe\s+(?:is\s+)?(?:predicted|expected|forecast)\b|"
    r"\bno\s+(?:qoe\s+)?degradation\s+(?:is\s+)?(?:predicted|expected|forecast)\b|"
    r"\bqoe\s+(?:(?:is|will|should)\s+)?(?:remain\s+)?(?:acceptable|good)\b"
)
NEGATED_FORECAST = (
    r"\b(?:(?:do|does|did)\s+not|(?:do|does|did)n['’]t|cannot|can['’]t)\s+"
    r"(?:predict|forecast|expect)\s+(?:future\s+)?"
    r"(?:(?:poor|degraded|unacceptable|acceptable|good)\s+qoe|qoe\s+degradation)\b"
)
# Fixed value: words between a field and its number.
CLAIM_VERB = r"(?:is|was|=|of|at|measured(?:\s+at)?|reported(?:\s+as)?)?"

# Flags: ignore case, Unicode classes.
ANY_CASE = "(?iU)"
# Where a number, or a number with a unit, stands in a text.
NUMBER_TOKEN = rf"(?U)(?<![\w.])({NUMBER})(?!\w)"
NUMBER_UNIT = rf"{ANY_CASE}(?<![\w.])({NUMBER})(?![\w.])\s*({UNIT})(?!\w)"

# The number and the optional unit that end a match of either pattern.
LAST_NUMBER = rf"{ANY_CASE}({NUMBER})(?:\s*({UNIT}))?$"


def claim_pattern(field: str) -> str:
    """'<field> is <number> <unit>': group 1 the number, group 2 the unit or nothing."""
    return (
        rf"{ANY_CASE}{FIELD_MENTIONS[field]}\s*{CLAIM_VERB}\s*({NUMBER})(?:\s*({UNIT})(?!\w))?"
    )


def all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


# Words a text must hold, in upper case, before a field pattern can match it.
FIELD_WORDS = {
    "current_mos": ("MOS",),
    "throughput_mbps": ("THROUGHPUT",),
    "bitrate_kbps": ("BITRATE",),
    "capacity_margin_mbps": ("CAPACITY",),
    "throughput_to_bitrate_ratio": ("THROUGHPUT",),
    "plr_percent": ("LOSS", "PLR"),
}


def holds(upper_text: Column, words: Sequence[str]) -> Column:
    """True when the upper-cased text holds one of the words; far cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [upper_text.contains(w) for w in words])


def exact_number(text: Column) -> Column:
    """The canonical digits of a number: equal texts for equal values, at any length.

    Digits of all scripts count; there are no leading zeros, no trailing zeros behind the point,
    no bare point at the end, and no negative zero.
    """
    # Only texts of several bytes a character can hold other digits.
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, "".join(DIGITS), ASCII_DIGITS))
    # Each step uses the one before once: inside lambdas, every use is worked out anew.
    short = F.regexp_replace(plain, r"^(-?)0+(?=[0-9])", "$1")
    short = F.regexp_replace(short, r"^([^.]*(?:[.][0-9]*[1-9])?)[.]?0*$", "$1")
    return F.regexp_replace(short, r"^-0$", "0")


def exact_decimal(value: Column) -> Column:
    """``exact_number`` of a decimal with places: its text has no other digits and no leading zeros."""
    text = value.cast("string")
    # Only sessions without ANSI rules write exponents.
    return F.when(text.contains("E"), exact_number(text)).otherwise(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")))


def normal_unit(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"(?U)\s+", " "))


def quoted(text: Column) -> Column:
    """Text in single quotes, or None."""
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("None"))


def number_text(value: Column) -> Column:
    """A number of at most four places as JSON text: no exponent, at least one place."""
    digits = F.regexp_replace(value.cast("decimal(24,4)").cast("string"), "0+$", "")
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def message_if(condition: Column, *parts: Column | str) -> Column:
    """One message when the condition holds, else null."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(condition, text)


def messages(*candidates: Column) -> Column:
    """The non-null messages as an array.

    Joined from arrays of one or none: a filter by a lambda would keep all conditions out of generated code.
    """
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(c.isNotNull(), F.array(c)).otherwise(none) for c in candidates])


def joined(arrays: Sequence[Column]) -> Column:
    """Several message arrays in order."""
    return F.concat(*arrays)


def flat(nested: Column) -> Column:
    """An array of arrays as one array, null as empty."""
    return F.coalesce(F.flatten(nested), F.array().cast("array<string>"))


def contains_any(column: Column, values: Sequence[str]) -> Column:
    """True when the column equals one of the values; never null."""
    tests = [column.eqNullSafe(F.lit(v)) for v in values]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
