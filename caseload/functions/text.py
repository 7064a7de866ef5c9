"""Text expressions: label cleaning, indicator names, numbers, month and year names.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseload.functions.rules import (
    DEFAULT_YEAR,
    INDICATOR_RULES,
    MONTH_SPELLINGS,
)

# (?U): Unicode white space; the control characters 1c-1f count as space too.
_OUTER_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
# A number as a spreadsheet column reader accepts it, amid white space. Guards the
# cast, because CAST alone would also take Java suffixes such as '12d'.
_NUMBER = (
    r"(?iU)\A[\s\x1c-\x1f]*"
    r"([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?))"
    r"[\s\x1c-\x1f]*\z"
)
# i: ignore case, u: for all of Unicode, d: only \n ends a line.
_RULE_FLAGS = "(?iud)"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not just blanks."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def is_blank(text: Column) -> Column:
    """True for null or white-space-only text."""
    return text.isNull() | (strip(text) == "")


def match_rules(clean: Column, rules: Sequence[tuple[str, str]] = INDICATOR_RULES) -> Column:
    """First matching rule's name, else the text itself. ``clean`` is already stripped."""
    branches = F
    for pattern, name in rules:
        branches = branches.when(clean.rlike(_RULE_FLAGS + pattern), F.lit(name))
    return clean if branches is F else branches.otherwise(clean)


def clean_label(label: Column) -> Column:
    """Stripped label; a null label reads ``nan``, which no key list contains."""
    return strip(F.coalesce(label.cast("string"), F.lit("nan")))


def standardise(label: Column, rules: Sequence[tuple[str, str]] = INDICATOR_RULES) -> Column:
    """STR-1: normalise a free-text indicator name."""
    return match_rules(clean_label(label), rules)


def numeric(text: Column, min_value: float | None = None) -> Column:
    """PRJ-3: text to DOUBLE, null where it is no number or lies below ``min_value``."""
    # Anything else extracts as an empty text, which casts to null.
    value = F.regexp_extract(text.cast("string"), _NUMBER, 1).try_cast("double")
    return value if min_value is None else at_least(value, min_value)


def at_least(value: Column, min_value: float) -> Column:
    """Keep values >= ``min_value``; NaN never qualifies."""
    return F.when(~F.isnan(value) & (value >= F.lit(float(min_value))), value)


def numeric_or_zero(text: Column) -> Column:
    """PRJ-4: text to DOUBLE, 0 where it is no number; negatives stay."""
    return F.coalesce(numeric(text), F.lit(0.0))


def zero_if_missing(value: Column) -> Column:
    """PRJ-4 on a column that is a number already: null and NaN become 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def month_number(name: Column) -> Column:
    """PRJ-1: month name or abbreviation (French, English) to 1..12, else null."""
    pairs = [(F.lit(word), F.lit(n)) for n, words in MONTH_SPELLINGS.items() for word in words]
    return F.try_element_at(F.create_map(*chain.from_iterable(pairs)), F.upper(strip(name)))


def year_from_name(path: Column, default_year: int = DEFAULT_YEAR) -> Column:
    """SRC-2: first four digits in a row in the file stem, else the default year."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\A.*/", ""), r"(?<=.)\.[^.]*\z", "")
    digits = F.regexp_extract(stem, "([0-9]{4})", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(default_year))


def month_start(year: Column, month: Column) -> Column:
    """PRJ-5: first day of a month; an impossible year or month gives null."""
    ok = month.between(1, 12) & year.between(1, 9999)
    return F.when(ok, F.make_date(year, month, F.lit(1)))


def strict_date(text: Column) -> Column:
    """PRJ-6: a date, or failure of the whole job on the first bad one."""
    parsed = text.try_cast("date")
    failure = F.raise_error(F.concat(F.lit("not a date: "), text.cast("string"))).cast("date")
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(failure)
