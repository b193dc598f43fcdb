"""Tolerant parsing of landed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cell texts read as missing.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

#: Formats by what a text looks like; of each kind the first that fits counts. Days come before months, unless only the
#: other order gives a date.
#: A format that does not fit costs an exception, so plain dates and texts without a digit, which fit none, are kinds of their own.
DATE_KINDS = [
    ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", ["yyyy-MM-dd", "yyyy-M-d"]),
    ("^[^0-9]*$", []),
    ("^[0-9]{4}-", ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d", "yyyy-MM-dd'T'HH:mm:ssXXX"]),
    ("/", ["dd/MM/yyyy", "d/M/yyyy", "M/d/yyyy"]),
    ("[.]", ["dd.MM.yyyy"]),
    ("[A-Za-z]", ["d-MMM-yyyy", "d MMM yyyy", "MMM yyyy", "d MMMM yyyy", "MMMM yyyy"]),
    ("", ["yyyyMM", "yyyyMMdd"]),
]
RSS_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d-MMM-yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss"]

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def missing_to_null(col: Column) -> Column:
    """Unify the missing-value spellings to SQL NULL."""
    return F.when(~col.isin(NULL_TOKENS), col)


def number_or_null(col: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null."""
    return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))


def nan_to_null(col: Column) -> Column:
    """NaN, which compares as larger than every number, to null."""
    return F.nanvl(col, F.lit(None).cast("double"))


def date_or_null(col: Column, formats: list[str] | None = None) -> Column:
    """Text to timestamp by the first format that fits; unparseable becomes null.

    Without `formats`, those of `DATE_KINDS`; a text is tried with the formats of its kind only.
    """

    def first_of(some: list[str]) -> Column:
        return F.coalesce(*[F.try_to_timestamp(col, F.lit(fmt)) for fmt in some]) if some else F.lit(None).cast("timestamp")

    if formats:
        return first_of(formats)
    (pattern, some), *rest = DATE_KINDS
    chosen = F.when(col.rlike(pattern), first_of(some))
    for pattern, some in rest:
        chosen = chosen.when(col.rlike(pattern), first_of(some))
    return chosen


def rss_date_or_null(col: Column) -> Column:
    """`Mon, 01 Jan 2024 10:00:00 +0530` to timestamp; the weekday is cut off first."""
    return date_or_null(F.regexp_replace(col, "^[A-Za-z]{3}, *", ""), RSS_FORMATS)
