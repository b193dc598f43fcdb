"""Validation and cleaning of the fundamentals table.

Input columns are the landed ones (`schemas.FUNDAMENTALS` plus `ord`, the row order of the file).
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barscreen.functions.instants import Instant, column_type, instant
from barscreen.schemas import REQUIRED_HEADERS

STALE_MONTHS = 4


class Validated(NamedTuple):
    frame: DataFrame
    report: DataFrame
    extra: list[str]


def missing_headers(headers: list[str]) -> list[str]:
    return [h for h in REQUIRED_HEADERS if h not in headers]


def extra_headers(headers: list[str]) -> list[str]:
    return [h for h in headers if h not in REQUIRED_HEADERS]


def check_headers(headers: list[str]) -> list[str]:
    """Raise when required headers are missing; return (and warn about) the others.

    Extra columns are kept.
    """
    missing = missing_headers(headers)
    if missing:
        raise ValueError(f"fundamentals file lacks required columns: {missing}")
    extra = extra_headers(headers)
    if extra:
        warnings.warn(f"fundamentals file has extra columns, kept: {extra}", stacklevel=2)
    return extra


def header_report(df: DataFrame) -> DataFrame:
    """(file, header, kind) of landed header rows `(file, headers)`: every required header that a file lacks and every extra one.

    Headers are compared as they are spelled; of a repeated header the later ones are not told.
    """
    required = F.array(*[F.lit(h) for h in REQUIRED_HEADERS])
    listed = F.coalesce("headers", F.array().cast("array<string>"))

    def entries(headers: Column, kind: str) -> Column:
        return F.transform(headers, lambda h: F.struct(h.alias("header"), F.lit(kind).alias("kind")))

    found = F.concat(
        entries(F.array_except(required, listed), "missing"), entries(F.array_except(listed, required), "extra"))
    return df.select("file", F.explode(found).alias("found")).select("file", "found.*")


def is_stale(df: DataFrame, as_of: Instant,
             column: str = "last_quarterly_result_date") -> Column:
    """Quarterly date more than four calendar months before `as_of`; false when missing."""
    limit = instant(as_of, column_type(df, column)) - F.make_ym_interval(
        F.lit(0), F.lit(STALE_MONTHS)
    )
    return F.coalesce(F.col(column) < limit, F.lit(False))


def stale_rows(df: DataFrame, as_of: Instant) -> DataFrame:
    return df.where(is_stale(df, as_of))


def report(df: DataFrame, as_of: Instant) -> DataFrame:
    """One row of counts. Staleness and missing codes are counted before de-duplication."""
    kept = F.count_distinct("isin") + F.max(F.col("isin").isNull().cast("int"))
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(is_stale(df, as_of)).alias("stale_count"),
        F.count_if(F.col("nse_code").isNull()).alias("missing_code_count"),
        F.coalesce(kept, F.lit(0)).cast("bigint").alias("rows_out"),
        *[
            F.coalesce(F.sum(F.size(listed)), F.lit(0)).alias(f"{listed}_cells")
            for listed in ("non_numeric", "unparsed_dates")
            if listed in df.columns
        ],
    )
    return counts.withColumns(
        {
            "has_missing_code": F.col("missing_code_count") > 0,
            "has_duplicates": F.col("rows_in") > F.col("rows_out"),
        }
    )


def first_per_key(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of every key in row order; nulls are one key.

    The filter on `row_number` lets the map tasks keep one row per key before the shuffle, so a key
    that holds a large part of the rows costs no more than any other.
    """
    ranked = W.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(ranked)).where("_rn = 1").drop("_rn")


def dedupe_isin(df: DataFrame, keep_null_isin: bool = False) -> DataFrame:
    """First row per ISIN. Rows without ISIN count as one company unless kept on request."""
    if not keep_null_isin:
        return first_per_key(df, "isin")
    # A row without ISIN is a company of its own, by its place; so one pass does for both kinds.
    own = F.when(F.col("isin").isNull(), F.col("ord"))
    ranked = W.partitionBy("isin", own).orderBy("ord")
    return df.withColumn("_rn", F.row_number().over(ranked)).where("_rn = 1").drop("_rn")


def validate(
    df: DataFrame, as_of: Instant, extra: list[str] | None = None, keep_null_isin: bool = False
) -> Validated:
    return Validated(dedupe_isin(df, keep_null_isin), report(df, as_of), extra or [])
