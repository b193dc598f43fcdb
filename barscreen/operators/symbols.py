"""The list of symbols to screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.functions.text import strip


def distinct_symbols(df: DataFrame, code: str = "nse_code") -> DataFrame:
    """Stripped non-null codes with the place `ord` of their first appearance."""
    return (
        df.where(F.col(code).isNotNull())
        .select(strip(F.col(code).cast("string")).alias("symbol"), "ord")
        .groupBy("symbol")
        .agg(F.min("ord").alias("ord"))
    )


def head(symbols: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` symbols in order, for display."""
    return symbols.orderBy("ord").limit(n)
