"""Company master: fill-only-missing upsert keyed by ISIN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.schemas import MASTER_FIELDS

# Landed fundamentals column -> master column.
FROM_FUNDAMENTALS = {
    "name": "name",
    "nse_code": "symbol_nse",
    "bse_code": "symbol_bse",
    "sector": "sector",
    "industry": "industry",
}


def master_key(columns: list[str], key: str = "isin", other: str = "isin_extra") -> Column:
    """The ISIN; the other spelling only where the first is absent or an empty string."""
    alternative = F.col(other) if other in columns else F.lit(None).cast("string")
    if key not in columns:
        return alternative
    return F.when(F.col(key) == "", alternative).otherwise(F.col(key))


def incoming_companies(fundamentals: DataFrame) -> DataFrame:
    """Fundamentals rows as master rows with their order; rows without key are left out."""
    named = [
        (F.col(source) if source in fundamentals.columns else F.lit(None).cast("string")).alias(
            target
        )
        for source, target in FROM_FUNDAMENTALS.items()
    ]
    return fundamentals.select(
        "ord", master_key(fundamentals.columns).alias("isin"), *named
    ).where(F.col("isin").isNotNull())


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per field the first non-null of the existing value and the incoming rows in order.

    One aggregation by ISIN with partial sums of at most one row per key and map task.
    """
    order_type = incoming.schema["ord"].dataType

    def placed(df: DataFrame, rank: int, order: Column) -> DataFrame:
        place = F.struct(F.lit(rank).alias("rank"), order.alias("ord")).alias("_place")
        return df.select("isin", *MASTER_FIELDS, place)

    rows = placed(existing, 0, F.lit(None).cast(order_type)).unionByName(
        placed(incoming, 1, F.col("ord"))
    )
    # The order is null where the field is, and min_by passes over null orders.
    return rows.groupBy("isin").agg(
        *[
            F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_place"))).alias(f)
            for f in MASTER_FIELDS
        ]
    )
