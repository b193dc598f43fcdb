"""Column contracts of the inputs and outputs."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The headers a fundamentals file must carry, in reporting order.
REQUIRED_HEADERS = [
    "Name",
    "NSE Code",
    "BSE Code",
    "ISIN",
    "Industry",
    "Sector",
    "Market Capitalization",
    "Price to Earnings",
    "Price to Book Value",
    "Return on Capital Employed",
    "Return on Equity",
    "Operating Profit Margin",
    "Sales growth 3Years",
    "Profit growth 3Years",
    "Sales growth 5Years",
    "Profit growth 5Years",
    "Debt to Equity",
    "Interest Coverage Ratio",
    "Sales (TTM)",
    "Cash from operations last year",
    "Free cash flow last year",
    "Working Capital (Days)",
    "Cash Conversion Cycle",
    "Debtor days",
    "Change in Debtor days (3Years)",
    "Promoter holding",
    "Change in promoter holding",
    "FII holding",
    "Change in FII holding",
    "DII holding",
    "Change in DII holding",
    "Pledged percentage",
    "Number of equity shares",
    "Number of equity shares preceding year",
    "Last annual result date",
    "Last quarterly result date",
    "Piotroski score",
    "Altman Z Score",
]
TEXT_HEADERS = ["Name", "NSE Code", "BSE Code", "ISIN", "Industry", "Sector"]
DATE_HEADERS = ["Last annual result date", "Last quarterly result date"]
NUMERIC_HEADERS = [h for h in REQUIRED_HEADERS if h not in TEXT_HEADERS + DATE_HEADERS]


def snake(header: str) -> str:
    """`Sales (TTM)` -> `sales_ttm`: the column name used after landing."""
    return re.sub(r"[^0-9a-z]+", "_", header.lower()).strip("_")


def _fundamentals_type(header: str) -> T.DataType:
    if header in TEXT_HEADERS:
        return T.StringType()
    return T.TimestampType() if header in DATE_HEADERS else T.DoubleType()


FUNDAMENTALS = T.StructType(
    [T.StructField(snake(h), _fundamentals_type(h)) for h in REQUIRED_HEADERS]
)

MASTER_FIELDS = ["name", "symbol_nse", "symbol_bse", "sector", "industry"]
MASTER = T.StructType([T.StructField(c, T.StringType()) for c in ["isin", *MASTER_FIELDS]])

CANDLE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("interval_min", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

# One landed broker response per row; each inner array is one candle. Cells are read as text, so that
# one that is no number spoils its response visibly and not all candles silently; lines that are no
# JSON objects are kept as they are.
CANDLE_RESPONSE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("interval_min", T.IntegerType()),
        T.StructField("candles", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

FEED_ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("pubDate", T.StringType()),
    ]
)

# (interval in minutes, look-back in days) of the screen's two timeframes and the hourly extra.
DAILY = (1440, 365)
FOUR_HOUR = (240, 90)
HOURLY = (60, 30)
