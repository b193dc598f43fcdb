"""Views of a trading warehouse (customers, orders, suppliers, events) as screen inputs.

Each view reads whole tables; nothing is sampled or cut.

* ticks: every event is a trade of the instrument `user_id` at price `value`
* filings: every order is a fundamentals row of its customer, so a company files many times
* announcements: every event is a feed item, newest event first
* master: the suppliers are the companies already known, with gaps
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_columns(table(spark, sf_dir, "events"))


def tick_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1).cast("bigint").alias("volume"),
    )


def isin_of(key: Column) -> Column:
    return F.concat(F.lit("IN"), F.lpad(key.cast("string"), 10, "0"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals in file order `ord`; customers without orders file once, with no figures."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders")
    c = F.col
    company = customer.join(nation, c("c_nationkey") == c("n_nationkey")).join(
        region, c("n_regionkey") == c("r_regionkey")
    )
    filed = company.join(orders, c("c_custkey") == c("o_custkey"), "left")
    key = c("c_custkey")
    return filed.select(
        F.coalesce(c("o_orderkey"), F.lit(-1) - key).alias("ord"),
        F.concat_ws(" ", c("c_name"), c("o_orderpriority")).alias("name"),
        key.cast("string").alias("nse_code"),
        F.when(c("o_orderstatus") != "P", (key + 500000).cast("string")).alias("bse_code"),
        F.when(c("c_acctbal") >= 0, isin_of(key)).alias("isin"),
        c("n_name").alias("industry"),
        c("r_name").alias("sector"),
        (c("o_totalprice") / 20000).alias("return_on_capital_employed"),
        (c("c_acctbal") / 4000).alias("debt_to_equity"),
        (c("o_totalprice") / 100000).alias("altman_z_score"),
        (c("n_nationkey") / F.lit(2.5)).alias("piotroski_score"),
        c("o_orderdate").cast("timestamp").alias("last_quarterly_result_date"),
    )


def announcement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed items `(feed_ord, title, link, pubDate)`, newest event first."""
    return announcement_columns(table(spark, sf_dir, "events"))


def announcement_columns(events: DataFrame) -> DataFrame:
    c = F.col
    subject = (
        F.when(c("event_type") == "purchase", "Board approves Dividend")
        .when(c("event_type") == "view", "Quarterly Results declared")
        .when(c("event_type") == "error", "Debt restructure and loss")
        .when(c("event_type") == "click", "Board Meeting on Buyback")
        .otherwise("General update")
    )
    general = (c("event_type") == "signup") & (c("value") < 10)
    return events.select(
        (-c("event_id")).alias("feed_ord"),
        F.when(general, "Exchange circular")
        .otherwise(F.concat(c("user_id").cast("string"), F.lit(": "), subject))
        .alias("title"),
        F.concat(F.lit("https://example.org/a/"), c("event_id").cast("string")).alias("link"),
        F.concat(
            F.date_format(c("ts"), "EEE").substr(1, 3),
            F.lit(", "),
            F.date_format(c("ts"), "dd MMM yyyy HH:mm:ss"),
            F.lit(" +0000"),
        ).alias("pubDate"),
    )


def known_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing master: suppliers, with nulls where their balance is low."""
    s = table(spark, sf_dir, "supplier")
    c = F.col
    return s.select(
        isin_of(c("s_suppkey")).alias("isin"),
        c("s_name").alias("name"),
        F.when(c("s_acctbal") > 5000, c("s_suppkey").cast("string")).alias("symbol_nse"),
        F.when(c("s_acctbal") > 2000, (c("s_suppkey") + 900000).cast("string")).alias("symbol_bse"),
        F.lit(None).cast("string").alias("sector"),
        F.when(c("s_nationkey") > 12, "SUPPLY").alias("industry"),
    )
