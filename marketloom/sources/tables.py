"""The canonical inputs of every operator, declared over the star tables.

`Market` builds the logical views lazily; nothing runs until a caller acts.
Row bounds that later operators rely on:

* `price_daily`, `sentiment_daily`: one row per (asset, calendar day), so a
  window per asset never sees more rows than the calendar has days, whatever
  the number of trades or headlines behind a row.
* `mentions`, `headlines`, `news_text`, `facts` grow with the data; no operator
  puts one asset's rows of these into one task without aggregating first.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def brand_number(brand: Column) -> Column:
    return F.regexp_extract(brand, r"(\d+)", 1).cast("int")


def daily_bars(trades: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Trades (key, d, unit, amount in cents, qty) to one bar per (ticker, d).

    Trades are first combined per (key, d), so a key that holds a third of all
    rows reaches the join with the asset table as one row per day; how the two
    meet is left to the adaptive plan.
    """
    def combine(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.max("high").alias("high"), F.min("low").alias("low"),
            F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))

    rows = combine(trades.select(key, "d", F.col("unit").alias("high"), F.col("unit").alias("low"),
                                 "amount", "qty"), key, "d")
    bars = combine(rows.join(assets, key), "ticker", "d")
    return bars.select(
        brand_number(F.col("ticker")).alias("asset_id"), "ticker", "d",
        ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low",
        (F.col("amount") / F.lit(100.0) / F.col("qty")).alias("close"),
        F.col("qty").cast("bigint").alias("volume"))


class Market:
    """Logical views over one folder of star tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def assets(self) -> DataFrame:
        """One row per traded symbol (25 brands; a dimension by construction)."""
        return (self.table("part").groupBy("p_brand").agg(F.min("p_type").alias("asset_name"))
                .select(brand_number(F.col("p_brand")).alias("asset_id"),
                        F.col("p_brand").alias("ticker"), "asset_name"))

    @cached_property
    def _part_brand(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("l_partkey"),
                                         F.col("p_brand").alias("ticker"))

    @cached_property
    def price_daily(self) -> DataFrame:
        trades = self.table("lineitem").select(
            "l_partkey", F.to_date("l_shipdate").alias("d"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            # whole cents: exact sums in any order, and cheaper than decimals
            F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
            F.col("l_quantity").alias("qty"))
        return daily_bars(trades, self._part_brand, "l_partkey")

    @cached_property
    def bar_days(self) -> DataFrame:
        """(asset_id, d) of every bar, without reading an amount; a day's trades
        combine before they are shuffled."""
        days = self.table("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"))
        return (days.join(self._part_brand, "l_partkey").select("ticker", "d").distinct()
                .select(brand_number(F.col("ticker")).alias("asset_id"), "d"))

    @cached_property
    def today(self) -> dt.date | None:
        """The newest day of the trades, in place of the clock: a parameter that
        reports take, read from one column, so that their filters are literals
        that reach the scan."""
        return self.table("lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0]

    @cached_property
    def mentions(self) -> DataFrame:
        """One row per article-like mention of an asset."""
        li = self.table("lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_shipdate")
        return li.join(self._part_brand, "l_partkey").select(
            brand_number(F.col("ticker")).alias("asset_id"), "ticker",
            F.col("l_suppkey").alias("source_id"), F.to_date("l_shipdate").alias("published_d"),
            F.round((F.col("l_discount") - 0.05) * 20, 2).alias("sentiment_score"),
            F.when(F.col("l_discount") >= 0.055, "pos").when(F.col("l_discount") <= 0.045, "neg")
            .otherwise("neu").alias("sentiment_label"))

    @cached_property
    def headlines(self) -> DataFrame:
        """One row per headline, keyed by event_id."""
        return self.headlines_from(self.table("events"))

    @staticmethod
    def headlines_from(events: DataFrame) -> DataFrame:
        user = F.col("user_id")
        asset = (user % 25 + 1).cast("int")
        return events.select(
            "event_id", asset.alias("asset_id"),
            F.concat(F.lit("Brand#"), asset.cast("string")).alias("ticker"),
            F.concat(F.lit("src"), (user % 20).cast("string")).alias("source_name"),
            F.col("ts").cast("timestamp").alias("published_at"), F.to_date("ts").alias("published_d"),
            F.concat("event_type", F.lit(" "), "props").alias("title"),
            F.concat(F.lit("http://n/"), user.cast("string")).alias("url"),
            F.round(F.least(F.greatest((F.col("value") - 20) / 40, F.lit(-1.0)), F.lit(1.0)), 5)
            .alias("sentiment_score"))

    @cached_property
    def facts(self) -> DataFrame:
        """Filing facts; `pos` is the payload order."""
        end = F.last_day("o_orderdate")
        return self.table("orders").select(
            (F.col("o_custkey") % 25 + 1).cast("int").alias("entity_id"),
            F.col("o_orderpriority").alias("tag"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
            F.when(F.col("o_orderkey") % 5 == 0, F.date_sub(end, 364))
            .otherwise(F.date_sub(end, 90)).alias("start_d"),
            end.alias("end_d"),
            F.date_add(end, (F.col("o_orderkey") % 60 + 1).cast("int")).alias("filed_d"),
            F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("pos"))

    @cached_property
    def news_text(self) -> DataFrame:
        return (self.table("documents").select("doc_id", "text", "lang", "source")
                .join(self.table("labels"), "doc_id", "left"))

    @cached_property
    def dim_source(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("source_id"),
                                             F.col("s_name").alias("source_name"))

    @cached_property
    def prices(self) -> DataFrame:
        """price_daily with return_1d and pct_change."""
        from marketloom.operators.returns import daily_returns
        return daily_returns(self.price_daily)

    @cached_property
    def sentiment_daily(self) -> DataFrame:
        from marketloom.operators.sentiment import daily_index
        return daily_index(self.mentions)

    @cached_property
    def metrics(self) -> DataFrame:
        """Price rows with their sentiment; sentiment stays NULL when absent."""
        from marketloom.operators.returns import joined_metrics
        return joined_metrics(self.prices, self.sentiment_daily)

    @cached_property
    def technicals(self) -> DataFrame:
        from marketloom.operators.technicals import indicators
        return indicators(self.prices)
