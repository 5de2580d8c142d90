"""Watchlist and signal changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def watchlist(added: DataFrame, removed: DataFrame) -> DataFrame:
    """First addition per ticker wins; removed tickers leave; newest first."""
    first = added.groupBy("ticker").agg(F.min("added_at").alias("added_at"))
    return (first.join(removed.select("ticker"), "ticker", "left_anti")
            .orderBy(F.desc("added_at"), "ticker"))


def flips(signals: DataFrame, order: str, key: str = "asset_id") -> DataFrame:
    """First sight and every change per asset, with the signal before. One
    signal per asset and check reaches the window."""
    w = Window.partitionBy(key).orderBy(order)
    out = signals.withColumn("previous_signal", F.lag("signal").over(w))
    new = F.col("previous_signal").isNull() | (F.col("previous_signal") != F.col("signal"))
    return out.filter(new).withColumn("changed", F.col("previous_signal").isNotNull())


def against_log(current: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Today's signals against the last logged ones: every current row with
    `previous_signal` and `changed`, and the rows to append to the log."""
    last = log.groupBy("asset_id").agg(F.max_by("signal", "checked_at").alias("previous_signal"))
    checked = current.join(last, "asset_id", "left").withColumn(
        "changed", F.coalesce(F.col("previous_signal") != F.col("signal"), F.lit(False)))
    return checked, checked.filter(F.col("previous_signal").isNull() | F.col("changed"))
