"""Point-in-time joins between event dates and daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketloom.functions.numeric import ratio

MAX_GAP_DAYS = 7


def with_future_closes(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """Close of the h-th later stored row per asset, NULL past the end."""
    w = Window.partitionBy("asset_id").orderBy("d")
    return prices.withColumns({f"close_{h}d": F.lead("close", h).over(w) for h in horizons})


def next_trading_day(events: DataFrame, prices: DataFrame, on: str, keys: list[str],
                     max_gap: int = MAX_GAP_DAYS, how: str = "inner") -> DataFrame:
    """First stored day on or after the date `on`, at most `max_gap` calendar
    days later; its row is added as `anchor_date` plus the other price columns.

    A price row serves the dates after the row before it, back to `max_gap`
    days, so every (asset, date) is served by at most one row: prices, one row
    per asset and day, are spread by a constant factor and nothing has to be
    reduced again. The events, which may be many and skewed, are joined once on
    equality and are never multiplied.
    """
    before = F.lag("d").over(Window.partitionBy(*keys).orderBy("d"))
    first = F.greatest(F.date_sub("d", max_gap), F.date_add(before, 1))
    # a repeated (key, day) row would begin behind itself; it serves nothing
    serving = (prices.withColumn("_from", first).filter("_from <= d")
               .withColumn(on, F.explode(F.sequence("_from", "d"))).drop("_from")
               .withColumnRenamed("d", "anchor_date"))
    return events.join(serving, [*keys, on], how)


def forward_returns(anchored: DataFrame, horizons: list[int]) -> DataFrame:
    return anchored.withColumns({f"fwd_ret_{h}d": ratio(f"close_{h}d", "close") - 1 for h in horizons})


def nearest_announcement(periods: DataFrame, announcements: DataFrame, keys: list[str],
                         within: int = 90) -> DataFrame:
    """Earliest announcement on or after the period end, at most `within` days
    later. Both sides meet on (key, month): a period looks at the few months its
    window touches, so the join is on equality."""
    months = F.sequence(F.trunc("period_end", "month"),
                        F.trunc(F.date_add("period_end", within), "month"), F.expr("interval 1 month"))
    dates = (announcements.select(*keys, "announced_d").distinct()
             .withColumn("_month", F.trunc("announced_d", "month"))
             .groupBy(*keys, "_month").agg(F.array_sort(F.collect_set("announced_d")).alias("days")))
    looked = periods.select(*keys, "period_end").distinct().withColumn("_month", F.explode(months))
    inside = F.filter("days", lambda d: d.between(F.col("period_end"), F.date_add("period_end", within)))
    first = (looked.join(dates, [*keys, "_month"]).withColumn("a", F.array_min(inside))
             .groupBy(*keys, "period_end").agg(F.min("a").alias("announced_d")))
    return periods.join(first, [*keys, "period_end"], "left")
