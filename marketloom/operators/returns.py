"""Returns, forward targets and the joined metrics view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketloom.functions.numeric import full, leading, ratio


def by_day():
    """One asset's rows in day order."""
    return Window.partitionBy("asset_id").orderBy("d")


def daily_returns(prices: DataFrame) -> DataFrame:
    """return_1d and pct_change against the previous stored close."""
    ret = ratio("close", F.lag("close").over(by_day())) - 1
    return prices.withColumn("return_1d", ret).withColumn("pct_change", F.col("return_1d") * 100)


def forward_targets(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """h-row forward return and its direction; NULL where the future is unseen."""
    cols = {}
    for h in horizons:
        fwd = ratio(F.lead("close", h).over(by_day()), "close") - 1
        cols[f"target_ret_{h}d"] = fwd
        cols[f"target_dir_{h}d"] = F.when(fwd.isNotNull(), (fwd > 0).cast("int"))
    return prices.withColumns(cols)


def forward_volatility(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """Sample deviation of the returns on rows d+1..d+h; NULL for the last h rows."""
    return prices.withColumns({
        f"target_vol_{h}d": full(F.stddev_samp("return_1d"), "return_1d",
                                 leading("asset_id", "d", h), h)
        for h in horizons})


def first_rows(prices: DataFrame) -> DataFrame:
    """Flag of each asset's first stored day."""
    first = F.min("d").over(Window.partitionBy("asset_id"))
    return prices.withColumn("is_first", F.col("d") == first)


def joined_metrics(prices: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Price rows left-joined to the daily index on (asset, day)."""
    s = sentiment.select("asset_id", "d", F.col("sentiment_mean").alias("sentiment_index"),
                         "news_count")
    return prices.join(s, ["asset_id", "d"], "left")


def with_sentiment_lags(metrics: DataFrame, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Lagged sentiment over all price rows; a row without news counts as a row."""
    return metrics.withColumns({f"sentiment_lag{k}": F.lag("sentiment_index", k).over(by_day())
                                for k in lags})


def changed_returns(stored: DataFrame) -> DataFrame:
    """Rows whose stored return differs, null-safely, from the full history's."""
    fresh = daily_returns(stored.drop("return_1d", "pct_change"))
    old = stored.select("asset_id", "d", F.col("return_1d").alias("old_return"),
                        F.col("pct_change").alias("old_pct"))
    return (fresh.join(old, ["asset_id", "d"])
            .filter(~(F.col("return_1d").eqNullSafe(F.col("old_return"))
                      & F.col("pct_change").eqNullSafe(F.col("old_pct")))))
