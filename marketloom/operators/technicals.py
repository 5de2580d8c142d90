"""Technical indicators per asset and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.functions.numeric import full, ratio, trailing
from marketloom.operators.ewm import Ewm, add_ewm, span_alpha
from marketloom.operators.returns import by_day

INDICATORS = ["sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "macd", "macd_signal",
              "macd_hist", "rsi_14", "volatility_20", "momentum_5", "momentum_21", "momentum_63"]


def moving_averages(prices: DataFrame, windows: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return prices.withColumns({
        f"sma_{w}": full(F.avg("close"), "close", trailing("asset_id", "d", w), w)
        for w in windows})


def momentum(prices: DataFrame, horizons: tuple[int, ...] = (5, 21, 63)) -> DataFrame:
    return prices.withColumns({
        f"momentum_{k}": ratio("close", F.lag("close", k).over(by_day())) - 1 for k in horizons})


def rolling_volatility(prices: DataFrame, windows: tuple[int, ...] = (20,),
                       prefix: str = "volatility_") -> DataFrame:
    return prices.withColumns({
        f"{prefix}{w}": full(F.stddev_samp("return_1d"), "return_1d",
                             trailing("asset_id", "d", w), w) for w in windows})


def oscillators(prices: DataFrame) -> DataFrame:
    """EMA 12/26, MACD with signal and histogram, RSI 14."""
    delta = F.col("close") - F.lag("close").over(by_day())
    df = prices.withColumn("_delta", delta).withColumns({
        "_gain": F.greatest(F.col("_delta"), F.lit(0.0)),
        "_loss": -F.least(F.col("_delta"), F.lit(0.0))})
    df = add_ewm(df, [
        Ewm("close", "ema_12", span_alpha(12), 12), Ewm("close", "ema_26", span_alpha(26), 26),
        Ewm("_gain", "_avg_gain", 1 / 14, 14, first=2),
        Ewm("_loss", "_avg_loss", 1 / 14, 14, first=2)])
    rs = ratio("_avg_gain", "_avg_loss")
    df = df.withColumn("macd", F.col("ema_12") - F.col("ema_26")).withColumn(
        "rsi_14", 100 - 100 / (1 + rs))
    df = add_ewm(df, [Ewm("macd", "macd_signal", span_alpha(9), 9, first=26)])
    return (df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
            .drop("_delta", "_gain", "_loss", "_avg_gain", "_avg_loss"))


def indicators(prices: DataFrame) -> DataFrame:
    """All thirteen indicators; every window shares one sort per asset."""
    df = prices.filter(F.col("close").isNotNull())
    return momentum(rolling_volatility(oscillators(moving_averages(df))))


def usable_ranges(technicals: DataFrame) -> DataFrame:
    """First and last day with an RSI per ticker, and how many rows have one."""
    return (technicals.filter(F.col("rsi_14").isNotNull()).groupBy("ticker")
            .agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"),
                 F.count(F.lit(1)).alias("n")))
