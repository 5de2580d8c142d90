"""Point-in-time feature panels. Every panel has one row per asset and day (or
quarter), so its windows are bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketloom.functions import params as P
from marketloom.functions.numeric import full, log_vol, ratio, trailing
from marketloom.operators import asof, returns, technicals


def eligible_assets(sentiment_daily: DataFrame, assets: DataFrame, min_days: int = 30) -> DataFrame:
    """Tickers with enough sentiment days, most first."""
    counts = (sentiment_daily.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_days))
    return (counts.join(assets.select("asset_id", "ticker"), "asset_id")
            .select("ticker", "n").orderBy(F.desc("n"), "ticker"))


def with_sma_distance(technical: DataFrame) -> DataFrame:
    return technical.withColumns({f"price_vs_sma{w}": ratio("close", f"sma_{w}") - 1 for w in (20, 50)})


def technical_panel(technical: DataFrame, horizons: list[int] = P.DIRECTION_HORIZONS) -> DataFrame:
    """Technical features and forward targets."""
    return returns.forward_targets(with_sma_distance(technical), horizons)


def sentiment_panel(technical: DataFrame, sentiment: DataFrame,
                    horizons: list[int] = P.DIRECTION_HORIZONS) -> DataFrame:
    """The technical features on the days that have sentiment; lags and targets
    run over these rows only."""
    s = sentiment.select("asset_id", "d", F.col("sentiment_mean").alias("sentiment_index"), "news_count")
    joined = with_sma_distance(technical).join(s, ["asset_id", "d"])
    return returns.forward_targets(returns.with_sentiment_lags(joined), horizons)


def market_volatility(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Deviation of the last `rows` daily cross-sectional mean returns. The mean
    leaves one row per calendar day for the un-partitioned window."""
    daily = prices.groupBy("d").agg(F.avg("return_1d").alias("market_ret"))
    w = Window.orderBy("d").rowsBetween(-(rows - 1), 0)
    return daily.select("d", "market_ret", full(F.stddev_samp("market_ret"), "market_ret", w, rows)
                        .alias(f"market_vol_{rows}"))


def volatility_panel(prices: DataFrame, horizons: list[int] = P.VOLATILITY_HORIZONS) -> DataFrame:
    """Realised-volatility features, forward targets and the persistence forecast."""
    px = prices.filter(F.col("close").isNotNull())
    df = px.join(market_volatility(px).drop("market_ret"), "d", "left")
    df = technicals.rolling_volatility(df, (5, 20, 60), prefix="_v")
    last5, last20 = trailing("asset_id", "d", 5), trailing("asset_id", "d", 20)
    span = F.ln(ratio("high", "low"))
    falls = F.avg(F.coalesce((F.col("return_1d") < 0).cast("int"), F.lit(0))).over(last20)
    df = df.withColumns({"abs_ret_1": F.abs("return_1d"), "_hl": span}).withColumns({
        "abs_ret_5_mean": full(F.avg("abs_ret_1"), "abs_ret_1", last5, 5),
        "range_20": full(F.avg("_hl"), "_hl", last20, 20),
        "neg_ret_share_20": F.when(F.count(F.lit(1)).over(last20) == 20, falls)})
    df = returns.forward_volatility(df, horizons)
    df = df.withColumns({
        "log_vol_5": log_vol("_v5"), "log_vol_20": log_vol("_v20"), "log_vol_60": log_vol("_v60"),
        "vol_ratio_5_20": ratio("_v5", "_v20"), "vol_ratio_20_60": ratio("_v20", "_v60"),
        "log_market_vol_20": log_vol("market_vol_20"),
        "rel_vol_to_market": ratio("_v20", "market_vol_20")})
    out = {}
    for h in horizons:
        out[f"target_logvol_{h}d"] = log_vol(f"target_vol_{h}d")
        out[f"persistence_{h}d"] = F.col("log_vol_20")
    return df.withColumns(out).drop("_v5", "_v20", "_v60", "_hl")


def growth_features(fundamentals: DataFrame) -> DataFrame:
    """Quarter-on-quarter growth, margin change, leverage and trailing EPS. A
    missing quarter stays missing; a zero base gives no growth."""
    w = Window.partitionBy("ticker").orderBy("fiscal_period_end")
    last4 = w.rowsBetween(-3, 0)
    return fundamentals.withColumns({
        "revenue_growth_qoq": ratio("revenue", F.lag("revenue").over(w)) - 1,
        "eps_growth_qoq": ratio("eps_diluted", F.lag("eps_diluted").over(w)) - 1,
        "margin_delta_qoq": F.col("net_margin") - F.lag("net_margin").over(w),
        "debt_to_equity": ratio("total_debt", "stockholders_equity"),
        "eps_ttm": F.when(F.count("eps_diluted").over(last4) >= 2, F.sum("eps_diluted").over(last4))})


def fundamentals_panel(fundamentals: DataFrame, prices: DataFrame,
                       horizons: list[int] = P.FUNDAMENTAL_HORIZONS) -> DataFrame:
    """Growth and valuation features anchored on the first trading day after the
    announcement, with forward returns counted in trading rows."""
    feats = growth_features(fundamentals.filter(F.col("announced_d").isNotNull()))
    px = prices.filter(F.col("close").isNotNull()).select("asset_id", "ticker", "d", "close")
    bars = asof.with_future_closes(px, horizons).drop("asset_id")
    anchored = asof.next_trading_day(feats, bars, "announced_d", ["ticker"])
    anchored = anchored.withColumn("pe_ratio", F.when(F.col("eps_ttm") > 0, ratio("close", "eps_ttm")))
    return asof.forward_returns(anchored, horizons).select(
        "ticker", "fiscal_period_end", "announced_d", "anchor_date", F.col("close").alias("anchor_price"),
        *P.FUNDAMENTAL_FEATURES, *[f"fwd_ret_{h}d" for h in horizons])


def usable(panel: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with every column present; inf and NaN count as missing."""
    from marketloom.functions.numeric import finite
    return panel.withColumns({c: finite(c) for c in cols}).dropna(subset=cols)


