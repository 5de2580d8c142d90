"""Data-quality checks, gap and coverage reports, lookback rule."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketloom.functions import params as P


def accepted_table(spark: SparkSession, rows=None) -> DataFrame:
    """The literal list of accepted anomalies."""
    rows = P.ACCEPTED_ANOMALIES if rows is None else rows
    return spark.createDataFrame(list(rows), "check string, ticker string, d string, reason string"
                                 ).withColumn("d", F.to_date("d"))


def unexcused(rows: DataFrame, accepted: DataFrame, check: str) -> DataFrame:
    """Rows whose (ticker, day) pair is not accepted for `check`."""
    pairs = accepted.filter(F.col("check") == check).select("ticker", "d")
    return rows.join(pairs, ["ticker", "d"], "left_anti")


def accepted_report(accepted: DataFrame, prices: DataFrame) -> DataFrame:
    """Accepted rows with today's close; a NULL close marks a stale entry."""
    return accepted.join(prices.select("ticker", "d", "close"), ["ticker", "d"], "left").select(
        "check", "ticker", "d", "close", "reason")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def news_checks(news: DataFrame) -> DataFrame:
    """Duplicates, scores out of range and synthetic rows in one pass: copies
    combine per hash before the shuffle."""
    score = F.col("sentiment_score")
    per_hash = news.groupBy("news_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((score < -1) | (score > 1)).alias("bad"),
        F.count_if(F.col("source_type") == "synthetic").alias("synthetic"))
    zero = F.lit(0)
    return per_hash.agg(
        F.coalesce(F.sum("n") - F.count(F.lit(1)), zero).alias("news_duplicates"),
        F.coalesce(F.sum("bad"), zero).alias("sentiment_out_of_range"),
        F.coalesce(F.sum("synthetic"), zero).alias("synthetic_news_contamination"))


def missing_returns(prices: DataFrame) -> DataFrame:
    """Rows with a close but no return that are not their asset's first."""
    first = F.min("d").over(Window.partitionBy("asset_id"))
    return (prices.withColumn("_first", first)
            .filter(F.col("close").isNotNull() & F.col("return_1d").isNull()
                    & (F.col("d") != F.col("_first"))).drop("_first"))


def non_positive_closes(prices: DataFrame, accepted: DataFrame) -> DataFrame:
    return unexcused(prices.filter(F.col("close") <= 0), accepted, "non_positive_close_price")


def scorecard(prices: DataFrame, news: DataFrame, sentiment: DataFrame,
              accepted: DataFrame) -> DataFrame:
    """Eight named counts with PASS or FAIL."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check"), "value")

    from_news = news_checks(news).unpivot(
        [], ["news_duplicates", "sentiment_out_of_range", "synthetic_news_contamination"],
        "check", "value")
    parts = [
        from_news,
        one("price_null_close", prices.filter(F.col("close").isNull())),
        one("duplicate_price_rows", duplicate_keys(prices, ["asset_id", "d"])),
        one("duplicate_sentiment_rows", duplicate_keys(sentiment, ["asset_id", "d"])),
        one("non_positive_close_price", non_positive_closes(prices, accepted)),
        one("price_null_return_with_close", missing_returns(prices)),
    ]
    card = reduce(DataFrame.unionByName, parts)
    return card.withColumn("status", F.when(F.col("value") == 0, "PASS").otherwise("FAIL"))


def price_anomalies(prices: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Moves beyond the threshold in percent, largest first."""
    return (prices.filter(F.abs("pct_change") > threshold)
            .orderBy(F.abs("pct_change").desc(), "ticker", "d"))


def technical_gaps(prices: DataFrame, technicals: DataFrame, today: Column,
                   days: int = 30) -> DataFrame:
    """Price days of the last `days` without an indicator row, per ticker."""
    recent = prices.filter(F.col("d") >= F.date_sub(today, days))
    return (recent.join(technicals.select("asset_id", "d"), ["asset_id", "d"], "left_anti")
            .groupBy("ticker").agg(F.count(F.lit(1)).alias("missing_technical_days")))


def coverage(prices: DataFrame, news: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Trading days and days without news per ticker; thin when all lack news.
    News is counted per (asset, day) before it meets the price rows."""
    start = F.date_sub(today, days)
    per_day = (news.filter(F.col("published_d") >= start)
               .groupBy("asset_id", F.col("published_d").alias("d"))
               .agg(F.count(F.lit(1)).alias("n")))
    days_, zero = F.count(F.lit(1)), F.count_if(F.coalesce("n", F.lit(0)) == 0)
    return (prices.filter(F.col("d") >= start).join(per_day, ["asset_id", "d"], "left")
            .groupBy("ticker").agg(days_.alias("trading_days"), zero.alias("zero_news_days"),
                                   (zero >= days_).alias("thin")))


def freshness(prices: DataFrame, news: DataFrame, sentiment: DataFrame, technicals: DataFrame,
              run_d: dt.date, limit: int = 4) -> DataFrame:
    """Newest day per table, side by side, and whether prices are stale."""
    top = lambda df, c: df.agg(F.max(c)).scalar()
    latest = prices.agg(F.max("d").alias("latest_price")).withColumns({
        "latest_news": top(news, "published_d"), "latest_sentiment": top(sentiment, "d"),
        "latest_technical": top(technicals, "d")})
    age = F.datediff(F.lit(run_d), F.col("latest_price"))
    return latest.withColumn("stale", F.coalesce(age > limit, F.lit(True)))


def calendar_gaps(prices: DataFrame, horizon: dt.date) -> DataFrame:
    """Calendar days inside the stored range, from the horizon on, on which no
    asset has a row."""
    stored = prices.select("d").distinct()
    bounds = stored.agg(F.greatest(F.min("d"), F.lit(horizon)).alias("lo"), F.max("d").alias("hi"))
    days = bounds.filter("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.join(stored, "d", "left_anti")


def lookback(prices: DataFrame, run_d: dt.date, expected_tickers: int,
             floor: int = P.LOOKBACK_FLOOR, ceiling: int = P.LOOKBACK_CEILING,
             margin: int = P.LOOKBACK_MARGIN) -> DataFrame:
    """How far back to fetch prices, as one row (lookback, reason)."""
    latest = prices.groupBy("ticker").agg(F.max("d").alias("latest"))
    horizon = run_d - dt.timedelta(days=ceiling)
    gap = calendar_gaps(prices, horizon).agg(F.min("d")).scalar()
    return choose_lookback(latest, gap, run_d, expected_tickers, floor, ceiling, margin)


def choose_lookback(latest: DataFrame, earliest_gap: Column, run_d: dt.date,
                    expected_tickers: int, floor: int = P.LOOKBACK_FLOOR,
                    ceiling: int = P.LOOKBACK_CEILING,
                    margin: int = P.LOOKBACK_MARGIN) -> DataFrame:
    """The decision half: the ceiling for a new ticker, else the larger of the
    staleness and the oldest interior gap plus a margin, inside the bounds."""
    today = F.lit(run_d)
    row = latest.agg(F.count(F.lit(1)).alias("known"),
                     F.min(F.struct("latest", "ticker")).alias("stalest"))
    row = row.withColumn("gap", earliest_gap)
    row = row.withColumns({"stale_days": F.datediff(today, F.col("stalest.latest")),
                           "gap_days": F.datediff(today, F.col("gap"))})
    gap_wins = F.coalesce(F.col("gap_days") > F.col("stale_days"), F.lit(False))
    needed = F.when(gap_wins, F.col("gap_days")).otherwise(F.col("stale_days"))
    missing = F.lit(expected_tickers) - F.col("known")
    span = F.when(missing > 0, F.lit(ceiling)).otherwise(
        F.greatest(F.lit(floor), F.least(F.lit(ceiling), needed + margin))).cast("int")
    why = (F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" ticker(s) have no price history yet")))
           .when(gap_wins, F.concat(F.lit("missing price days from "), F.col("gap").cast("string")))
           .otherwise(F.concat(F.col("stalest.ticker"), F.lit(" latest "),
                               F.col("stalest.latest").cast("string"))))
    return row.select(span.alias("lookback"), F.when(span > floor, why).alias("reason"))


def alerts(card: DataFrame, gaps: DataFrame, cover: DataFrame, fresh: DataFrame) -> DataFrame:
    """Alert rows (kind, subject, detail) of one data-quality run."""
    text = lambda c: F.col(c).cast("string")
    return reduce(DataFrame.unionByName, [
        card.filter("status = 'FAIL'").select(F.lit("check").alias("kind"),
                                              F.col("check").alias("subject"), text("value").alias("detail")),
        gaps.select(F.lit("technical_gap").alias("kind"), F.col("ticker").alias("subject"),
                    text("missing_technical_days").alias("detail")),
        cover.filter("thin").select(F.lit("no_news").alias("kind"), F.col("ticker").alias("subject"),
                                    text("zero_news_days").alias("detail")),
        fresh.filter("stale").select(F.lit("stale_price").alias("kind"), F.lit("price").alias("subject"),
                                     text("latest_price").alias("detail"))])
