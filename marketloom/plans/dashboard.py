"""Reporting queries over the price, news and sentiment tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions import text as T
from marketloom.functions.numeric import r, ratio


def between(df: DataFrame, start: dt.date | None, end: dt.date | None, day: str = "d",
            ticker: str = "ALL") -> DataFrame:
    """Inclusive date range and optional ticker; both reach the scan."""
    if ticker != "ALL":
        df = df.filter(F.col("ticker") == ticker)
    if start is not None:
        df = df.filter(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(day) <= F.lit(end))
    return df


def range_counters(prices: DataFrame, news: DataFrame, sentiment: DataFrame, start: dt.date,
                   end: dt.date) -> DataFrame:
    """Row counts of the three tables inside a range, side by side."""
    n = lambda df, day: between(df, start, end, day).agg(F.count(F.lit(1))).scalar()
    base = between(prices, start, end).agg(F.count(F.lit(1)).alias("price_rows"))
    return base.withColumns({"news_rows": n(news, "published_d"), "senti_rows": n(sentiment, "d")})


def metrics_table(metrics: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                  ticker: str = "ALL", rows: int = 100) -> DataFrame:
    """Latest rows of the metrics view with display fields. The view carries
    `open`, so no second read of the price table is needed."""
    top = (between(metrics, start, end, ticker=ticker)
           .orderBy(F.col("d").desc(), "ticker").limit(rows))
    return top.select("ticker", F.col("d"), T.day_text("d").alias("day"), r("open", 2).alias("open"),
                      r("close", 2).alias("close"), T.signed_pct("pct_change").alias("return_1d"),
                      r("sentiment_index", 3).alias("sentiment_index"),
                      F.coalesce("news_count", F.lit(0)).alias("news_count"))


def latest_per_ticker(metrics: DataFrame) -> DataFrame:
    """Each ticker's newest priced row; a hash aggregate, combined map-side. A
    ticker has one row a day, so the columns come from the same row."""
    cols = ["close", "return_1d", "sentiment_index", "news_count"]
    return (metrics.filter(F.col("close").isNotNull()).groupBy("ticker")
            .agg(*[F.max_by(c, "d").alias(c) for c in cols], F.max("d").alias("d"))
            .select("ticker", T.display_name("ticker").alias("display_name"), *cols, "d"))


def top_movers(latest: DataFrame, n: int = 5, n_trending: int = 6) -> DataFrame:
    """Gainers, losers and most-covered tickers with their position."""
    moved = latest.filter(F.col("return_1d").isNotNull())
    lists = [("gainers", moved, F.col("return_1d").desc(), n), ("losers", moved, F.col("return_1d"), n),
             ("trending", latest, F.coalesce("news_count", F.lit(0)).desc(), n_trending)]
    out = None
    for name, rows, order, size in lists:
        top = rows.orderBy(order, "ticker").limit(size)
        rank = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order, "ticker"))
        part = top.select(F.lit(name).alias("list"), rank.alias("pos"), "ticker", "return_1d", "news_count")
        out = part if out is None else out.unionByName(part)
    return out


def sparklines(prices: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Per ticker the ordered bars of the last days; at most `days` + 1 each."""
    recent = prices.filter((F.col("d") >= F.date_sub(today, days)) & F.col("close").isNotNull())
    bar = F.struct("d", "open", "high", "low", "close")
    return recent.groupBy("ticker").agg(F.array_sort(F.collect_list(bar)).alias("bars"))


def latest_price(prices: DataFrame, ticker: str = "ALL") -> DataFrame:
    """Newest stored close of one ticker or of each."""
    rows = between(prices, None, None, ticker=ticker)
    return (rows.groupBy("ticker").agg(F.max_by("close", "d").alias("close"), F.max("d").alias("d"))
            .select("ticker", T.display_name("ticker").alias("display_name"), "close", "d"))


def live_sentiment(metrics: DataFrame, day: Column | None = None) -> DataFrame:
    """All rows of `day`, the newest day of the view where none is given."""
    top = metrics.agg(F.max("d")).scalar() if day is None else day
    return metrics.filter(F.col("d") == top).select(
        "ticker", T.display_name("ticker").alias("display_name"), "sentiment_index",
        F.coalesce("news_count", F.lit(0)).alias("news_count"), "d")


def fundamentals_history(fundamentals: DataFrame) -> DataFrame:
    """Quarters with year-on-year growth against four rows earlier, numbered
    newest first, with a flag for the last 20 (the chart)."""
    w = Window.partitionBy("ticker").orderBy("fiscal_period_end")
    newest = Window.partitionBy("ticker").orderBy(F.col("fiscal_period_end").desc())
    yoy = lambda c: ratio(c, F.lag(c, 4).over(w)) - 1
    return fundamentals.withColumns({
        "revenue_yoy": yoy("revenue"), "net_income_yoy": yoy("net_income"),
        "age": F.row_number().over(newest)}).withColumn("in_chart", F.col("age") <= 20)


def company_profile(profiles: DataFrame, assets: DataFrame, ticker: str = "ALL") -> DataFrame:
    """Registrant profile of one asset or of each; no row means it does not file."""
    wanted = between(assets, None, None, ticker=ticker).select("asset_id", "ticker")
    one = profiles.join(wanted, "asset_id")
    link = F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="),
                    "cik", F.lit("&type=10-K&dateb=&owner=include&count=40"))
    body = F.col("business_description")
    paragraphs = F.when(F.length(body) > 0, T.paragraphs(body)).otherwise(F.array().cast("array<string>"))
    return one.withColumns({
        "latest_10k_filed": F.date_format("latest_10k_filed", "yyyy-MM-dd"), "cik_url": link,
        "business_chars": F.coalesce(F.length(body), F.lit(0)), "business_paragraphs": paragraphs,
        "recent_filings": F.coalesce("recent_filings", F.expr(
            "CAST(array() AS array<struct<form:string,filed:string,accession:string,url:string>>)"))})
