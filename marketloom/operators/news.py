"""Headline intake, dedup, windows and summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions import text as T
from marketloom.functions.numeric import r


def with_hash(headlines: DataFrame, published: str = "published_at") -> DataFrame:
    return headlines.withColumn("news_hash", T.news_hash("ticker", published, "title", "url"))


def dedup(hashed: DataFrame, first_by: str = "event_id") -> DataFrame:
    """One row per hash, the earliest by `first_by`. The minimum combines on
    the map side, so any number of copies of a headline shuffles as one row."""
    cols = hashed.columns
    return (hashed.groupBy("news_hash").agg(F.min_by(F.struct(*cols), first_by).alias("row"))
            .select("row.*"))


def unseen(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose hash is not stored yet, once each. Runs before any
    scoring, so the scorer only sees new headlines."""
    return dedup(candidates).join(stored.select("news_hash"), "news_hash", "left_anti")


def since(headlines: DataFrame, now: Column, hours: int) -> DataFrame:
    """Headlines not older than `hours` before `now`."""
    return headlines.filter(F.col("published_at") >= now - F.make_interval(hours=F.lit(hours)))


def rebuild_window(news: DataFrame, run_d: Column, hours: int) -> DataFrame:
    """Days whose index a run has to rebuild: back to run_d - ceil(hours / 24)."""
    return news.filter(F.col("published_d").between(F.date_sub(run_d, -(-hours // 24)), run_d))


def search(headlines: DataFrame, ticker: str = "ALL", start: dt.date | None = None,
           end: dt.date | None = None, text: str = "") -> DataFrame:
    """Optional ticker, inclusive date range, case-insensitive title text."""
    out = headlines
    if ticker != "ALL":
        out = out.filter(F.col("ticker") == ticker)
    if start is not None:
        out = out.filter(F.col("published_d") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("published_d") <= F.lit(end))
    if text:
        out = out.filter(F.contains(F.lower("title"), F.lit(text.lower())))
    return out


def page(headlines: DataFrame, number: int, size: int = 15, tie: str = "event_id") -> DataFrame:
    """One page, newest first; `tie` makes the order total."""
    return (headlines.orderBy(F.col("published_at").desc(), F.col(tie).desc())
            .offset((max(1, number) - 1) * size).limit(size))


def page_count(headlines: DataFrame, size: int = 15) -> DataFrame:
    total = F.count(F.lit(1))
    return headlines.agg(total.alias("total"),
                         F.ceil(total / size).cast("bigint").alias("total_pages"))


def label_distribution(news: DataFrame) -> DataFrame:
    return (news.filter(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label")
            .agg(F.count(F.lit(1)).alias("cnt")))


def source_ranking(news: DataFrame, sources: DataFrame, top: int = 10) -> DataFrame:
    """Best credibility per source name among the sources that published."""
    active = news.select("source_id").distinct()
    return (sources.join(active, "source_id", "left_semi").groupBy("source_name")
            .agg(F.max("credibility_score").alias("credibility_score"))
            .orderBy(F.desc("credibility_score"), "source_name").limit(top))


def day_summary(day_news: DataFrame) -> DataFrame:
    """Per ticker: count, mean score (missing as 0), strict +-0.1 counts and the
    overall label. The headlines themselves are `day_headlines`, as rows: a
    ticker may hold a third of a day's news, which must not become one value."""
    score = F.coalesce("sentiment_score", F.lit(0.0))
    pos, neg = F.count_if(score > 0.1), F.count_if(score < -0.1)
    total, mean = F.count(F.lit(1)), F.avg(score)
    return day_news.groupBy("ticker").agg(
        total.alias("n"), r(mean, 3).alias("avg_score"), pos.alias("pos"), neg.alias("neg"),
        (total - pos - neg).alias("neu"),
        F.when(mean > 0.1, "POSITIVE").when(mean < -0.1, "NEGATIVE").otherwise("NEUTRAL")
        .alias("sentiment_label")).withColumn("asset_class", T.asset_class("ticker"))


def day_headlines(day_news: DataFrame) -> DataFrame:
    """The headlines behind `day_summary`, one row each, with display fields."""
    score = F.coalesce("sentiment_score", F.lit(0.0))
    return day_news.select(
        "ticker", "event_id", F.date_format("published_at", "HH:mm").alias("time"),
        F.coalesce("title", F.lit("")).alias("title"), "url", r(score, 3).alias("score"))


def available_classes(day_news: DataFrame) -> DataFrame:
    """Asset classes with news on the day, 'All' first."""
    found = day_news.select(F.lit(1).alias("pos"), T.asset_class("ticker").alias("asset_class"))
    every = day_news.sparkSession.range(1).select(F.lit(0).alias("pos"),
                                                  F.lit("All").alias("asset_class"))
    return every.unionByName(found.distinct()).orderBy("pos", "asset_class").select("asset_class")


def covered_days(news: DataFrame) -> DataFrame:
    return news.agg(F.min("published_d").alias("min_d"), F.max("published_d").alias("max_d"))


def clamp(requested: Column) -> Column:
    """The requested day if it lies within min_d and max_d, else max_d."""
    return F.when((requested < F.col("min_d")) | (requested > F.col("max_d")), F.col("max_d")).otherwise(requested)


def clamp_day(news: DataFrame, requested: Column) -> DataFrame:
    """The requested day if news covers it, else the last covered day."""
    return covered_days(news).withColumn("d", clamp(requested))


def first_headline(news: DataFrame) -> DataFrame:
    """Earliest headline per (ticker, day)."""
    return news.groupBy("ticker", F.col("published_d").alias("d")).agg(
        F.min_by("title", F.struct("published_at", "event_id")).alias("sample_headline"))


def untrusted_sources(news: DataFrame, sources: DataFrame, trusted: list[str],
                      placeholders: list[str]) -> DataFrame:
    """Sources failing the publisher filter with their article counts, most first."""
    if not trusted:
        raise ValueError("an empty trusted list would flag every source")
    counts = news.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.lower(F.coalesce("source_name", F.lit("")))
    return (counts.join(sources, "source_id")
            .filter(~name.isin(placeholders) & ~T.contains_any(name, trusted))
            .select("source_id", "source_name", "n").orderBy(F.desc("n"), "source_id"))
