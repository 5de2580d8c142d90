"""Headline feeds: XML item records to news rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ITEM = ("title string, link string, published string, pubDate string, updated string, "
        "source struct<_VALUE: string, _url: string>")


def instant(text: Column) -> Column:
    """UTC instant of a feed date. A weekday prefix is dropped before parsing;
    named zones, numeric offsets and ISO forms are accepted, else NULL."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(p)) for p in
             ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx")]
    return F.coalesce(*tries, F.try_to_timestamp(bare))


def parse_items(items: DataFrame, xml: str, feed_url: str, ticker: str = "ticker") -> DataFrame:
    """One row per dated item. The date falls back from published to updated;
    the publisher falls back to the feed's host."""
    x = F.from_xml(F.col(xml), ITEM)
    host = F.parse_url(F.col(feed_url), F.lit("HOST"))
    base = F.concat(F.parse_url(F.col(feed_url), F.lit("PROTOCOL")), F.lit("://"), host)
    some = lambda c: F.when(F.length(c) > 0, c)
    keep = [c for c in items.columns if c not in (xml, feed_url, ticker)]
    rows = items.select(*keep, ticker, x.alias("x"), host.alias("host"), base.alias("base"))
    when = F.coalesce(instant(F.col("x.published")), instant(F.col("x.pubDate")), instant(F.col("x.updated")))
    return rows.select(
        *keep, ticker,
        F.coalesce(some(F.col("x.source._VALUE")), F.replace(F.col("host"), F.lit("www."), F.lit("")))
        .alias("source_name"),
        F.coalesce(some(F.col("x.source._url")), F.col("base")).alias("base_url"),
        when.alias("published_at"), F.coalesce("x.title", F.lit("")).alias("title"),
        F.col("x.link").alias("url")).filter(F.col("published_at").isNotNull())


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item rows of feed files; one row per <item>."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
