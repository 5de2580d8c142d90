"""Reporting queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.functions.numeric import r
from marketloom.operators import news as N
from marketloom.operators import returns
from marketloom.plans import dashboard as D
from marketloom.sources.tables import Market


@query("daily_metrics", """SELECT ticker, d, close, round(return_1d, 6) + 0.0 AS return_1d, volume,
    round(sentiment_index, 6) + 0.0 AS sentiment_index, news_count FROM metrics""", "d", "news_count")
def daily_metrics(m: Market):
    return m.metrics.select("ticker", "d", "close", r("return_1d").alias("return_1d"), "volume",
                            r("sentiment_index").alias("sentiment_index"), "news_count")


@query("metrics_table", """SELECT ticker, d, strftime(d, '%a %b %d') AS day, round(open, 2) + 0.0 AS open,
      round(close, 2) + 0.0 AS close, CASE WHEN pct_change IS NULL THEN 'N/A' ELSE printf('%+.2f%%', pct_change) END AS return_1d,
      round(sentiment_index, 3) + 0.0 AS sentiment_index, coalesce(news_count, 0) AS news_count
    FROM metrics WHERE d BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' ORDER BY metrics.d DESC, ticker LIMIT 100""", "d")
def metrics_table(m: Market):
    return D.metrics_table(m.metrics, dt.date(2000, 1, 1), dt.date(2000, 12, 31))


view("latest", """SELECT ticker, close, return_1d, sentiment_index, news_count, d FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS pos FROM metrics) WHERE pos = 1""")


@query("latest_per_ticker", """SELECT ticker, ticker AS display_name, close, round(return_1d, 6) + 0.0 AS return_1d,
    round(sentiment_index, 6) + 0.0 AS sentiment_index, news_count, d FROM latest""", "d", "news_count")
def latest_per_ticker(m: Market):
    return D.latest_per_ticker(m.metrics).withColumns(
        {"return_1d": r("return_1d"), "sentiment_index": r("sentiment_index")})


@query("top_movers", """g AS (SELECT 'gainers' AS list, row_number() OVER (ORDER BY return_1d DESC, ticker) AS pos, ticker,
      return_1d, news_count FROM latest WHERE return_1d IS NOT NULL),
    l AS (SELECT 'losers', row_number() OVER (ORDER BY return_1d, ticker) AS pos, ticker, return_1d, news_count
      FROM latest WHERE return_1d IS NOT NULL),
    t AS (SELECT 'trending', row_number() OVER (ORDER BY coalesce(news_count, 0) DESC, ticker) AS pos, ticker, return_1d, news_count FROM latest),
    u AS (SELECT * FROM g WHERE pos <= 5 UNION ALL SELECT * FROM l WHERE pos <= 5 UNION ALL SELECT * FROM t WHERE pos <= 6)
    SELECT list, CAST(pos AS INTEGER) AS pos, ticker, round(return_1d, 6) + 0.0 AS return_1d, news_count FROM u""", doubles="news_count")
def top_movers(m: Market):
    return D.top_movers(D.latest_per_ticker(m.metrics)).withColumn("return_1d", r("return_1d"))


@query("sparklines", """SELECT ticker, string_agg(CAST(d AS VARCHAR) || ':' || CAST(CAST(floor(close * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY d) AS series,
    CAST(count(*) AS INTEGER) AS n FROM price_daily WHERE d >= (SELECT max(d) FROM price_daily) - 30 GROUP BY 1""")
def sparklines(m: Market):
    s = D.sparklines(m.price_daily, F.lit(m.today))
    text = F.transform("bars", lambda b: F.concat(b["d"].cast("string"), F.lit(":"),
                                                  F.floor(b["close"] * 100).cast("bigint").cast("string")))
    return s.select("ticker", F.array_join(text, ",").alias("series"), F.size("bars").alias("n"))


@query("latest_price", "SELECT ticker, ticker AS display_name, close, d FROM latest", "d")
def latest_price(m: Market):
    return D.latest_price(m.price_daily)


@query("live_sentiment", """SELECT ticker, ticker AS display_name, round(sentiment_index, 6) + 0.0 AS sentiment_index,
    coalesce(news_count, 0) AS news_count, d FROM metrics WHERE d = (SELECT max(d) FROM metrics)""", "d")
def live_sentiment(m: Market):
    return D.live_sentiment(m.metrics, F.lit(m.today)).withColumn("sentiment_index", r("sentiment_index"))


@query("sentiment_lags", """SELECT ticker, d, round(sentiment_lag1, 6) + 0.0 AS sentiment_lag1,
    round(sentiment_lag2, 6) + 0.0 AS sentiment_lag2 FROM lagged""", "d")
def sentiment_lags(m: Market):
    out = returns.with_sentiment_lags(m.metrics)
    return out.select("ticker", "d", r("sentiment_lag1").alias("sentiment_lag1"), r("sentiment_lag2").alias("sentiment_lag2"))


@query("range_lags", """x AS (SELECT ticker, d, lag(sentiment_index, 1) OVER w AS sentiment_lag1, lag(sentiment_index, 2) OVER w AS sentiment_lag2
    FROM metrics WHERE d BETWEEN DATE '1999-03-01' AND DATE '1999-08-31' WINDOW w AS (PARTITION BY ticker ORDER BY d))
    SELECT ticker, d, round(sentiment_lag1, 6) + 0.0 AS sentiment_lag1, round(sentiment_lag2, 6) + 0.0 AS sentiment_lag2 FROM x""", "d")
def range_lags(m: Market):
    inside = D.between(m.metrics, dt.date(1999, 3, 1), dt.date(1999, 8, 31))
    out = returns.with_sentiment_lags(inside)
    return out.select("ticker", "d", r("sentiment_lag1").alias("sentiment_lag1"), r("sentiment_lag2").alias("sentiment_lag2"))


@query("first_headline", """SELECT ticker, published_d AS d, min_by(title, event_id) AS sample_headline FROM headlines GROUP BY 1, 2""", "d")
def first_headline(m: Market):
    return N.first_headline(m.headlines)


@query("asset_sentiment_series", """SELECT p.ticker, p.d, p.close, round(s.sentiment_mean, 6) + 0.0 AS sentiment
    FROM price_daily p LEFT JOIN sentiment_daily s ON s.asset_id = p.asset_id AND s.d = p.d""", "d")
def asset_sentiment_series(m: Market):
    senti = m.sentiment_daily.select("asset_id", "d", r("sentiment_mean").alias("sentiment"))
    return (m.price_daily.join(senti, ["asset_id", "d"], "left")
            .select("ticker", "d", "close", "sentiment").orderBy("ticker", "d"))


@query("eligible_assets", """SELECT a.ticker, count(*) AS n FROM sentiment_daily s JOIN assets a USING (asset_id)
    GROUP BY 1 HAVING count(*) >= 30""")
def eligible_assets(m: Market):
    from marketloom.plans.panels import eligible_assets as eligible
    return eligible(m.sentiment_daily, m.assets, 30)
