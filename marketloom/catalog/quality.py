"""Data-quality queries. The tables hold no bad rows, so the checks read a
view with bad rows planted by date rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.operators import ledger as L
from marketloom.operators import quality as Q
from marketloom.session import cut_lineage
from marketloom.sources.tables import Market

ACCEPTED = [("non_positive_close_price", "Brand#3", "1998-04-20", "real settlement"),
            ("non_positive_close_price", "Brand#7", "1999-04-20", "real settlement"),
            ("non_positive_close_price", "Brand#9", "1990-01-01", "no such row")]

view("dirty_prices", """SELECT asset_id, ticker, d, volume, pct_change,
      CASE WHEN month(d) = 4 AND day(d) = 20 THEN -close WHEN month(d) = 2 AND day(d) = 13 THEN NULL ELSE close END AS close,
      CASE WHEN day(d) = 15 THEN NULL ELSE return_1d END AS return_1d
    FROM prices CROSS JOIN (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR (month(d) = 6 AND day(d) = 28)""")
view("dirty_news", """SELECT sha256(ticker || CAST(published_d AS VARCHAR) || title || url) AS news_hash,
    sentiment_score * 1.25 AS sentiment_score,
    CASE WHEN source_name = 'src5' THEN 'synthetic' ELSE 'rss' END AS source_type FROM headlines""")
view("accepted", """SELECT * FROM (VALUES ('Brand#3', DATE '1998-04-20', 'real settlement'),
    ('Brand#7', DATE '1999-04-20', 'real settlement'), ('Brand#9', DATE '1990-01-01', 'no such row')) t(ticker, d, reason)""")
view("bad_close", """SELECT p.* FROM dirty_prices p WHERE close <= 0 AND NOT EXISTS
    (SELECT 1 FROM accepted a WHERE a.ticker = p.ticker AND a.d = p.d)""")
view("lost_return", """SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY asset_id) AS first_d FROM dirty_prices)
    WHERE close IS NOT NULL AND return_1d IS NULL AND d <> first_d""")
view("scorecard", """SELECT 'news_duplicates' AS "check", count(*) - count(DISTINCT news_hash) AS value FROM dirty_news
    UNION ALL SELECT 'price_null_close', count(*) FROM dirty_prices WHERE close IS NULL
    UNION ALL SELECT 'sentiment_out_of_range', count(*) FROM dirty_news WHERE sentiment_score < -1 OR sentiment_score > 1
    UNION ALL SELECT 'synthetic_news_contamination', count(*) FROM dirty_news WHERE source_type = 'synthetic'
    UNION ALL SELECT 'duplicate_price_rows', count(*) FROM (SELECT 1 FROM dirty_prices GROUP BY asset_id, d HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_sentiment_rows', count(*) FROM (SELECT 1 FROM sentiment_daily GROUP BY asset_id, d HAVING count(*) > 1)
    UNION ALL SELECT 'non_positive_close_price', count(*) FROM bad_close
    UNION ALL SELECT 'price_null_return_with_close', count(*) FROM lost_return""")


def dirty_prices(m: Market, prices=None):
    month, day = F.month("d"), F.dayofmonth("d")
    planted = (m.prices if prices is None else prices).withColumns({
        "close": F.when((month == 4) & (day == 20), -F.col("close"))
        .when((month == 2) & (day == 13), None).otherwise(F.col("close")),
        "return_1d": F.when(day == 15, None).otherwise(F.col("return_1d"))})
    copies = F.when((month == 6) & (day == 28), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return planted.withColumn("copy", F.explode(copies))


def dirty_news(m: Market):
    return m.headlines.select(
        F.sha2(F.concat("ticker", F.col("published_d").cast("string"), "title", "url"), 256).alias("news_hash"),
        (F.col("sentiment_score") * 1.25).alias("sentiment_score"), "asset_id", "published_d",
        F.col("source_name").alias("ref"),
        F.when(F.col("source_name") == "src5", "synthetic").otherwise("rss").alias("source_type"))


def accepted(m: Market):
    return Q.accepted_table(m.spark, ACCEPTED)


def kept_ledger(entries, name: str):
    """A ledger as it is stored: reports read it, not the rows behind it."""
    return cut_lineage(entries, name)


def price_ledger(m: Market, prices=None):
    return kept_ledger(L.ledger(dirty_prices(m, prices), marks=L.price_marks()), "ledger-dirty-prices")


def headline_ledger(m: Market):
    return L.ledger(dirty_news(m), "published_d", "ref", L.news_marks(), "news_hash")


def index_ledger(m: Market):
    return L.ledger(m.sentiment_daily)


def ledger_card(m: Market, prices, index):
    synthetic = m.headlines.filter("source_name = 'src5'").select(F.col("source_name").alias("ref"))
    return L.scorecard(price_ledger(m, prices), headline_ledger(m), index, accepted(m), m.assets, synthetic)


@query("dq_scorecard", """SELECT "check", value, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM scorecard""")
def dq_scorecard(m: Market):
    return Q.scorecard(dirty_prices(m), dirty_news(m), m.sentiment_daily, accepted(m))


@query("non_positive_closes", "SELECT ticker, d, close FROM bad_close", "d")
def non_positive_closes(m: Market):
    return Q.non_positive_closes(dirty_prices(m), accepted(m)).select("ticker", "d", "close")


@query("missing_returns", "SELECT ticker, count(*) AS n FROM lost_return GROUP BY 1")
def missing_returns(m: Market):
    return Q.missing_returns(dirty_prices(m)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_price_keys", "SELECT asset_id, d, count(*) AS n FROM dirty_prices GROUP BY 1, 2 HAVING count(*) > 1", "d")
def duplicate_price_keys(m: Market):
    return Q.duplicate_keys(dirty_prices(m), ["asset_id", "d"])


@query("accepted_anomalies", """SELECT 'non_positive_close_price' AS "check", a.ticker, a.d, p.close, a.reason
    FROM accepted a LEFT JOIN dirty_prices p ON p.ticker = a.ticker AND p.d = a.d""", "d")
def accepted_anomalies(m: Market):
    return Q.accepted_report(accepted(m), dirty_prices(m))


@query("price_anomalies", """SELECT ticker, d, close, round(pct_change, 6) AS pct_change
    FROM prices WHERE abs(pct_change) > 40""", "d")
def price_anomalies(m: Market):
    return Q.price_anomalies(m.prices).select("ticker", "d", "close",
                                              F.round("pct_change", 6).alias("pct_change"))


TODAY_SQL = "(SELECT max(d) FROM price_daily)"
view("lagging_technicals", "SELECT asset_id, d FROM price_daily WHERE day(d) % 7 <> asset_id % 7")
view("gap_report", f"""SELECT ticker, count(*) AS missing_technical_days FROM price_daily p
    WHERE d >= {TODAY_SQL} - 30 AND NOT EXISTS (SELECT 1 FROM lagging_technicals t
      WHERE t.asset_id = p.asset_id AND t.d = p.d) GROUP BY 1""")
view("coverage_report", f"""SELECT p.ticker, count(*) AS trading_days,
      count(*) FILTER (WHERE coalesce(n.n, 0) = 0) AS zero_news_days,
      count(*) FILTER (WHERE coalesce(n.n, 0) = 0) >= count(*) AS thin
    FROM price_daily p LEFT JOIN (SELECT asset_id, published_d, count(*) AS n FROM mentions GROUP BY 1, 2) n
      ON n.asset_id = p.asset_id AND n.published_d = p.d
    WHERE p.d >= {TODAY_SQL} - 7 GROUP BY 1""")
view("freshness_row", """SELECT (SELECT max(d) FROM price_daily) AS latest_price,
    (SELECT max(published_d) FROM mentions) AS latest_news, (SELECT max(d) FROM sentiment_daily) AS latest_sentiment,
    (SELECT max(d) FROM lagging_technicals) AS latest_technical,
    DATE '2002-01-01' - (SELECT max(d) FROM price_daily) > 4 AS stale""")


def today(m: Market):
    return F.lit(m.today)


def lagging_technicals(m: Market):
    return m.price_daily.filter(F.dayofmonth("d") % 7 != F.col("asset_id") % 7).select("asset_id", "d")


def gap_report(m: Market):
    return Q.technical_gaps(m.price_daily, lagging_technicals(m), today(m))


def coverage_report(m: Market):
    return Q.coverage(m.price_daily, m.mentions, today(m))


def freshness_row(m: Market):
    return Q.freshness(m.price_daily, m.mentions, m.sentiment_daily, lagging_technicals(m), dt.date(2002, 1, 1))


@query("technical_gaps", "SELECT * FROM gap_report")
def technical_gaps(m: Market):
    return gap_report(m)


@query("news_coverage", "SELECT * FROM coverage_report")
def news_coverage(m: Market):
    return coverage_report(m)


@query("freshness", "SELECT * FROM freshness_row", "latest_price latest_news latest_sentiment latest_technical")
def freshness(m: Market):
    return freshness_row(m)


@query("dq_alerts", """SELECT 'check' AS kind, "check" AS subject, CAST(value AS VARCHAR) AS detail FROM scorecard WHERE value <> 0
    UNION ALL SELECT 'technical_gap', ticker, CAST(missing_technical_days AS VARCHAR) FROM gap_report
    UNION ALL SELECT 'no_news', ticker, CAST(zero_news_days AS VARCHAR) FROM coverage_report WHERE thin
    UNION ALL SELECT 'stale_price', 'price', CAST(latest_price AS VARCHAR) FROM freshness_row WHERE stale""")
def dq_alerts(m: Market):
    prices = cut_lineage(m.prices, "prices")
    days = kept_ledger(L.ledger(prices), "ledger-prices")
    lagging = kept_ledger(L.ledger(prices.filter(F.dayofmonth("d") % 7 != F.col("asset_id") % 7)), "ledger-technicals")
    news, index = kept_ledger(L.ledger(m.mentions, "published_d"), "ledger-news"), kept_ledger(index_ledger(m), "ledger-index")
    newest = L.rows_of(days).agg(F.max("last_d")).scalar()
    return Q.alerts(ledger_card(m, prices, index), L.technical_gaps(days, lagging, m.assets, newest),
                    L.coverage(days, news, m.assets, newest),
                    L.freshness(days, news, index, lagging, dt.date(2002, 1, 1)))


view("holed", "SELECT * FROM price_daily WHERE day(d) NOT IN (17, 18)")
view("holes", """SELECT CAST(u.d AS DATE) AS d FROM (SELECT unnest(generate_series(
      greatest((SELECT min(d) FROM holed), DATE '2000-10-01'), (SELECT max(d) FROM holed), INTERVAL 1 DAY)) AS d) u
    WHERE CAST(u.d AS DATE) NOT IN (SELECT d FROM holed)""")


def holed(m: Market):
    return m.price_daily.filter(~F.dayofmonth("d").isin(17, 18))


@query("calendar_gaps", "SELECT d FROM holes", "d")
def calendar_gaps(m: Market):
    return Q.calendar_gaps(holed(m), dt.date(2000, 10, 1))


@query("price_lookback", """g AS (SELECT min(d) AS gap FROM holes WHERE d >= DATE '2001-11-10' - 400),
    l AS (SELECT ticker, max(d) AS latest FROM holed GROUP BY 1),
    s AS (SELECT count(*) AS known, min({'latest': latest, 'ticker': ticker}) AS st FROM l),
    n AS (SELECT known, st, gap, DATE '2001-11-10' - st.latest AS stale, DATE '2001-11-10' - gap AS gd FROM s, g)
    SELECT CAST(greatest(14, least(400, CASE WHEN gd > stale THEN gd ELSE stale END + 5)) AS INTEGER) AS lookback,
      CASE WHEN gd > stale THEN 'missing price days from ' || CAST(gap AS VARCHAR)
           ELSE st.ticker || ' latest ' || CAST(st.latest AS VARCHAR) END AS reason FROM n""")
def price_lookback(m: Market):
    days = m.bar_days.filter(~F.dayofmonth("d").isin(17, 18))
    return L.lookback(kept_ledger(L.ledger(days), "ledger-holed"), m.assets, dt.date(2001, 11, 10), 25)


@query("month_ledger", """SELECT CAST(asset_id AS BIGINT) AS asset_id, strftime(d, '%Y-%m') AS ym, count(*) AS n,
      bit_or(1::BIGINT << day(d)) AS days, min(d) AS first_d, max(d) AS last_d,
      coalesce(bit_or(1::BIGINT << day(d)) FILTER (WHERE month(d) = 6 AND day(d) = 28), 0) AS twice,
      count(*) FILTER (WHERE close IS NULL) AS null_close, count(*) FILTER (WHERE close <= 0) AS non_positive,
      count(*) FILTER (WHERE close IS NOT NULL AND return_1d IS NULL) AS lost_return
    FROM dirty_prices GROUP BY ALL""", "first_d last_d")
def month_ledger(m: Market):
    # three batches, each merged into the ledger of those before it; copies of a day come in different batches
    rows = dirty_prices(m, cut_lineage(m.prices, "prices"))
    batch = (F.dayofmonth("d") + F.col("copy")) % 3
    parts = [L.ledger(rows.filter(batch == k), marks=L.price_marks()) for k in range(3)]
    whole = L.merge(L.merge(parts[0], parts[1]), parts[2])
    count = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
    entry = lambda c: F.max(F.when(F.col("what") == "rows", F.col(c))).alias(c)
    return whole.groupBy("asset_id", "ym").agg(
        *[entry(c) for c in ("n", "days", "first_d", "last_d", "twice")],
        *[count(w) for w in ("null_close", "non_positive", "lost_return")])


@query("coverage_profile", """n AS (SELECT ticker, count(*) AS n_news FROM mentions GROUP BY 1)
    SELECT p.ticker, count(*) AS n_rows, min(d) AS first_d, max(d) AS last_d,
      count(*) FILTER (WHERE close IS NULL) AS missing_close,
      round(coalesce(max(n.n_news), 0) / count(DISTINCT d), 6) AS news_per_day
    FROM dirty_prices p LEFT JOIN n ON n.ticker = p.ticker GROUP BY 1""", "first_d last_d")
def coverage_profile(m: Market):
    per_ticker = m.mentions.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_news"))
    rows = dirty_prices(m).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        F.count_if(F.col("close").isNull()).alias("missing_close"), F.countDistinct("d").alias("days"))
    rate = F.round(F.coalesce("n_news", F.lit(0)) / F.col("days"), 6)
    return rows.join(per_ticker, "ticker", "left").withColumn("news_per_day", rate).drop("days", "n_news")


@query("first_rows", "SELECT ticker, min(d) AS d FROM price_daily GROUP BY 1", "d")
def first_rows(m: Market):
    from marketloom.operators.returns import first_rows as flag
    return flag(m.price_daily).filter("is_first").select("ticker", "d")


@query("range_counters", """SELECT
    (SELECT count(*) FROM price_daily WHERE d BETWEEN DATE '1999-01-01' AND DATE '2000-12-31') AS price_rows,
    (SELECT count(*) FROM mentions WHERE published_d BETWEEN DATE '1999-01-01' AND DATE '2000-12-31') AS news_rows,
    (SELECT count(*) FROM sentiment_daily WHERE d BETWEEN DATE '1999-01-01' AND DATE '2000-12-31') AS senti_rows""")
def range_counters(m: Market):
    from marketloom.plans.dashboard import range_counters as counters
    return counters(m.price_daily, m.mentions, m.sentiment_daily, dt.date(1999, 1, 1), dt.date(2000, 12, 31))
