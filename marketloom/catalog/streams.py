"""Streaming queries. The given rows arrive in a folder in a few rounds, in time
order; after each round the stream drains what came. `stream_admission` and
`stream_ordered_changes` start one stream over rows in any order. The SQL form is
the batch result over all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.catalog.base import query
from marketloom.catalog.maintenance import daily_signal
from marketloom.functions.numeric import r
from marketloom.session import cut_lineage, scratch_path
from marketloom.sources.store import Store
from marketloom.sources.tables import Market
from marketloom.streaming import intraday as I
from marketloom.streaming import state
from marketloom.streaming.admission import HELD, KEPT, LATE, UNDATED, Admission, run_admitted_stream


def arrive(rows: DataFrame, round_: Column, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Deliver `rows` round by round and drain the stream after each."""
    spark = rows.sparkSession
    staged, inbox = scratch_path(spark, "staged"), scratch_path(spark, "inbox")
    rows.withColumn("_round", round_).write.partitionBy("_round").parquet(staged)
    whole = spark.read.parquet(staged)
    for (n,) in whole.select("_round").distinct().orderBy("_round").collect():
        whole.filter(F.col("_round") == n).select(*rows.columns).write.mode("append").parquet(inbox)
        start(I.headline_stream(spark, inbox, rows.schema)).awaitTermination()


def drained(rows: DataFrame, round_: Column, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = rows.sparkSession
    out, state_path = scratch_path(spark, "drained"), scratch_path(spark, "drained-state")
    arrive(rows, round_, lambda stream: I.to_files(build(stream), out, state_path))
    return spark.read.parquet(out)


def decade() -> Column:
    """Rounds of ten days."""
    return F.floor(F.dayofmonth("published_d") / 10).cast("int")


@query("stream_unique_headlines", "SELECT event_id, ticker, published_at, title FROM headlines")
def stream_unique_headlines(m: Market):
    # every headline arrives twice in its round; the whole span is the lookback, nothing is late
    twice = m.headlines.unionByName(m.headlines)
    return drained(twice, decade(), lambda s: I.fresh_unique(s, "60 days").select("event_id", "ticker", "published_at", "title"))


@query("stream_recent_headlines", """SELECT event_id, published_at FROM headlines WHERE published_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 72 HOUR""")
def stream_recent_headlines(m: Market):
    return drained(m.headlines, decade(), lambda s: I.fresh_unique(s, "72 hours", now="2024-01-30 00:00:00").select("event_id", "published_at"))


@query("stream_daily_index", """SELECT ticker, published_d AS d, count(sentiment_score) AS news_count, round(avg(sentiment_score), 9) + 0.0 AS sentiment_mean,
    count(*) FILTER (WHERE sentiment_score >= 0.05) AS pos_count FROM headlines GROUP BY 1, 2""", "d")
def stream_daily_index(m: Market):
    store, checkpoint = Store(m.spark, scratch_path(m.spark, "store")), scratch_path(m.spark, "intraday")
    # rounds cut through days, so later rows correct a day that is already stored
    arrive(m.headlines, F.floor((F.dayofyear("published_d") * 24 + F.hour("published_at")) / 250).cast("int"),
           lambda s: I.run_intraday_stream(m.spark, store, s, checkpoint, lookback="60 days", available_now=True))
    return store.read("fact_sentiment_daily").select(
        F.concat(F.lit("Brand#"), F.col("asset_id").cast("string")).alias("ticker"), "d", "news_count",
        r("sentiment_mean", 9).alias("sentiment_mean"), "pos_count")


@query("stream_daily_counts", """SELECT published_d AS d, ticker, count(sentiment_score) AS news_count, round(avg(sentiment_score), 9) + 0.0 AS sentiment_mean
    FROM headlines GROUP BY 1, 2""", "d")
def stream_daily_counts(m: Market):
    # rounds cut through days: a later round corrects the rows of the day that an earlier one left
    out, checkpoint = scratch_path(m.spark, "counts"), scratch_path(m.spark, "counts-state")
    arrive(m.headlines, F.floor((F.dayofyear("published_d") * 24 + F.hour("published_at")) / 250).cast("int"),
           lambda s: I.keep_counts(I.daily_counts(s), out, checkpoint))
    return I.latest_counts(m.spark, out).withColumn("sentiment_mean", r("sentiment_mean", 9))


@query("stream_signal_changes", """SELECT ticker, d, signal, previous_signal, previous_signal IS NOT NULL AS changed FROM (SELECT *, lag(signal) OVER (PARTITION BY asset_id ORDER BY d) AS previous_signal FROM daily_signal)
    WHERE previous_signal IS NULL OR previous_signal <> signal""", "d")
def stream_signal_changes(m: Market):
    checks = daily_signal(m).select("asset_id", "ticker", F.col("d").cast("timestamp").alias("checked_at"), "signal", F.lit(0.5).alias("confidence"))
    out = drained(checks, F.floor((F.year("checked_at") - 1995) / 2).cast("int"), state.signal_changes)
    return out.select("ticker", F.to_date("checked_at").alias("d"), "signal", "previous_signal", "changed")


def filed(rows: DataFrame, files: int) -> str:
    """The rows as files, dealt without any order."""
    path = scratch_path(rows.sparkSession, "filed")
    rows.repartition(files).write.parquet(path)
    return path


@query("stream_admission", """a AS (SELECT ticker, published_at, published_at + to_minutes(event_id * 37 % 400 - 10) AS arrived_at FROM headlines),
    v AS (SELECT ticker, CASE WHEN published_at < arrived_at - INTERVAL 3 HOUR THEN 'late'
      WHEN published_at > (SELECT max(arrived_at) FROM a) + INTERVAL 5 MINUTE THEN 'held' ELSE 'kept' END AS verdict FROM a)
    SELECT ticker, verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def stream_admission(m: Market):
    """Headlines that came up to ten minutes before and six hours after their own
    stamps, under the default lookback of 3 hours."""
    minutes = F.make_interval(mins=F.col("event_id") * 37 % 400 - 10)
    rows = m.headlines.select("event_id", "ticker", "published_at", (F.col("published_at") + minutes).alias("arrived_at"))
    side = Admission(m.spark, scratch_path(m.spark, "admission"), rows.schema)
    stream = I.headline_stream(m.spark, filed(rows, 8), rows.schema, files_per_batch=4)
    run_admitted_stream(stream, side, scratch_path(m.spark, "admission-state"), available_now=True).awaitTermination()
    parts = [side.rows(v).groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.lit(v)) for v in (KEPT, LATE, UNDATED, HELD)]
    return reduce(DataFrame.unionByName, parts).select("ticker", "verdict", "n")


@query("stream_ordered_changes", """SELECT ticker, d, signal, previous_signal, previous_signal IS NOT NULL AS changed FROM (SELECT *, lag(signal) OVER (PARTITION BY asset_id ORDER BY d) AS previous_signal FROM daily_signal)
    WHERE previous_signal IS NULL OR previous_signal <> signal""", "d")
def stream_ordered_changes(m: Market):
    """All checks in no order; a row of no asset a year on moves the clock past the last of them."""
    checks = daily_signal(m).select("asset_id", "ticker", F.col("d").cast("timestamp").alias("checked_at"), "signal", F.lit(0.5).alias("confidence"))
    checks = cut_lineage(checks, "checks")
    clock = checks.agg((F.max("checked_at") + F.expr("interval 1 year")).alias("checked_at"))
    rows = checks.unionByName(clock, allowMissingColumns=True)
    out, checkpoint = scratch_path(m.spark, "ordered"), scratch_path(m.spark, "ordered-state")
    with state.typed_state(m.spark):
        running = I.to_files(state.ordered_signal_changes(I.headline_stream(m.spark, filed(rows, 8), rows.schema)), out, checkpoint)
    running.awaitTermination()
    return m.spark.read.schema(state.CHANGES).parquet(out).select("ticker", F.to_date("checked_at").alias("d"), "signal", "previous_signal", "changed")
