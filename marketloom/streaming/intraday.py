"""Intraday headline intake as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.functions.text import label_from_compound, news_hash
from marketloom.functions.params import FINANCE_OVERRIDES
from marketloom.operators.sentiment import daily_index, failure_policy, lexicon, lexicon_scores, rule_scores
from marketloom.session import cut_lineage
from marketloom.sources.store import Store

EVERY = "30 minutes"
LOOKBACK = "3 hours"
REBUILD_DAYS = 2


def headline_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                    files_per_batch: int | None = None) -> DataFrame:
    """Headline records as files arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def hashed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("news_hash", news_hash("ticker", "published_at", "title", "url"))


def fresh_unique(stream: DataFrame, lookback: str = LOOKBACK, now: str | None = None) -> DataFrame:
    """Headlines no older than the lookback, once each. The watermark follows
    the newest headline and bounds the dedup state; `now` adds the wall-clock
    bound ('current' or a timestamp)."""
    rows = hashed(stream)
    if now is not None:
        clock = F.current_timestamp() if now == "current" else F.to_timestamp(F.lit(now))
        rows = rows.filter(F.col("published_at") >= clock - F.expr(f"interval {lookback}"))
    return rows.withWatermark("published_at", lookback).dropDuplicatesWithinWatermark(["news_hash"])


def daily_counts(stream: DataFrame, lookback: str = LOOKBACK) -> DataFrame:
    """Tumbling one-day windows per ticker, for update-mode sinks."""
    day = F.window("published_at", "1 day")
    return (stream.withWatermark("published_at", lookback).groupBy(day, "ticker")
            .agg(F.count("sentiment_score").alias("news_count"), F.avg("sentiment_score").alias("sentiment_mean"))
            .select(F.to_date("window.start").alias("d"), "ticker", "news_count", "sentiment_mean"))


def keep_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there in update mode. The keys a batch changed are written
    under its number, so a replayed batch replaces its own files only."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return (counts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every day and ticker kept by `keep_counts`."""
    versions = spark.read.parquet(path)
    newest = F.max_by(F.struct("news_count", "sentiment_mean"), "version")
    return versions.groupBy("d", "ticker").agg(newest.alias("v")).select("d", "ticker", "v.*")


def lexicon_scorer(batch: DataFrame) -> DataFrame:
    """Plain sums of word valences: (news_hash, sentiment_score, sentiment_label)."""
    return lexicon_scores(batch, lexicon(), "news_hash", "title")


def rule_scorer(batch: DataFrame) -> DataFrame:
    """The default scorer: valences of the finance lexicon under the scoring rules."""
    return rule_scores(batch, lexicon(overrides=FINANCE_OVERRIDES), "news_hash", "title")


def store_batch(store: Store, batch: DataFrame, scorer: Callable[[DataFrame], DataFrame] = rule_scorer) -> None:
    """One micro-batch: unseen headlines are scored, appended, and the days they
    touch are aggregated again from all stored rows, so late rows correct their
    day. Replaying a batch changes nothing."""
    keys = cut_lineage(batch.dropDuplicates(["news_hash"]), "batch")
    stored = store.near("fact_news", keys).select("news_hash")
    new = keys.join(stored, "news_hash", "left_anti")
    if "sentiment_score" not in new.columns:
        new = cut_lineage(new, "batch-new")
        scored = new.join(scorer(new), "news_hash", "left")
        new = cut_lineage(failure_policy(scored), "batch-scored")
    elif "sentiment_label" not in new.columns:
        new = new.withColumn("sentiment_label", label_from_compound("sentiment_score"))
    store.insert_ignore("fact_news", new)
    # days come from the batch, not from `new`: a replay after a failure between
    # the two writes still repairs the index
    rebuild_days(store, keys.select("published_d").distinct())


def rebuild_days(store: Store, days: DataFrame) -> None:
    """Aggregate the given days again from the stored news and upsert them."""
    news = store.near("fact_news", days).join(days, "published_d", "left_semi")
    store.upsert("fact_sentiment_daily", daily_index(news))


def run_intraday_stream(spark: SparkSession, store: Store, headlines: DataFrame, checkpoint: str,
                        scorer: Callable[[DataFrame], DataFrame] = rule_scorer, now: str | None = None,
                        lookback: str = LOOKBACK, available_now: bool = False) -> StreamingQuery:
    """Poll every 30 minutes (or drain what is there) into the stored tables."""
    fresh = fresh_unique(headlines, lookback, now)
    writer = (fresh.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, _: store_batch(store, batch, scorer)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=EVERY)
    return writer.start()


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available now to Parquet files."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
