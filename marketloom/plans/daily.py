"""The daily job: prices, news and data-quality stages over the table store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketloom.functions import params as P
from marketloom.functions.text import news_hash, trusted
from marketloom.operators import news as N
from marketloom.operators import ledger as L
from marketloom.operators import quality as Q
from marketloom.plans import maintenance as M
from marketloom.session import cut_lineage
from marketloom.sources import prices as S
from marketloom.sources.store import Store
from marketloom.streaming.intraday import rebuild_days, rule_scorer, store_batch

STAGES = ("prices", "news", "dq")
ZONE = "Asia/Bangkok"


@dataclass(frozen=True)
class Inputs:
    """What the providers delivered: bars of the primary and the secondary
    provider, parsed feed rows (ticker, source_name, base_url, published_at,
    title, url) and the tickers that are followed."""
    tickers: DataFrame
    primary: DataFrame
    secondary: DataFrame
    items: DataFrame
    scorer: Callable[[DataFrame], DataFrame] = rule_scorer
    trusted: tuple[str, ...] = tuple(P.TRUSTED_PUBLISHERS)


def run_date(now: Column, zone: str = ZONE) -> Column:
    """Calendar date of an instant where the job is run."""
    return F.to_date(F.from_utc_timestamp(now, zone))


def run_daily(spark: SparkSession, store: Store, inputs: Inputs, now: dt.datetime,
              stage: str | None = None, zone: str = ZONE) -> dict[str, DataFrame]:
    """Run one stage or all in order; returns each stage's report."""
    if stage is not None and stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    run_d = spark.range(1).select(run_date(F.lit(now), zone)).first()[0]
    jobs = {"prices": lambda: stage_prices(store, inputs, run_d),
            "news": lambda: stage_news(store, inputs, now, run_d),
            "dq": lambda: stage_dq(store, run_d)}
    return {name: jobs[name]() for name in ([stage] if stage else STAGES)}


def stage_prices(store: Store, inputs: Inputs, run_d: dt.date) -> DataFrame:
    """Fetch as far back as the stored gaps ask for, upsert, repair returns
    against the full history and rebuild the indicators."""
    followed = store.read("dim_asset").select("asset_id", "ticker").join(inputs.tickers, "ticker", "left_semi")
    entries = store.ledger("fact_price_daily").join(followed, "asset_id", "left_semi")
    decision = L.lookback(entries, followed, run_d, inputs.tickers.count()).first()
    start = run_d - dt.timedelta(days=decision.lookback)
    recent = lambda df: df.filter(F.col("d").between(F.lit(start), F.lit(run_d))).join(inputs.tickers, "ticker", "left_semi")
    bars = cut_lineage(S.with_fallback(recent(inputs.primary), recent(inputs.secondary)), "bars")
    M.ensure_assets(store, inputs.tickers)
    M.ensure_dates(store, bars)
    M.load_prices(store, bars)
    M.repair_returns(store)
    return M.rebuild_technicals(store).withColumns({
        "lookback": F.lit(decision.lookback), "reason": F.lit(decision.reason).cast("string")})


def stage_news(store: Store, inputs: Inputs, now: dt.datetime, run_d: dt.date, hours: int = 2160) -> DataFrame:
    """Trusted headlines inside the lookback, only unseen ones scored, and the
    index of the window rebuilt from all stored news."""
    wanted = N.since(inputs.items.filter(trusted("source_name", list(inputs.trusted))), F.lit(now), hours)
    assets = M.ensure_assets(store, inputs.tickers)
    rows = cut_lineage(
        wanted.join(assets, "ticker").withColumn("source_type", F.lit("rss"))
        .withColumn("published_d", F.to_date("published_at"))
        .withColumn("news_hash", news_hash("ticker", "published_at", "title", "url")), "items")
    if rows.isEmpty():
        return store.read("fact_sentiment_daily").limit(0)
    sources = M.ensure_sources(store, rows.select("source_name", "source_type", "base_url"))
    keyed = rows.join(sources.select("source_id", "source_name", "source_type"), ["source_name", "source_type"])
    store_batch(store, keyed, inputs.scorer)
    window = N.rebuild_window(store.read("fact_news"), F.lit(run_d), hours)
    rebuild_days(store, window.select("published_d").distinct())
    return store.read("fact_sentiment_daily")


def dq_report(store: Store, run_d: dt.date) -> DataFrame:
    """The scorecard of the stored tables, read from their ledgers."""
    return L.scorecard(store.ledger("fact_price_daily"), store.ledger("fact_news"), store.ledger("fact_sentiment_daily"),
                       Q.accepted_table(store.spark), store.read("dim_asset"), sources_of(store, "synthetic"))


def sources_of(store: Store, source_type: str) -> DataFrame:
    """References of the sources of one type, as ledgers hold them."""
    sources = store.read("dim_source").filter(F.col("source_type") == source_type)
    return sources.select(F.col("source_id").cast("string").alias("ref"))


def stage_dq(store: Store, run_d: dt.date) -> DataFrame:
    """Alert rows of what the tables hold now, whatever ran before. Ledgers are
    read, no rows."""
    prices, news, senti, tech = [store.ledger(name) for name in (
        "fact_price_daily", "fact_news", "fact_sentiment_daily", "fact_technical_daily")]
    rss = news.join(sources_of(store, "rss"), "ref", "left_semi")
    today, assets = F.lit(run_d), store.read("dim_asset")
    return Q.alerts(dq_report(store, run_d), L.technical_gaps(prices, tech, assets, today),
                    L.coverage(prices, rss, assets, today), L.freshness(prices, news, senti, tech, run_d))


def run_intraday_batch(store: Store, items: DataFrame, run_d: dt.date, scorer=rule_scorer, days: int = 2) -> None:
    """One poll without a stream: store the items and rebuild from run_d - days."""
    store_batch(store, items, scorer)
    recent = store.read("fact_news").filter(F.col("published_d") >= F.date_sub(F.lit(run_d), days))
    rebuild_days(store, recent.select("published_d").distinct())
