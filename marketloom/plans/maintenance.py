"""Maintenance jobs over the table store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from marketloom.functions import params as P
from marketloom.functions.text import credibility
from marketloom.operators import news as N
from marketloom.operators.returns import changed_returns
from marketloom.operators.signals import against_log
from marketloom.operators.technicals import indicators, usable_ranges
from marketloom.session import cut_lineage
from marketloom.sources import prices as S
from marketloom.sources.store import Store, assign_ids, calendar_fields, coalesce_upsert, counts_by, \
    purge_sources, replace_by


def ensure_assets(store: Store, tickers: DataFrame) -> DataFrame:
    """Register new tickers; returns (asset_id, ticker) of all assets."""
    ids = assign_ids(store.read("dim_asset"), tickers, "asset_id", "ticker")
    store.insert_ignore("dim_asset", ids)
    return store.read("dim_asset").select("asset_id", "ticker")


def ensure_dates(store: Store, days: DataFrame) -> None:
    store.insert_ignore("dim_date", calendar_fields(days.select("d").distinct()))


def ensure_sources(store: Store, named: DataFrame) -> DataFrame:
    """Register publishers (source_name, source_type, base_url): the score is
    always refreshed, a known base URL stays."""
    known = store.read("dim_source")
    seen = (named.groupBy("source_name", "source_type").agg(F.max("base_url").alias("base_url"))
            .withColumn("credibility_score", credibility("source_name")))
    keyed = seen.withColumn("_k", F.concat_ws("|", "source_name", "source_type"))
    ids = assign_ids(known.withColumn("_k", F.concat_ws("|", "source_name", "source_type")), keyed, "source_id", "_k")
    old = known.select("source_id", "source_name", "source_type")
    new = keyed.join(ids, "_k").select("source_id", "source_name", "source_type")
    batch = seen.join(old.unionByName(new), ["source_name", "source_type"]).select(
        "source_id", "source_name", "source_type", "base_url", "credibility_score")
    store.write("dim_source", coalesce_upsert(known, batch, ["source_name", "source_type"], keep_old=["base_url", "source_id"]))
    return store.read("dim_source")


def load_prices(store: Store, bars: DataFrame) -> None:
    """Upsert bars of known assets; rows without a close are never written."""
    assets = store.read("dim_asset").select("asset_id", "ticker")
    rows = bars.filter(F.col("close").isNotNull()).join(assets, "ticker")
    store.upsert("fact_price_daily", rows)


def repair_returns(store: Store) -> int:
    """Recompute returns from the full history, rewriting only rows that differ."""
    stored = store.read("fact_price_daily")
    changed = changed_returns(stored).drop("old_return", "old_pct")
    n = changed.count()
    if n:
        store.upsert("fact_price_daily", changed)
    return n


def rebuild_technicals(store: Store, tickers: list[str] | None = None) -> DataFrame:
    """Indicators from the full history of all or the given tickers; returns the
    usable range per ticker."""
    px = store.read("fact_price_daily")
    if tickers:
        px = px.filter(F.col("ticker").isin(tickers))
    rows = indicators(px)
    if tickers:
        store.upsert("fact_technical_daily", rows)
    else:
        store.write("fact_technical_daily", rows)
    return usable_ranges(store.read("fact_technical_daily"))


def backfill_history(store: Store, primary: DataFrame, secondary: DataFrame, requested: DataFrame) -> DataFrame:
    """Load provider history with fallback and report the range per ticker."""
    bars = S.with_fallback(primary, secondary)
    ensure_assets(store, requested)
    load_prices(store, bars)
    repair_returns(store)
    return S.history_summary(store.read("fact_price_daily"), requested)


def fill_gaps(store: Store, fetched: DataFrame, start: dt.date, end: dt.date, dry_run: bool = False) -> DataFrame:
    filled = S.gap_fill(store.read("fact_price_daily").select("ticker", "d"), fetched, start, end)
    summary = S.gap_fill_summary(filled)
    if not dry_run:
        rows = filled.filter("filled").drop("filled")
        summary = cut_lineage(summary, "gap-summary")
        load_prices(store, rows)
        repair_returns(store)
    return summary


def purge_untrusted(store: Store, trusted: list[str] = P.TRUSTED_PUBLISHERS, dry_run: bool = False) -> DataFrame:
    """Remove news of publishers outside the trusted list and rebuild the
    touched days; returns the report."""
    news, sources = store.read("fact_news"), store.read("dim_source")
    bad = N.untrusted_sources(news, sources, trusted, P.PLACEHOLDER_PUBLISHERS)
    return _purge(store, news, bad, dry_run)


def purge_synthetic(store: Store, dry_run: bool = False) -> DataFrame:
    bad = store.read("dim_source").filter(F.col("source_type") == "synthetic")
    return _purge(store, store.read("fact_news"), bad, dry_run)


def _purge(store: Store, news: DataFrame, bad: DataFrame, dry_run: bool) -> DataFrame:
    """Deletes and rebuilds touch only the months that hold a purged headline."""
    out = purge_sources(news, store.read("fact_sentiment_daily"), bad)
    report = cut_lineage(out.report, "purge-report")
    if not dry_run:
        hashes, pairs, rebuilt = (cut_lineage(out.removed.select("news_hash"), "purged"),
                                  cut_lineage(out.pairs, "purged-days"), cut_lineage(out.rebuilt, "rebuilt"))
        store.delete("fact_news", hashes)
        store.delete("fact_sentiment_daily", pairs)
        store.upsert("fact_sentiment_daily", rebuilt)
    return report


def reload_statements(store: Store, batch: DataFrame, managed: list[str], dry_run: bool = False) -> DataFrame:
    """Replace all statements of the managed providers; returns counts per
    provider before and after."""
    before = store.read("fact_fundamentals_quarterly")
    batch = store.conform("fact_fundamentals_quarterly", batch)
    after = replace_by(before, batch, "source", managed)
    report = counts_by(before, after, "source")
    report = cut_lineage(report, "reload-report")
    if not dry_run:
        store.write("fact_fundamentals_quarterly", after)
    return report


def load_statements(store: Store, statements: DataFrame, provider: str) -> DataFrame:
    """Upsert statements stamped with their provider; returns the period range
    per asset, with assets that have none listed as skipped."""
    assets = store.read("dim_asset").select("asset_id", "ticker")
    rows = statements.withColumn("source", F.lit(provider)).join(assets, "ticker")
    store.upsert("fact_fundamentals_quarterly", rows)
    return statement_summary(store.read("fact_fundamentals_quarterly").filter(F.col("source") == provider), assets)


def statement_summary(statements: DataFrame, assets: DataFrame) -> DataFrame:
    got = statements.groupBy("ticker").agg(F.min("fiscal_period_end").alias("first_d"),
                                           F.max("fiscal_period_end").alias("last_d"), F.count(F.lit(1)).alias("n"))
    return assets.select("ticker").join(got, "ticker", "left").withColumns({
        "skipped": F.col("n").isNull(), "n": F.coalesce("n", F.lit(0))})


def watch(store: Store, ticker: str, now) -> None:
    """Add to the watchlist; a ticker already on it stays as it is."""
    rows = store.read("dim_asset").filter(F.col("ticker") == ticker).select(
        "asset_id", "ticker", F.lit(now).cast("timestamp").alias("added_at"))
    store.insert_ignore("dim_watchlist", rows)


def unwatch(store: Store, ticker: str) -> None:
    keys = store.read("dim_asset").filter(F.col("ticker") == ticker).select("asset_id")
    store.delete("dim_watchlist", keys)


def watchlist(store: Store) -> DataFrame:
    return store.read("dim_watchlist").select("ticker", "added_at").orderBy(F.desc("added_at"), "ticker")


def check_signals(store: Store, current: DataFrame) -> DataFrame:
    """Compare the watched tickers' latest signals (asset_id, ticker, signal,
    confidence, checked_at) with the log, append first sights and flips, and
    return the checked rows; `changed` marks the alerts."""
    watched = current.join(store.read("dim_watchlist").select("asset_id"), "asset_id", "left_semi")
    checked, to_log = against_log(watched, store.read("fact_watchlist_signal_log"))
    checked, to_log = cut_lineage(checked, "signals"), cut_lineage(to_log, "signal-log")
    store.insert_ignore("fact_watchlist_signal_log", to_log)
    return checked
