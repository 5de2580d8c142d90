import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.plans import daily, maintenance
from marketloom.session import scratch_path
from marketloom.sources import feeds, prices as S, store as ST
from marketloom.streaming import intraday, state

NOW = dt.datetime(2024, 3, 1, 2, 0)


@pytest.fixture
def store(spark):
    return ST.Store(spark, scratch_path(spark, "test-store"))


def bars(spark, tickers=("AAA", "BBB"), n=90, shift=0.0, end=dt.date(2024, 3, 1)):
    rows = [(t, end - dt.timedelta(days=n - 1 - i), 100.0 + k + i % 7 + shift, 10)
            for k, t in enumerate(tickers) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, d date, close double, volume bigint").withColumns(
        {c: F.col("close") for c in ("open", "high", "low", "adj_close")}).select(*S.COLUMNS)


def items(spark, rows):
    return spark.createDataFrame(rows, "ticker string, source_name string, base_url string, published_at timestamp, title string, url string")


def news(spark, day=28):
    at = dt.datetime(2024, 2, day, 23, 30)
    return items(spark, [("AAA", "Reuters", "http://r", at, "Profits surge", "u1"), ("AAA", "Reuters", "http://r", at, "Profits  SURGE ", "u1"),
                         ("BBB", "Some Blog", "http://b", at, "crash", "u2"), ("BBB", "CNBC", "http://c", at, "shares fall", "u3"),
                         ("AAA", "CNBC", "http://c", dt.datetime(2023, 1, 1), "too old", "u4")])


def inputs(spark, **over):
    base = dict(tickers=spark.createDataFrame([("AAA",), ("BBB",)], "ticker string"), primary=bars(spark), secondary=bars(spark, ("BBB", "CCC"), shift=5.0), items=news(spark))
    return daily.Inputs(**{**base, **over})


def snapshot(store, name):
    return sorted(map(str, store.read(name).collect()))


TABLES = ("dim_asset", "dim_source", "dim_date", "fact_price_daily", "fact_technical_daily", "fact_news", "fact_sentiment_daily")


def test_daily_job_twice_changes_nothing(spark, store):
    out = daily.run_daily(spark, store, inputs(spark), NOW)
    assert set(out) == set(daily.STAGES)
    first = {t: snapshot(store, t) for t in TABLES}
    assert store.read("fact_price_daily").count() == 180
    assert store.read("fact_price_daily").filter("return_1d IS NULL").count() == 2
    assert {(r.ticker, r.title) for r in store.read("fact_news").select("ticker", "title").collect()} == {("AAA", "Profits surge"), ("BBB", "shares fall")} or store.read("fact_news").count() == 2
    senti = {r.asset_id: (r.news_count, r.pos_count, r.neg_count) for r in store.read("fact_sentiment_daily").collect()}
    assert senti == {1: (1, 1, 0), 2: (1, 0, 1)}
    daily.run_daily(spark, store, inputs(spark), NOW)
    assert {t: snapshot(store, t) for t in TABLES} == first


def test_missing_ticker_comes_from_the_second_provider(spark, store):
    daily.run_daily(spark, store, inputs(spark, primary=bars(spark, ("AAA",))), NOW, stage="prices")
    b = store.read("fact_price_daily").filter("ticker = 'BBB'").orderBy("d").first()
    assert b.close == 105.0
    with pytest.raises(ValueError):
        daily.run_daily(spark, store, inputs(spark), NOW, stage="nope")


def test_dq_stage_reports_alerts(spark, store):
    daily.run_daily(spark, store, inputs(spark), NOW)
    late = {(r.kind, r.subject) for r in daily.stage_dq(store, dt.date(2024, 3, 20)).collect()}
    assert ("stale_price", "price") in late
    today = {r.kind for r in daily.stage_dq(store, dt.date(2024, 3, 1)).collect()}
    assert "stale_price" not in today and "check" not in today and "technical_gap" not in today


def test_run_date_is_local(spark):
    d = spark.range(1).select(daily.run_date(F.lit(dt.datetime(2024, 1, 1, 18, 0))).alias("d")).first().d
    assert d == dt.date(2024, 1, 2)


def test_upsert_touches_only_its_months(spark, store):
    maintenance.ensure_assets(store, spark.createDataFrame([("AAA",), ("BBB",)], "ticker string"))
    maintenance.load_prices(store, bars(spark))
    files = lambda: {r.f for r in spark.read.parquet(store.path("fact_price_daily")).select(F.input_file_name().alias("f")).distinct().collect() if "2024-01" in r.f}
    before = files()
    maintenance.load_prices(store, bars(spark, n=3, shift=50.0))
    assert files() == before
    assert store.read("fact_price_daily").count() == 180
    assert store.read("fact_price_daily").filter("close >= 150").count() == 6


def test_unknown_assets_and_null_closes_are_not_written(spark, store):
    maintenance.ensure_assets(store, spark.createDataFrame([("AAA",)], "ticker string"))
    maintenance.load_prices(store, bars(spark).withColumn("close", F.when(F.dayofmonth("d") != 5, F.col("close"))))
    got = store.read("fact_price_daily")
    assert got.select("ticker").distinct().count() == 1 and got.filter("close IS NULL").count() == 0 and got.count() == 87


def test_ids_continue(spark, store):
    a = maintenance.ensure_assets(store, spark.createDataFrame([("B",), ("A",)], "ticker string"))
    b = maintenance.ensure_assets(store, spark.createDataFrame([("C",), ("A",)], "ticker string"))
    assert {r.ticker: r.asset_id for r in a.collect()} == {"A": 1, "B": 2}
    assert {r.ticker: r.asset_id for r in b.collect()} == {"A": 1, "B": 2, "C": 3}


def test_source_keeps_its_url_and_refreshes_its_score(spark, store):
    cols = "source_name string, source_type string, base_url string"
    maintenance.ensure_sources(store, spark.createDataFrame([("Reuters", "rss", "http://old"), ("Blog", "rss", None)], cols))
    maintenance.ensure_sources(store, spark.createDataFrame([("Reuters", "rss", "http://new"), ("Blog", "rss", "http://b"), ("CNBC", "rss", None)], cols))
    got = {r.source_name: (r.source_id, r.base_url, r.credibility_score) for r in store.read("dim_source").collect()}
    assert got == {"Blog": (1, "http://b", 5.0), "Reuters": (2, "http://old", 9.5), "CNBC": (3, None, 8.5)}


def test_purge_rebuilds_exactly_the_touched_days(spark, store):
    daily.run_daily(spark, store, inputs(spark, trusted=()), NOW)
    before = snapshot(store, "fact_sentiment_daily")
    dry = maintenance.purge_untrusted(store, dry_run=True).first()
    assert (dry.deleted, dry.affected, dry.rebuilt, dry.zero) == (1, 1, 1, 0)
    assert snapshot(store, "fact_sentiment_daily") == before
    maintenance.purge_untrusted(store)
    assert store.read("fact_news").filter("title = 'crash'").count() == 0
    two = store.read("fact_sentiment_daily").filter("asset_id = 2").first()
    assert (two.news_count, two.neg_count) == (1, 1)
    again = maintenance.purge_untrusted(store).first()
    assert again.deleted == 0
    with pytest.raises(ValueError):
        maintenance.purge_untrusted(store, trusted=[])


def test_day_without_news_leaves_no_row(spark, store):
    daily.run_daily(spark, store, inputs(spark, trusted=()), NOW)
    maintenance.purge_untrusted(store, trusted=["cnbc"])
    assert {r.asset_id for r in store.read("fact_sentiment_daily").collect()} == {2}


def test_reload_refuses_an_empty_batch(spark, store):
    row = spark.createDataFrame([(1, "A", dt.date(2020, 3, 31), "yahoo"), (1, "A", dt.date(2020, 6, 30), "manual")], "asset_id bigint, ticker string, fiscal_period_end date, source string")
    store.upsert("fact_fundamentals_quarterly", row)
    with pytest.raises(ValueError):
        maintenance.reload_statements(store, row.limit(0), ["yahoo"])
    new = row.limit(1).withColumns({"source": F.lit("edgar"), "fiscal_period_end": F.lit(dt.date(2020, 9, 30))})
    rep = {r.source: (r.n_before, r.n_after) for r in maintenance.reload_statements(store, new, ["yahoo", "edgar"]).collect()}
    assert rep == {"yahoo": (1, 0), "manual": (1, 1), "edgar": (0, 1)}
    assert {r.source for r in store.read("fact_fundamentals_quarterly").collect()} == {"manual", "edgar"}


def test_watchlist_ignores_repeats(spark, store):
    maintenance.ensure_assets(store, spark.createDataFrame([("A",), ("B",)], "ticker string"))
    for i, t in enumerate(("A", "B", "A")):
        maintenance.watch(store, t, dt.datetime(2024, 1, 1 + i))
    assert [r.ticker for r in maintenance.watchlist(store).collect()] == ["B", "A"]
    maintenance.unwatch(store, "B")
    assert [r.ticker for r in maintenance.watchlist(store).collect()] == ["A"]


def test_signals_are_logged_on_first_sight_and_flip(spark, store):
    maintenance.ensure_assets(store, spark.createDataFrame([("A",), ("B",)], "ticker string"))
    maintenance.watch(store, "A", dt.datetime(2024, 1, 1))
    seen = []
    for day, signal in ((1, "UP"), (2, "UP"), (3, "DOWN")):
        rows = [(1, "A", signal, 0.6, dt.datetime(2024, 1, day)), (2, "B", signal, 0.6, dt.datetime(2024, 1, day))]
        now = spark.createDataFrame(rows, "asset_id bigint, ticker string, signal string, confidence double, checked_at timestamp")
        seen += [(r.ticker, r.signal, r.previous_signal, r.changed) for r in maintenance.check_signals(store, now).collect()]
    assert seen == [("A", "UP", None, False), ("A", "UP", "UP", False), ("A", "DOWN", "UP", True)]
    assert store.read("fact_watchlist_signal_log").count() == 2


def test_gap_fill_is_real_rows_only(spark, store):
    maintenance.ensure_assets(store, spark.createDataFrame([("AAA",)], "ticker string"))
    full = bars(spark, ("AAA",))
    maintenance.load_prices(store, full.filter(~F.dayofmonth("d").isin(6, 7)))
    start, end = dt.date(2024, 2, 1), dt.date(2024, 2, 29)
    fetched = full.filter(F.dayofmonth("d") == 6)
    dry = maintenance.fill_gaps(store, fetched, start, end, dry_run=True).first()
    assert (dry.n_filled, dry.n_skipped) == (1, 1) and store.read("fact_price_daily").filter("d = '2024-02-06'").count() == 0
    maintenance.fill_gaps(store, fetched, start, end)
    assert store.read("fact_price_daily").filter("d = '2024-02-06'").count() == 1
    seven = store.read("fact_price_daily").filter("d = '2024-02-08'").first()
    assert seven.return_1d is not None


def test_replayed_stream_batch_changes_nothing(spark, store):
    rows = news(spark).withColumns({"asset_id": F.lit(1).cast("bigint"), "published_d": F.to_date("published_at")})
    batch = intraday.hashed(rows)
    intraday.store_batch(store, batch)
    first = snapshot(store, "fact_sentiment_daily")
    intraday.store_batch(store, batch)
    assert snapshot(store, "fact_sentiment_daily") == first and store.read("fact_news").count() == 4


def test_feed_files_and_dates(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>"
                                       "<item><title>B</title><pubDate>Sat, 2 Mar 2024 12:00:00 +0200</pubDate><source url='http://p'>Pub</source></item></channel></rss>")
    assert {r.title for r in feeds.read_items(spark, str(tmp_path)).collect()} == {"A", "B"}
    texts = ["Fri, 01 Mar 2024 10:00:00 GMT", "Sat, 2 Mar 2024 12:00:00 +0200", "2024-03-01T10:00:00Z", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", feeds.instant(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [dt.datetime(2024, 3, 1, 10), dt.datetime(2024, 3, 2, 10), dt.datetime(2024, 3, 1, 10), None, None]


def test_state_keeps_the_last_signal_between_batches(spark, tmp_path):
    schema = "asset_id int, ticker string, checked_at timestamp, signal string, confidence double"
    inbox, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    at = lambda d: dt.datetime(2024, 1, d)
    rounds = [[(1, "A", at(1), "UP", .6), (1, "A", at(2), "UP", .6)], [(1, "A", at(3), "DOWN", .7), (2, "B", at(3), "UP", .5)], [(1, "A", at(2), "UP", .9)], [(1, "A", at(4), "DOWN", .7)]]
    for rows in rounds:
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(inbox)
        q = intraday.to_files(state.signal_changes(intraday.headline_stream(spark, inbox, df.schema)), out, ck)
        q.awaitTermination()
    got = sorted((r.ticker, r.checked_at.day, r.signal, r.previous_signal, r.changed) for r in spark.read.parquet(out).collect())
    assert got == [("A", 1, "UP", None, False), ("A", 3, "DOWN", "UP", True), ("B", 3, "UP", None, False)]
