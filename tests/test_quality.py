import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import quality as Q

RUN = dt.date(2026, 9, 5)
ago = lambda n: RUN - dt.timedelta(days=n)


@pytest.mark.parametrize("latest,gap,expected,want,why", [
    ([1, 1], None, 2, 14, None),
    ([1, 30], None, 2, 35, "T1 latest"),
    ([1, 1], 40, 2, 45, "missing price days"),
    ([30, 1], 40, 2, 45, "missing price days"),
    ([50, 1], 40, 2, 55, "T0 latest"),
    ([1], None, 2, 400, "1 ticker(s)"),
    ([900, 1], None, 2, 400, "T0 latest"),
])
def test_lookback_rule(spark, latest, gap, expected, want, why):
    df = spark.createDataFrame([(f"T{i}", ago(n)) for i, n in enumerate(latest)], "ticker string, latest date")
    r = Q.choose_lookback(df, F.lit(ago(gap) if gap else None).cast("date"), RUN, expected).first()
    assert r.lookback == want
    assert r.reason is None if why is None else r.reason.startswith(why)


def test_lookback_on_an_empty_store(spark):
    empty = spark.createDataFrame([], "asset_id int, ticker string, d date")
    r = Q.lookback(empty, RUN, 3).first()
    assert (r.lookback, r.reason) == (400, "3 ticker(s) have no price history yet")


def prices(frame):
    rows = [(1, "CL=F", "2020-04-17", 18.0, None), (1, "CL=F", "2020-04-20", -37.63, -3.1), (1, "CL=F", "2020-04-21", 10.0, None),
            (2, "X", "2020-04-20", -1.0, None), (2, "X", "2020-04-21", None, None)]
    return frame(rows, "asset_id int, ticker string, d date, close double, return_1d double")


def test_scorecard(spark, frame):
    news = frame([("a", 0.5, "rss"), ("a", 1.5, "rss"), ("b", None, "synthetic")], "news_hash string, sentiment_score double, source_type string")
    senti = frame([(1, "2020-04-20"), (1, "2020-04-20")], "asset_id int, d date")
    card = Q.scorecard(prices(frame), news, senti, Q.accepted_table(spark))
    assert {r.check: (r.value, r.status) for r in card.collect()} == {
        "news_duplicates": (1, "FAIL"), "sentiment_out_of_range": (1, "FAIL"), "synthetic_news_contamination": (1, "FAIL"),
        "price_null_close": (1, "FAIL"), "duplicate_price_rows": (0, "PASS"), "duplicate_sentiment_rows": (1, "FAIL"),
        "non_positive_close_price": (1, "FAIL"), "price_null_return_with_close": (1, "FAIL")}


def test_accepted_pair_does_not_excuse_another_ticker(spark, frame):
    rows = Q.non_positive_closes(prices(frame), Q.accepted_table(spark)).collect()
    assert [(r.ticker, r.close) for r in rows] == [("X", -1.0)]
    assert Q.accepted_report(Q.accepted_table(spark), prices(frame)).first().close == -37.63
    stale = Q.accepted_report(Q.accepted_table(spark), prices(frame).filter("ticker = 'X'")).first()
    assert stale.close is None


def test_interior_gap(frame):
    df = frame([(d,) for d in ("2026-08-01", "2026-08-02", "2026-08-05")], "d date")
    assert [r.d.day for r in Q.calendar_gaps(df, ago(400)).orderBy("d").collect()] == [3, 4]
    assert Q.calendar_gaps(df, dt.date(2026, 8, 5)).count() == 0


def test_coverage_counts_thin_tickers(frame):
    px = frame([(1, "A", "2026-09-01"), (1, "A", "2026-09-02"), (2, "B", "2026-09-01"), (1, "A", "2026-08-01")], "asset_id int, ticker string, d date")
    news = frame([(1, "2026-09-01"), (1, "2026-09-01")], "asset_id int, published_d date")
    got = {r.ticker: (r.trading_days, r.zero_news_days, r.thin) for r in Q.coverage(px, news, F.lit(RUN)).collect()}
    assert got == {"A": (2, 1, False), "B": (1, 1, True)}


def test_freshness_limit(frame):
    d = frame([("2026-09-01", "2026-09-01")], "d date, published_d date")
    assert not Q.freshness(d, d, d, d, RUN).first().stale
    assert Q.freshness(d, d, d, d, RUN + dt.timedelta(days=1)).first().stale
    assert Q.freshness(d.limit(0), d, d, d, RUN).first().stale
