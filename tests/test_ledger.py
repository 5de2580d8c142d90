import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger as L
from marketloom.operators import quality as Q
from marketloom.session import scratch_path
from marketloom.sources import store as ST

PRICE = "asset_id bigint, ticker string, d date, close double, return_1d double"
ROWS = [(1, "CL=F", "2020-04-17", 18.0, None), (1, "CL=F", "2020-04-20", -37.63, -3.1), (1, "CL=F", "2020-04-21", 10.0, None),
        (1, "CL=F", "2020-05-04", 11.0, 0.1), (2, "X", "2020-04-20", -1.0, None), (2, "X", "2020-04-21", None, None),
        (2, "X", "2020-05-05", 3.0, 0.2), (2, "X", "2020-05-05", 3.0, 0.2), (2, "X", "2020-05-05", 3.0, 0.2)]
NEWS = [("a", 1, 5, "2020-04-20", 0.5), ("a", 1, 5, "2020-04-20", 1.5), ("b", 2, 7, "2020-05-05", None), ("c", 1, 7, "2020-05-04", -2.0)]


def news(frame, rows=NEWS):
    return frame(rows, "news_hash string, asset_id bigint, source_id bigint, published_d date, sentiment_score double")


def assets(frame):
    return frame([(1, "CL=F"), (2, "X")], "asset_id bigint, ticker string")


def entries(df):
    return sorted(map(str, df.collect()))


def test_parts_merge_to_the_ledger_of_the_whole(frame):
    whole = L.ledger(frame(ROWS, PRICE), marks=L.price_marks())
    merged = None
    for k in range(3):  # copies of a day come in one part and in several
        part = L.ledger(frame(ROWS[k::3], PRICE), marks=L.price_marks())
        merged = part if merged is None else L.merge(merged, part)
    assert entries(merged) == entries(whole)


def test_scorecard_equals_the_rows(spark, frame):
    px, nw = frame(ROWS, PRICE), news(frame)
    senti = frame([(1, "2020-04-20"), (1, "2020-04-20"), (2, "2020-04-20")], "asset_id bigint, d date")
    typed = nw.withColumn("source_type", F.when(F.col("source_id") == 7, "synthetic").otherwise("rss"))
    want = Q.scorecard(px, typed, senti, Q.accepted_table(spark))
    synthetic = spark.createDataFrame([("7",)], "ref string")
    got = L.scorecard(L.ledger(px, marks=L.price_marks()),
                      L.ledger(nw, "published_d", "source_id", L.news_marks(), "news_hash"),
                      L.ledger(senti), Q.accepted_table(spark), assets(frame), synthetic)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert {r.check: r.value for r in got.collect()}["non_positive_close_price"] == 1


def test_scorecard_of_nothing_passes(spark, frame):
    none = L.ledger(frame([], PRICE), marks=L.price_marks())
    card = L.scorecard(none, none, none, Q.accepted_table(spark), assets(frame), spark.createDataFrame([], "ref string"))
    rows = card.collect()
    assert len(rows) == 8 and {(r.value, r.status) for r in rows} == {(0, "PASS")}


@pytest.mark.parametrize("back", [0, 1, 14, 15, 16, 40, 400])
def test_reports_equal_the_rows_for_every_window(frame, back):
    px = frame(ROWS[:7], PRICE)
    tech = frame([(1, "2020-04-20"), (2, "2020-05-05")], "asset_id bigint, d date")
    today, nw = F.lit(dt.date(2020, 5, 5)), news(frame)
    p, t, n = L.ledger(px), L.ledger(tech), L.ledger(nw, "published_d", "source_id")
    assert entries(L.technical_gaps(p, t, assets(frame), today, back)) == entries(Q.technical_gaps(px, tech, today, back))
    cols = ["ticker", "trading_days", "zero_news_days", "thin"]
    assert entries(L.coverage(p, n, assets(frame), today, back).select(cols)) == entries(
        Q.coverage(px, nw, today, back).select(cols))


def test_lookback_and_gaps_equal_the_rows(frame):
    px = frame(ROWS[:7], PRICE).filter("ticker IS NOT NULL")
    for horizon in (dt.date(2019, 1, 1), dt.date(2020, 4, 21), dt.date(2021, 1, 1)):
        assert entries(L.calendar_gaps(L.ledger(px), horizon)) == entries(Q.calendar_gaps(px, horizon))
    for run_d, n in ((dt.date(2020, 5, 6), 2), (dt.date(2020, 5, 6), 3), (dt.date(2021, 5, 20), 2)):
        assert L.lookback(L.ledger(px), assets(frame), run_d, n).first() == Q.lookback(px, run_d, n).first()
    empty = L.lookback(L.ledger(px.limit(0)), assets(frame), dt.date(2020, 5, 6), 2).first()
    assert empty.lookback == 400 and empty.reason.startswith("2 ticker(s)")


def test_rows_without_a_day_are_counted_on_no_day(frame):
    one = L.ledger(frame([(1, "A", None, -1.0, None)], PRICE), marks=L.price_marks())
    got = {r.what: (r.n, r.days, r.ym) for r in one.collect()}
    assert got == {"rows": (1, None, None), "non_positive": (1, None, None), "lost_return": (1, None, None)}


def store_with(spark, frame):
    s = ST.Store(spark, scratch_path(spark, "test-ledger"))
    s.upsert("fact_price_daily", frame(ROWS[:6], PRICE))
    return s


def counted(s, name="fact_price_daily"):
    return entries(ST.LEDGERS[name](s.read(name)))


def kept(s, name="fact_price_daily"):
    return entries(s.ledger(name))


def test_store_keeps_the_ledger_with_every_change(spark, frame):
    s = store_with(spark, frame)
    assert kept(s) == counted(s)
    s.upsert("fact_price_daily", frame([(1, "CL=F", "2020-04-20", 5.0, 0.1), (3, "Z", "2020-06-01", 1.0, None)], PRICE))
    assert kept(s) == counted(s)
    s.insert_ignore("fact_price_daily", frame([(1, "CL=F", "2020-04-20", 9.0, 0.1), (3, "Z", "2020-06-02", 1.0, 0.0)], PRICE))
    assert kept(s) == counted(s)
    s.delete("fact_price_daily", frame([("2020-06-01",), ("2020-06-02",), ("2020-04-17",)], "d date"))
    assert kept(s) == counted(s) and not any("2020-06" in e for e in kept(s))
    s.write("fact_price_daily", s.read("fact_price_daily").filter("asset_id = 2"))
    assert kept(s) == counted(s) and len(kept(s)) > 0
    assert kept(ST.Store(spark, scratch_path(spark, "test-none"))) == []


def test_appended_news_are_merged_without_reading_the_stored_ones(spark, frame, monkeypatch):
    s = ST.Store(spark, scratch_path(spark, "test-ledger"))
    s.insert_ignore("fact_news", news(frame, NEWS[:2]))
    read = []
    monkeypatch.setattr(s, "_recount", lambda *a: read.append(a))
    s.insert_ignore("fact_news", news(frame, NEWS[1:]))
    assert kept(s, "fact_news") == counted(s, "fact_news") and not read


@pytest.mark.parametrize("change", ["upsert", "insert_ignore"])
def test_a_job_that_fails_between_both_writes_leaves_marks(spark, frame, monkeypatch, change):
    s = store_with(spark, frame)
    new, enter, calls = frame([(4, "Q", "2020-04-22", -1.0, None)], PRICE), s._enter, []

    def failing(name, rows, mode="dynamic"):
        calls.append(mode)
        if len(calls) == 2:
            raise RuntimeError("lost")
        enter(name, rows, mode)

    monkeypatch.setattr(s, "_enter", failing)
    with pytest.raises(RuntimeError):
        getattr(s, change)("fact_price_daily", new)
    monkeypatch.undo()
    assert s.read("fact_price_daily").filter("asset_id = 4").count() == 1
    assert kept(s) == counted(s)


def test_a_table_older_than_its_ledger_is_counted_once(spark, frame):
    s = ST.Store(spark, scratch_path(spark, "test-ledger"))
    rows = s.conform("fact_price_daily", frame(ROWS[:6], PRICE)).withColumn("ym", F.date_format("d", "yyyy-MM"))
    rows.write.partitionBy("ym").parquet(s.path("fact_price_daily"))
    assert kept(s) == counted(s)
