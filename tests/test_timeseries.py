import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import asof, returns, validation
from marketloom.operators.ewm import Ewm, add_ewm, span_alpha
from marketloom.operators.technicals import indicators
from marketloom.plans import panels

DAY0 = dt.date(2015, 1, 1)


def walk(n, seed, asset=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(asset, f"T{asset}", DAY0 + dt.timedelta(days=i), float(c), float(c * 1.01), float(c * 0.99)) for i, c in enumerate(close)]


BARS = "asset_id int, ticker string, d date, close double, high double, low double"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(900, 1) + walk(300, 2, 2), BARS)


def test_ewm_matches_the_recurrence_across_blocks(bars):
    for block in (7, 256):
        got = add_ewm(bars, [Ewm("close", "e", span_alpha(12), 12)], block=block).filter("asset_id = 1").orderBy("d").toPandas()
        want = got["close"].ewm(span=12, min_periods=12, adjust=False).mean()
        np.testing.assert_allclose(got["e"].astype(float), want, rtol=1e-12)


@pytest.mark.parametrize("alpha", [1e-3, 0.94, 0.95, 0.999, 1 - 1e-12, 1.0])
def test_ewm_holds_for_every_alpha(bars, alpha):
    got = add_ewm(bars, [Ewm("close", "e", alpha, 3)]).filter("asset_id = 1").orderBy("d").toPandas()
    want = got["close"].ewm(alpha=alpha, min_periods=3, adjust=False).mean()
    np.testing.assert_allclose(got["e"].astype(float), want, rtol=1e-12)


def test_indicators_match_pandas(bars):
    got = indicators(returns.daily_returns(bars)).filter("asset_id = 2").orderBy("d").toPandas()
    c = got["close"]
    macd = c.ewm(span=12, min_periods=12, adjust=False).mean() - c.ewm(span=26, min_periods=26, adjust=False).mean()
    signal = macd.ewm(span=9, min_periods=9, adjust=False).mean()
    delta = c.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    want = {"macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "rsi_14": 100 - 100 / (1 + gain / loss),
            "sma_200": c.rolling(200).mean(), "volatility_20": c.pct_change().rolling(20).std(), "momentum_63": c.pct_change(63)}
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series, rtol=1e-9, atol=1e-10, err_msg=name)
    first = {n: got[n].first_valid_index() for n in ("ema_12", "ema_26", "macd_signal", "rsi_14")}
    assert first == {"ema_12": 11, "ema_26": 25, "macd_signal": 33, "rsi_14": 14}


def test_rsi_without_losses_is_undefined(frame):
    rising = frame([(1, "T", DAY0 + dt.timedelta(days=i), 100.0 + i, 1.0, 1.0) for i in range(30)], BARS)
    assert indicators(returns.daily_returns(rising)).filter("rsi_14 IS NOT NULL").count() == 0


def test_forward_volatility_sees_only_later_rows(frame):
    rets = [0.01, -0.02, 0.015, -0.01, 0.02, 5.0, 0.01, -0.01, 0.02, 0.0]
    df = frame([(1, DAY0 + dt.timedelta(days=i), r) for i, r in enumerate(rets)], "asset_id int, d date, return_1d double")
    got = [r.target_vol_5d for r in returns.forward_volatility(df, [5]).orderBy("d").collect()]
    for i, v in enumerate(got):
        ahead = rets[i + 1:i + 6]
        assert v is None if len(ahead) < 5 else v == pytest.approx(np.std(ahead, ddof=1))
    assert got[5] is None and got[0] > 1 and got[4] > 1


def test_targets_do_not_cross_tickers(bars):
    df = returns.forward_targets(bars, [21])
    assert df.filter("target_ret_21d IS NULL").groupBy("asset_id").count().filter("count <> 21").count() == 0


def test_volatility_panel_rules(bars):
    p = panels.volatility_panel(returns.daily_returns(bars))
    bad = [c for c in panels.P.VOLATILITY_FEATURES if p.filter(F.isnan(c) | (F.abs(c) == float("inf"))).count()]
    assert not bad
    assert p.filter("persistence_21d IS DISTINCT FROM log_vol_20").count() == 0
    last = p.filter("target_vol_21d IS NOT NULL").groupBy("asset_id").agg(F.max("d").alias("d")).orderBy("asset_id").collect()
    assert [r.d for r in last] == [DAY0 + dt.timedelta(days=900 - 22), DAY0 + dt.timedelta(days=300 - 22)]


@pytest.fixture(scope="module")
def trading(spark):
    days = [("2020-01-02", 100.0), ("2020-01-03", 101.0), ("2020-01-06", 102.0), ("2020-01-07", 103.0)]
    return spark.createDataFrame([(1, "T", dt.date.fromisoformat(d), c) for d, c in days], "asset_id int, ticker string, d date, close double")


def anchor(frame, trading, day):
    e = frame([("T", day)], "ticker string, announced_d date")
    rows = asof.next_trading_day(e, trading, "announced_d", ["ticker"]).collect()
    return (rows[0].anchor_date.isoformat(), rows[0].close) if rows else None


def test_anchor_edges(frame, trading):
    assert anchor(frame, trading, "2020-01-03") == ("2020-01-03", 101.0)
    assert anchor(frame, trading, "2020-01-04") == ("2020-01-06", 102.0)
    assert anchor(frame, trading, "2007-05-01") is None and anchor(frame, trading, "2026-01-01") is None
    assert anchor(frame, trading, "2019-12-26") == ("2020-01-02", 100.0)
    assert anchor(frame, trading, "2019-12-25") is None


def test_nth_trading_day(trading):
    rows = {r.d.isoformat(): r for r in asof.with_future_closes(trading, [2, 99]).collect()}
    assert rows["2020-01-02"].close_2d == 102.0 and rows["2020-01-02"].close_99d is None


def test_asof_against_brute_force(frame, spark):
    rng = np.random.default_rng(5)
    days = sorted(rng.choice(400, 120, replace=False).tolist())
    price = spark.createDataFrame([(1, "T", DAY0 + dt.timedelta(days=i), float(i)) for i in days], "asset_id int, ticker string, d date, close double")
    asked = [int(i) for i in rng.choice(420, 300)]
    e = frame([(i, "T", DAY0 + dt.timedelta(days=a)) for i, a in enumerate(asked)], "i int, ticker string, on_d date")
    got = {r.i: r.close for r in asof.next_trading_day(e, price, "on_d", ["ticker"]).collect()}
    want = {}
    for i, a in enumerate(asked):
        later = [x for x in days if a <= x <= a + 7]
        if later:
            want[i] = float(later[0])
    assert got == want


def test_nearest_announcement(frame):
    p = frame([("A", "2020-03-31"), ("A", "2020-06-30"), ("B", "2020-03-31")], "k string, period_end date")
    a = frame([("A", "2020-03-30"), ("A", "2020-04-25"), ("A", "2020-05-01"), ("A", "2020-09-28"), ("B", "2020-06-30")], "k string, announced_d date")
    got = {(r.k, r.period_end.isoformat()): r.announced_d and r.announced_d.isoformat() for r in asof.nearest_announcement(p, a, ["k"]).collect()}
    assert got == {("A", "2020-03-31"): "2020-04-25", ("A", "2020-06-30"): "2020-09-28", ("B", "2020-03-31"): None}


def dated(spark, n):
    return spark.createDataFrame([(DAY0 + dt.timedelta(days=i),) for i in range(n)], "d date")


def test_split_is_strict(spark):
    out = validation.split(dated(spark, 101))
    cut = DAY0 + dt.timedelta(days=int(101 * 0.75))
    assert out.filter(F.col("is_test") != (F.col("d") >= F.lit(cut))).count() == 0


@pytest.mark.parametrize("n,folds,low,fixed", [(100, 5, 10, False), (300, 5, 10, False), (45, 5, 10, False), (15, 3, 5, False), (200, 5, 1, True), (203, 5, 1, True)])
def test_folds_against_brute_force(spark, n, folds, low, fixed):
    k = folds if fixed else min(folds, max(1, n // low - 1))
    seg = n // (k + 1)
    want = []
    for i in range(1, k + 1):
        stop = min((i + 1) * seg, n) if fixed else ((i + 1) * seg if i < k else n)
        want.append((i, i * seg - 1, i * seg, stop - 1))
    got = [(r.fold, *((d - DAY0).days for d in (r.train_end, r.test_start, r.test_end)))
           for r in validation.folds(dated(spark, n), folds, low, fixed=fixed).orderBy("fold").collect()]
    assert got == want
    assert all(a < b for _, a, b, _ in got) and all(x[3] < y[2] for x, y in zip(got, got[1:]))


def test_fold_summary(frame):
    df = frame([(.4, False), (.6, True), (.5, False)], "accuracy double, beats_baseline boolean")
    r = validation.fold_summary(df).first()
    assert (r.n_folds, r.accuracy_mean, r.accuracy_min, r.accuracy_max, r.folds_beating_baseline) == (3, .5, .4, .6, 1)
    assert validation.fold_summary(df.limit(0)).count() == 0


def test_equity_curve_handles_total_loss(frame):
    df = frame([("T", DAY0, -1.0, 1), ("T", DAY0 + dt.timedelta(days=1), 0.5, 1)], "k string, d date, ret double, pred int")
    rows = validation.equity_curve(df, "k", "ret", "pred").orderBy("d").collect()
    assert [r.strategy for r in rows] == [0.0, 0.0]


def test_growth_does_not_fill_a_missing_quarter(frame):
    q = [("T", f"2020-0{m}-01", rev, None, None, None, None) for m, rev in ((1, 100.0), (4, None), (7, 130.0), (9, 0.0))]
    df = frame(q, "ticker string, fiscal_period_end date, revenue double, eps_diluted double, net_margin double, total_debt double, stockholders_equity double")
    assert [r.revenue_growth_qoq for r in panels.growth_features(df).orderBy("fiscal_period_end").collect()] == [None, None, None, -1.0]


def test_market_volatility_is_cross_sectional(bars):
    px = returns.daily_returns(bars)
    got = panels.market_volatility(px).orderBy("d").toPandas()
    want = px.toPandas().groupby("d")["return_1d"].mean()
    np.testing.assert_allclose(got["market_vol_20"].astype(float), want.rolling(20).std().to_numpy(), rtol=1e-9)




def test_bars_are_the_same_with_a_shuffled_asset_table(spark):
    from marketloom.sources.tables import daily_bars
    rng = np.random.default_rng(9)
    # one key holds a third of all trades
    rows = [(0 if i % 3 == 0 else int(rng.integers(1, 40)), DAY0 + dt.timedelta(days=int(rng.integers(0, 5))), float(rng.integers(1, 900)), int(rng.integers(1, 10 ** 6)), float(rng.integers(1, 50)))
            for i in range(3000)]
    trades = spark.createDataFrame(rows, "k bigint, d date, unit double, amount bigint, qty double")
    assets = spark.createDataFrame([(k, f"Brand#{k % 7}") for k in range(40)], "k bigint, ticker string")
    plain = (trades.join(assets, "k").groupBy("ticker", "d")
             .agg(F.max("unit").alias("high"), F.min("unit").alias("low"), (F.sum("amount") / 100 / F.sum("qty")).alias("close")))
    a, b = (sorted(map(str, df.select("ticker", "d", "high", "low", "close").collect())) for df in (plain, daily_bars(trades, assets, "k")))
    assert a == b and len(a) == 35


def test_one_sort_serves_all_indicator_windows(bars):
    plan = indicators(returns.daily_returns(bars))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
