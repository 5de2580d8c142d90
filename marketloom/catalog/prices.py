"""Price bars, returns, indicators and other per-asset time series."""

from __future__ import annotations

from marketloom.catalog.base import query, view
from marketloom.functions.numeric import r
from marketloom.operators import technicals
from marketloom.operators.technicals import INDICATORS
from marketloom.sources.tables import Market


def rounded(df, keys, cols, digits=6):
    return df.select(*keys, *[r(c, digits).alias(c) for c in cols])


def sql_round(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def full_sql(agg: str, value: str, frame: str, rows: int) -> str:
    over = f"OVER (PARTITION BY asset_id ORDER BY d ROWS BETWEEN {frame})"
    return f"CASE WHEN count({value}) {over} = {rows} THEN {agg}({value}) {over} END"


def back(rows: int) -> str:
    return f"{rows - 1} PRECEDING AND CURRENT ROW"


def ahead(rows: int) -> str:
    return f"1 FOLLOWING AND {rows} FOLLOWING"


def mom_sql(k: int) -> str:
    return f"close / nullif(lag(close, {k}) OVER (PARTITION BY asset_id ORDER BY d), 0) - 1"


@query("price_bars", "SELECT asset_id, d, volume, open, high, low, close FROM price_daily", "d")
def price_bars(m: Market):
    return m.price_daily.select("asset_id", "d", "volume", "open", "high", "low", "close")


@query("return_1d", f"SELECT ticker, d, {sql_round(['return_1d', 'pct_change'])} FROM prices", "d")
def return_1d(m: Market):
    return rounded(m.prices, ["ticker", "d"], ["return_1d", "pct_change"])


@query("sma", f"""s AS (SELECT ticker, d, {full_sql('avg', 'close', back(20), 20)} AS sma_20,
    {full_sql('avg', 'close', back(50), 50)} AS sma_50,
    {full_sql('avg', 'close', back(200), 200)} AS sma_200 FROM price_daily)
    SELECT ticker, d, {sql_round(['sma_20', 'sma_50', 'sma_200'])} FROM s""", "d")
def sma(m: Market):
    return rounded(technicals.moving_averages(m.price_daily), ["ticker", "d"],
                   ["sma_20", "sma_50", "sma_200"])


def ewm_sql(values: str, i: str, alpha: str) -> str:
    """Left fold over the first i values; the fold's seed is the first one."""
    return (f"list_reduce({values}[1:{i}], lambda acc, x: "
            f"acc * (1 - {alpha}) + x * {alpha})")


view("ewm_series", """SELECT asset_id, ticker, list(d ORDER BY d) AS ds,
    list(close ORDER BY d) AS xs,
    list(greatest(delta, 0.0) ORDER BY d) FILTER (WHERE delta IS NOT NULL) AS gains,
    list(-least(delta, 0.0) ORDER BY d) FILTER (WHERE delta IS NOT NULL) AS losses
    FROM (SELECT asset_id, ticker, d, close,
          close - lag(close) OVER (PARTITION BY asset_id ORDER BY d) AS delta
          FROM price_daily) GROUP BY 1, 2""")
view("ewm_points", f"""SELECT asset_id, ticker, xs, gains, losses, i, ds[i] AS d,
    CASE WHEN i >= 12 THEN {ewm_sql('xs', 'i', '(2.0/13)')} END AS ema_12,
    CASE WHEN i >= 26 THEN {ewm_sql('xs', 'i', '(2.0/27)')} END AS ema_26,
    CASE WHEN i >= 15 THEN {ewm_sql('gains', '(i - 1)', '(1.0/14)')} END AS avg_gain,
    CASE WHEN i >= 15 THEN {ewm_sql('losses', '(i - 1)', '(1.0/14)')} END AS avg_loss
    FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM ewm_series)""")
view("macd_series", """SELECT asset_id, list(ema_12 - ema_26 ORDER BY i)
    FILTER (WHERE i >= 26) AS ms FROM ewm_points GROUP BY 1""")
view("oscillators", f"""SELECT p.asset_id, p.ticker, p.d, p.ema_12, p.ema_26,
    p.ema_12 - p.ema_26 AS macd,
    CASE WHEN p.i >= 34 THEN {ewm_sql('s.ms', '(p.i - 25)', '(2.0/10)')} END AS macd_signal,
    100 - 100 / (1 + p.avg_gain / nullif(p.avg_loss, 0)) AS rsi_14
    FROM ewm_points p JOIN macd_series s USING (asset_id)""")


@query("ema", f"SELECT ticker, d, {sql_round(['ema_12', 'ema_26'])} FROM ewm_points", "d")
def ema(m: Market):
    return rounded(technicals.oscillators(m.price_daily), ["ticker", "d"], ["ema_12", "ema_26"])


@query("macd", f"""o AS (SELECT ticker, d, macd, macd_signal, macd - macd_signal AS macd_hist
    FROM oscillators) SELECT ticker, d, {sql_round(['macd', 'macd_signal', 'macd_hist'])} FROM o""", "d")
def macd(m: Market):
    return rounded(technicals.oscillators(m.price_daily), ["ticker", "d"],
                   ["macd", "macd_signal", "macd_hist"])


@query("rsi", f"SELECT ticker, d, {sql_round(['rsi_14'])} FROM oscillators", "d")
def rsi(m: Market):
    return rounded(technicals.oscillators(m.price_daily), ["ticker", "d"], ["rsi_14"])


@query("volatility_20", f"""v AS (SELECT ticker, d, {full_sql('stddev_samp', 'return_1d', back(20), 20)}
    AS volatility_20 FROM prices) SELECT ticker, d, {sql_round(['volatility_20'])} FROM v""", "d")
def volatility_20(m: Market):
    return rounded(technicals.rolling_volatility(m.prices), ["ticker", "d"], ["volatility_20"])


@query("momentum", f"""v AS (SELECT ticker, d, {mom_sql(5)} AS momentum_5, {mom_sql(21)} AS momentum_21,
    {mom_sql(63)} AS momentum_63 FROM price_daily)
    SELECT ticker, d, {sql_round(['momentum_5', 'momentum_21', 'momentum_63'])} FROM v""", "d")
def momentum(m: Market):
    return rounded(technicals.momentum(m.price_daily), ["ticker", "d"],
                   ["momentum_5", "momentum_21", "momentum_63"])


view("technicals", f"""SELECT p.asset_id, p.ticker, p.d, p.close, p.return_1d,
    {full_sql('avg', 'close', back(20), 20).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS sma_20,
    {full_sql('avg', 'close', back(50), 50).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS sma_50,
    {full_sql('avg', 'close', back(200), 200).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS sma_200,
    o.ema_12, o.ema_26, o.macd, o.macd_signal, o.macd - o.macd_signal AS macd_hist, o.rsi_14,
    {full_sql('stddev_samp', 'return_1d', back(20), 20).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS volatility_20,
    {mom_sql(5).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS momentum_5,
    {mom_sql(21).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS momentum_21,
    {mom_sql(63).replace('asset_id', 'p.asset_id').replace('BY d', 'BY p.d')} AS momentum_63
    FROM prices p JOIN oscillators o ON o.asset_id = p.asset_id AND o.d = p.d""")


@query("technical_daily", f"SELECT ticker, d, {sql_round(INDICATORS)} FROM technicals", "d")
def technical_daily(m: Market):
    return rounded(m.technicals, ["ticker", "d"], INDICATORS)


@query("technical_usable_range", """SELECT ticker, min(d) AS first_d, max(d) AS last_d, count(*) AS n
    FROM technicals WHERE rsi_14 IS NOT NULL GROUP BY ticker""", "first_d last_d")
def technical_usable_range(m: Market):
    return technicals.usable_ranges(m.technicals)
