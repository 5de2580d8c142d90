"""Panels, point-in-time joins and validation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.catalog.filings import fundamentals
from marketloom.catalog.prices import ahead, back, full_sql, rounded, sql_round
from marketloom.functions.tails import r_p_sql
from marketloom.functions import params as P
from marketloom.functions.numeric import r
from marketloom.operators import asof, ranking, returns, stats, validation
from marketloom.plans import panels
from marketloom.sources.tables import Market


def leads(rel: str, hs, part: str) -> str:
    return ", ".join(f"lead(close, {h}) OVER (PARTITION BY {part} ORDER BY d) / nullif(close, 0) - 1 AS target_ret_{h}d" for h in hs)


_DIR = ", ".join(f"CASE WHEN target_ret_{h}d IS NOT NULL THEN CAST(target_ret_{h}d > 0 AS INTEGER) END AS target_dir_{h}d" for h in (1, 5, 21))
TECH = ["rsi_14", "macd_hist", "volatility_20", "momentum_5", "momentum_21", "momentum_63", "price_vs_sma20", "price_vs_sma50"]
RETS = ["target_ret_1d", "target_ret_5d", "target_ret_21d"]
DIRS = ["target_dir_1d", "target_dir_5d", "target_dir_21d"]
_DIR_COLS = " ".join(DIRS)

view("tech_feats", "SELECT *, close / nullif(sma_20, 0) - 1 AS price_vs_sma20, close / nullif(sma_50, 0) - 1 AS price_vs_sma50 FROM technicals")
view("tech_panel", f"SELECT *, {_DIR} FROM (SELECT *, {leads('t', (1, 5, 21), 'asset_id')} FROM tech_feats)")
view("senti_rows", "SELECT t.*, s.sentiment_mean AS sentiment_index, s.news_count FROM tech_feats t JOIN sentiment_daily s ON s.asset_id = t.asset_id AND s.d = t.d")
view("senti_panel", f"""SELECT *, {_DIR} FROM (SELECT *, lag(sentiment_index, 1) OVER w AS sentiment_lag1, lag(sentiment_index, 2) OVER w AS sentiment_lag2,
    {leads('s', (1, 5, 21), 'asset_id')} FROM senti_rows WINDOW w AS (PARTITION BY asset_id ORDER BY d))""")


@query("forward_targets", f"""p AS (SELECT ticker, d, {leads('p', (1, 5, 21), 'asset_id')} FROM price_daily)
    SELECT ticker, d, {sql_round(RETS)}, {_DIR} FROM p""", "d", _DIR_COLS)
def forward_targets(m: Market):
    p = returns.forward_targets(m.price_daily, [1, 5, 21])
    return rounded(p, ["ticker", "d", *DIRS], RETS)


@query("technical_panel", f"SELECT ticker, d, {', '.join(DIRS)}, {sql_round(TECH + RETS)} FROM tech_panel", "d", _DIR_COLS)
def technical_panel(m: Market):
    return rounded(panels.technical_panel(m.technicals), ["ticker", "d", *DIRS], TECH + RETS)


SENTI = ["sentiment_index", "sentiment_lag1", "sentiment_lag2"]


@query("sentiment_panel", f"SELECT ticker, d, news_count, {', '.join(DIRS)}, {sql_round(TECH + SENTI + RETS)} FROM senti_panel", "d", _DIR_COLS)
def sentiment_panel(m: Market):
    p = panels.sentiment_panel(m.technicals, m.sentiment_daily)
    return rounded(p, ["ticker", "d", "news_count", *DIRS], TECH + SENTI + RETS)


view("market", """SELECT d, market_ret, CASE WHEN count(market_ret) OVER w = 20 THEN stddev_samp(market_ret) OVER w END AS market_vol_20
    FROM (SELECT d, avg(return_1d) AS market_ret FROM prices GROUP BY d) WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")


@query("market_volatility", f"SELECT d, {sql_round(['market_ret', 'market_vol_20'])} FROM market", "d")
def market_volatility(m: Market):
    return rounded(panels.market_volatility(m.prices), ["d"], ["market_ret", "market_vol_20"])


def lnf(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN ln(greatest({x}, 0.000001)) END"


view("vol_base", f"""SELECT p.asset_id, p.ticker, p.d, return_1d, abs(return_1d) AS abs_ret_1, m.market_vol_20,
    CASE WHEN high / nullif(low, 0) > 0 THEN ln(high / nullif(low, 0)) END AS hl FROM prices p LEFT JOIN market m ON m.d = p.d""")
view("vol_windows", f"""SELECT *, {full_sql('stddev_samp', 'return_1d', back(5), 5)} AS v5, {full_sql('stddev_samp', 'return_1d', back(20), 20)} AS v20,
    {full_sql('stddev_samp', 'return_1d', back(60), 60)} AS v60, {full_sql('avg', 'abs_ret_1', back(5), 5)} AS abs_ret_5_mean,
    {full_sql('avg', 'hl', back(20), 20)} AS range_20,
    CASE WHEN count(*) OVER w = 20 THEN avg(CASE WHEN return_1d < 0 THEN 1.0 ELSE 0.0 END) OVER w END AS neg_ret_share_20,
    {full_sql('stddev_samp', 'return_1d', ahead(5), 5)} AS target_vol_5d, {full_sql('stddev_samp', 'return_1d', ahead(21), 21)} AS target_vol_21d
    FROM vol_base WINDOW w AS (PARTITION BY asset_id ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
view("vol_panel", f"""SELECT asset_id, ticker, d, {lnf('v5')} AS log_vol_5, {lnf('v20')} AS log_vol_20, {lnf('v60')} AS log_vol_60,
    v5 / nullif(v20, 0) AS vol_ratio_5_20, v20 / nullif(v60, 0) AS vol_ratio_20_60, abs_ret_1, abs_ret_5_mean, range_20, neg_ret_share_20,
    {lnf('market_vol_20')} AS log_market_vol_20, v20 / nullif(market_vol_20, 0) AS rel_vol_to_market, target_vol_5d, target_vol_21d,
    {lnf('target_vol_5d')} AS target_logvol_5d, {lnf('target_vol_21d')} AS target_logvol_21d, {lnf('v20')} AS persistence_5d, {lnf('v20')} AS persistence_21d
    FROM vol_windows""")
VOL_OUT = P.VOLATILITY_FEATURES + [f"{p}_{h}d" for h in (5, 21) for p in ("target_vol", "target_logvol", "persistence")]


@query("volatility_panel", f"SELECT ticker, d, {sql_round(VOL_OUT)} FROM vol_panel", "d")
def volatility_panel(m: Market):
    return rounded(panels.volatility_panel(m.prices), ["ticker", "d"], VOL_OUT)


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in P.VOLATILITY_FEATURES + ["target_logvol_21d"])


@query("usable_rows", f"SELECT ticker, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM vol_panel WHERE {_COMPLETE} GROUP BY 1", "first_d last_d")
def usable_rows(m: Market):
    u = panels.usable(panels.volatility_panel(m.prices), P.VOLATILITY_FEATURES + ["target_logvol_21d"])
    return u.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query("asof_next_day", """f AS (SELECT *, 'Brand#' || CAST(entity_id AS VARCHAR) AS ticker FROM facts)
    SELECT f.pos, p.d AS anchor_date, p.close FROM f ASOF JOIN price_daily p ON p.ticker = f.ticker AND p.d >= f.filed_d
    WHERE p.d - f.filed_d <= 7""", "anchor_date")
def asof_next_day(m: Market):
    f = m.facts.withColumn("ticker", F.concat(F.lit("Brand#"), F.col("entity_id").cast("string")))
    bars = m.price_daily.select("ticker", "d", "close")
    return asof.next_trading_day(f, bars, "filed_d", ["ticker"]).select("pos", "anchor_date", "close")


@query("nth_trading_day", """f AS (SELECT *, 'Brand#' || CAST(entity_id AS VARCHAR) AS ticker FROM facts),
    b AS (SELECT ticker, d, close, lead(close, 21) OVER w AS close_21d, lead(close, 252) OVER w AS close_252d FROM price_daily WINDOW w AS (PARTITION BY ticker ORDER BY d))
    SELECT f.pos, b.close_21d, b.close_252d FROM f ASOF JOIN b ON b.ticker = f.ticker AND b.d >= f.filed_d WHERE b.d - f.filed_d <= 7""")
def nth_trading_day(m: Market):
    f = m.facts.withColumn("ticker", F.concat(F.lit("Brand#"), F.col("entity_id").cast("string")))
    bars = asof.with_future_closes(m.price_daily.select("asset_id", "ticker", "d", "close"), [21, 252]).drop("asset_id")
    return asof.next_trading_day(f, bars, "filed_d", ["ticker"]).select("pos", "close_21d", "close_252d")


@query("nearest_announcement", """p AS (SELECT DISTINCT entity_id, end_d AS period_end FROM facts),
    a AS (SELECT DISTINCT entity_id, filed_d AS announced_d FROM facts WHERE prio = 1)
    SELECT p.entity_id, p.period_end, min(a.announced_d) AS announced_d FROM p LEFT JOIN a ON a.entity_id = p.entity_id
      AND a.announced_d >= p.period_end AND a.announced_d - p.period_end <= 90 GROUP BY 1, 2""", "period_end announced_d")
def nearest_announcement(m: Market):
    periods = m.facts.select("entity_id", F.col("end_d").alias("period_end")).distinct()
    dates = m.facts.filter("prio = 1").select("entity_id", F.col("filed_d").alias("announced_d"))
    return asof.nearest_announcement(periods, dates, ["entity_id"]).select("entity_id", "period_end", "announced_d")


view("growth", """SELECT *, revenue / nullif(lag(revenue) OVER w, 0) - 1 AS revenue_growth_qoq, eps_diluted / nullif(lag(eps_diluted) OVER w, 0) - 1 AS eps_growth_qoq,
    net_margin - lag(net_margin) OVER w AS margin_delta_qoq, total_debt / nullif(stockholders_equity, 0) AS debt_to_equity,
    CASE WHEN count(eps_diluted) OVER w4 >= 2 THEN sum(eps_diluted) OVER w4 END AS eps_ttm FROM fundamentals
    WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_period_end), w4 AS (PARTITION BY ticker ORDER BY fiscal_period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
view("fund_panel", """SELECT g.ticker, g.fiscal_period_end, g.announced_d, b.d AS anchor_date, b.close AS anchor_price, revenue_growth_qoq, eps_growth_qoq, net_margin,
    margin_delta_qoq, debt_to_equity, CASE WHEN eps_ttm > 0 THEN b.close / eps_ttm END AS pe_ratio, b.c63 / nullif(b.close, 0) - 1 AS fwd_ret_63d,
    b.c126 / nullif(b.close, 0) - 1 AS fwd_ret_126d, b.c252 / nullif(b.close, 0) - 1 AS fwd_ret_252d
    FROM growth g ASOF JOIN (SELECT ticker, d, close, lead(close, 63) OVER w AS c63, lead(close, 126) OVER w AS c126, lead(close, 252) OVER w AS c252
      FROM price_daily WINDOW w AS (PARTITION BY ticker ORDER BY d)) b ON b.ticker = g.ticker AND b.d >= g.announced_d WHERE b.d - g.announced_d <= 7""")
FEATS = P.FUNDAMENTAL_FEATURES
FWD = ["fwd_ret_63d", "fwd_ret_126d", "fwd_ret_252d"]


def fund_panel(m: Market):
    return panels.fundamentals_panel(fundamentals(m), m.price_daily)


@query("growth_features", f"SELECT ticker, fiscal_period_end, {sql_round(['revenue_growth_qoq', 'eps_growth_qoq', 'margin_delta_qoq', 'debt_to_equity', 'eps_ttm'], 5)} FROM growth", "fiscal_period_end")
def growth_features(m: Market):
    g = panels.growth_features(fundamentals(m))
    return rounded(g, ["ticker", "fiscal_period_end"], ["revenue_growth_qoq", "eps_growth_qoq", "margin_delta_qoq", "debt_to_equity", "eps_ttm"], 5)


@query("fundamentals_panel", f"SELECT ticker, fiscal_period_end, announced_d, anchor_date, anchor_price, {sql_round(FEATS + FWD)} FROM fund_panel",
       "fiscal_period_end announced_d anchor_date")
def fundamentals_panel(m: Market):
    return rounded(fund_panel(m), ["ticker", "fiscal_period_end", "announced_d", "anchor_date", "anchor_price"], FEATS + FWD)


def _rank_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT '{f}' AS feature, {h} AS horizon, {f} AS x, fwd_ret_{h}d AS y FROM fp" for f in FEATS for h in (63, 126, 252))
    return f"""fp AS MATERIALIZED (SELECT * FROM fund_panel), c AS (SELECT * FROM ({cells}) WHERE x IS NOT NULL AND y IS NOT NULL),
      k AS (SELECT *, rank() OVER (PARTITION BY feature, horizon ORDER BY x) + (count(*) OVER (PARTITION BY feature, horizon, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY feature, horizon ORDER BY y) + (count(*) OVER (PARTITION BY feature, horizon, y) - 1) / 2.0 AS ry FROM c)
      SELECT feature, horizon, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman
      FROM k GROUP BY 1, 2 HAVING count(*) >= 15"""


view("factor_tests", f"""WITH {_rank_sql().replace('round(corr(x, y), 6) + 0.0', 'corr(x, y)').replace('round(corr(rx, ry), 6) + 0.0', 'corr(rx, ry)')}""")


def rank_table(m: Market):
    return stats.rank_correlations(stats.long_pairs(fund_panel(m), FEATS, P.FUNDAMENTAL_HORIZONS))


@query("rank_correlations", _rank_sql())
def rank_correlations(m: Market):
    return rank_table(m).withColumns({"pearson": r("pearson"), "spearman": r("spearman")})


@query("hypothesis_fundamentals", f"""p AS (SELECT feature, horizon, n, pearson AS r, {r_p_sql('pearson', 'n')} AS p_raw FROM factor_tests),
    k AS (SELECT *, p_raw * count(p_raw) OVER () / row_number() OVER (ORDER BY p_raw) AS s FROM p),
    q AS (SELECT *, least(min(s) OVER (ORDER BY p_raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q FROM k WHERE p_raw IS NOT NULL)
    SELECT feature, horizon, n, round(r, 6) + 0.0 AS r, round(p_raw, 6) + 0.0 AS p_raw, round(q, 6) + 0.0 AS p_fdr_adjusted,
      q < 0.05 AS significant_after_correction FROM q""")
def hypothesis_fundamentals(m: Market):
    from marketloom.plans import research
    return research.fundamentals_hypothesis(fund_panel(m)).withColumns({c: r(c) for c in ("r", "p_raw", "p_fdr_adjusted")})


view("split_dates", "SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM price_daily)")


@query("chronological_split", """c AS (SELECT d AS cut FROM split_dates WHERE i = CAST(floor(n * 0.75) AS BIGINT))
    SELECT d >= cut AS is_test, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM price_daily, c GROUP BY 1""", "first_d last_d")
def chronological_split(m: Market):
    return validation.split(m.price_daily).groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


def fold_sql(k: int, low: int, fixed: bool) -> str:
    count = f"{k}" if fixed else f"least({k}, greatest(1, n // {low} - 1))"
    stop = "least((f + 1) * seg, n)" if fixed else "CASE WHEN f < k THEN (f + 1) * seg ELSE n END"
    return f"""h AS (SELECT DISTINCT n, {count} AS k, n // ({count} + 1) AS seg FROM split_dates),
      e AS (SELECT n, k, seg, unnest(generate_series(1, k)) AS f FROM h), b AS (SELECT f AS fold, f * seg AS a, {stop} AS b FROM e),
      p AS (SELECT b.fold, x.d AS train_end, y.d AS test_start, z.d AS test_end FROM b JOIN split_dates x ON x.i = a - 1 JOIN split_dates y ON y.i = a JOIN split_dates z ON z.i = b.b - 1)
      SELECT CAST(fold AS INTEGER) AS fold, train_end, test_start, test_end, count(*) FILTER (WHERE d <= train_end) AS n_train,
        count(*) FILTER (WHERE d BETWEEN test_start AND test_end) AS n_test, count(DISTINCT CASE WHEN d BETWEEN test_start AND test_end THEN d END) AS n_test_days
      FROM p, price_daily WHERE d <= test_end GROUP BY 1, 2, 3, 4"""


FOLD_DATES = "train_end test_start test_end"


@query("folds_direction", fold_sql(5, 10, False), FOLD_DATES)
def folds_direction(m: Market):
    return validation.fold_rows(m.price_daily, validation.folds(m.price_daily, 5, 10))


@query("folds_sentiment", fold_sql(3, 5, False), FOLD_DATES)
def folds_sentiment(m: Market):
    return validation.fold_rows(m.price_daily, validation.folds(m.price_daily, 3, 5))


@query("folds_regression", fold_sql(5, 20, False), FOLD_DATES)
def folds_regression(m: Market):
    return validation.fold_rows(m.price_daily, validation.folds(m.price_daily, 5, 20))


@query("folds_volatility", fold_sql(5, 1, True), FOLD_DATES)
def folds_volatility(m: Market):
    return validation.fold_rows(m.price_daily, validation.folds(m.price_daily, 5, fixed=True))


# A prediction every panel has without a fit: tomorrow moves as the last 21 days did.
view("naive", """SELECT ticker, asset_id, d, target_dir_5d AS y, target_ret_5d AS ret, CAST(momentum_21 > 0 AS INTEGER) AS pred, CAST(momentum_63 > 0 AS INTEGER) AS pred_b, momentum_21
    FROM tech_panel WHERE target_dir_5d IS NOT NULL AND momentum_63 IS NOT NULL""")


def naive(m: Market):
    p = panels.technical_panel(m.technicals, [5]).filter(F.col("target_dir_5d").isNotNull() & F.col("momentum_63").isNotNull())
    return p.select("ticker", "asset_id", "d", F.col("target_dir_5d").alias("y"), F.col("target_ret_5d").alias("ret"),
                    (F.col("momentum_21") > 0).cast("int").alias("pred"), (F.col("momentum_63") > 0).cast("int").alias("pred_b"), "momentum_21")


@query("direction_metrics", """a AS (SELECT ticker, count(*) AS n, avg(CAST(pred = y AS INTEGER)) AS accuracy, greatest(avg(y), 1 - avg(y)) AS baseline,
      coalesce(count(*) FILTER (WHERE y = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE pred = 1), 0), 0) AS precision,
      coalesce(count(*) FILTER (WHERE y = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 0) AS recall FROM naive GROUP BY 1)
    SELECT ticker, n, round(accuracy, 6) AS accuracy, round(baseline, 6) AS baseline, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, accuracy - baseline > 0.02 AS beats_baseline,
      CASE WHEN accuracy - baseline > 0.02 THEN 'YES' WHEN accuracy - baseline < -0.02 THEN 'no' ELSE '~tie' END AS beats_majority FROM a""")
def direction_metrics(m: Market):
    c = stats.classification(naive(m), "y", "pred", ["ticker"])
    return c.withColumns({k: F.round(k, 6) for k in ("accuracy", "baseline", "precision", "recall", "f1")})


@query("auc", """k AS (SELECT y, rank() OVER (ORDER BY momentum_21) + (count(*) OVER (PARTITION BY momentum_21) - 1) / 2.0 AS rk FROM naive),
    t AS (SELECT CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS q, CAST(sum(rk) FILTER (WHERE y = 1) AS DOUBLE) AS s FROM k)
    SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t""")
def auc(m: Market):
    return stats.auc(naive(m), "y", "momentum_21").withColumn("auc", F.round("auc", 6))


@query("mcnemar_table", """t AS (SELECT count(*) FILTER (WHERE pred = y AND pred_b = y) AS both_correct, count(*) FILTER (WHERE pred = y AND pred_b <> y) AS a_only,
      count(*) FILTER (WHERE pred <> y AND pred_b = y) AS b_only, count(*) FILTER (WHERE pred <> y AND pred_b <> y) AS both_wrong FROM naive)
    SELECT *, round(CASE WHEN a_only + b_only < 25 THEN least(a_only, b_only) ELSE (abs(a_only - b_only) - 1) ** 2 / (a_only + b_only) END, 6) AS statistic FROM t""")
def mcnemar_table(m: Market):
    rows = naive(m).select((F.col("pred") == F.col("y")).alias("correct_a"), (F.col("pred_b") == F.col("y")).alias("correct_b"))
    return stats.mcnemar(rows).withColumn("statistic", F.round("statistic", 6))


@query("proportion_z", """a AS (SELECT ticker, count(*) AS n, count(*) FILTER (WHERE pred = y) / count(*) AS p, greatest(avg(y), 1 - avg(y)) AS p0 FROM naive GROUP BY 1)
    SELECT ticker, n, round((p - p0) / nullif(sqrt(p * (1 - p) / n), 0), 6) + 0.0 AS z FROM a""")
def proportion_z(m: Market):
    a = naive(m).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("y")).alias("k"), F.avg("y").alias("up"))
    z = stats.proportion_z(F.col("k"), F.col("n"), F.greatest(F.col("up"), 1 - F.col("up")))
    return a.select("ticker", "n", r(z).alias("z"))


@query("equity_curves", """SELECT ticker, d, round(sum(ln(1 + CASE WHEN pred = 1 THEN ret ELSE 0 END)) OVER w, 6) + 0.0 AS log_strategy,
    round(sum(ln(1 + ret)) OVER w, 6) + 0.0 AS log_buy_hold FROM naive WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)""", "d")
def equity_curves(m: Market):
    """Growth factors span hundreds of decades here, so their logarithms are compared."""
    c = validation.equity_curve(naive(m), "ticker", "ret", "pred")
    return c.select("ticker", "d", r(F.ln("strategy")).alias("log_strategy"), r(F.ln("buy_hold")).alias("log_buy_hold"))


@query("equity_non_overlapping", """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS i FROM naive) WHERE i % 5 = 0)
    SELECT ticker, d, round(ln(product(1 + ret) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS log_hold FROM n""", "d")
def equity_non_overlapping(m: Market):
    c = validation.equity_curve(validation.non_overlapping(naive(m), "ticker", 5), "ticker", "ret", "pred")
    return c.select("ticker", "d", r(F.ln("buy_hold")).alias("log_hold"))


@query("persistence_skill", """v AS (SELECT target_logvol_21d AS y, persistence_21d AS p, log_vol_60 AS m FROM vol_panel WHERE target_logvol_21d IS NOT NULL AND persistence_21d IS NOT NULL AND log_vol_60 IS NOT NULL)
    SELECT count(*) AS n, round(1 - sum((y - m) ** 2) / (count(*) * var_pop(y)), 6) AS test_r2, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) AS persist_r2,
      round(1 - avg((y - m) ** 2) / avg((y - p) ** 2), 6) AS skill, round(median(abs(exp(y) - exp(m)) * (sqrt(252) * 100)), 4) AS mae_model_annpct,
      round(median(abs(exp(y) - exp(p)) * (sqrt(252) * 100)), 4) AS mae_persist_annpct FROM v""")
def persistence_skill(m: Market):
    v = panels.usable(panels.volatility_panel(m.prices), ["target_logvol_21d", "persistence_21d", "log_vol_60"])
    s = stats.skill(v, "target_logvol_21d", "log_vol_60", "persistence_21d")
    return s.select("n", *[r(c).alias(c) for c in ("test_r2", "persist_r2", "skill")],
                    *[r(c, 4).alias(c) for c in ("mae_model_annpct", "mae_persist_annpct")])


_BOUNDS = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont(CAST({c} AS DOUBLE), 0.01), 6) + 0.0 AS lo, round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 6) + 0.0 AS hi FROM tr" for c in TECH)


@query("winsor_bounds", f"tr AS MATERIALIZED (SELECT * FROM tech_panel WHERE d < (SELECT d FROM split_dates WHERE i = CAST(floor(n * 0.75) AS BIGINT))) {_BOUNDS}")
def winsor_bounds(m: Market):
    p = validation.split(panels.technical_panel(m.technicals, [5])).filter(~F.col("is_test"))
    return stats.winsor_bounds(p, TECH).withColumns({"lo": r("lo"), "hi": r("hi")})


@query("winsorised_means", """c AS (SELECT d AS cut FROM split_dates WHERE i = CAST(floor(n * 0.75) AS BIGINT)),
    b AS (SELECT quantile_cont(momentum_5, 0.01) AS lo, quantile_cont(momentum_5, 0.99) AS hi FROM tech_panel, c WHERE d < cut)
    SELECT d >= cut AS is_test, round(avg(CASE WHEN momentum_5 < lo THEN lo WHEN momentum_5 > hi THEN hi ELSE momentum_5 END), 6) AS mean FROM tech_panel, b, c GROUP BY 1""")
def winsorised_means(m: Market):
    p = validation.split(panels.technical_panel(m.technicals, [5]))
    w = stats.winsorise(p, stats.winsor_bounds(p.filter(~F.col("is_test")), ["momentum_5"]), ["momentum_5"])
    return w.groupBy("is_test").agg(F.round(F.avg("momentum_5"), 6).alias("mean"))


@query("baseline_r2", """c AS (SELECT d AS cut FROM split_dates WHERE i = CAST(floor(n * 0.75) AS BIGINT)),
    m AS (SELECT avg(return_1d) AS m FROM prices, c WHERE d < cut)
    SELECT round(1 - sum((return_1d - m) ** 2) / (count(return_1d) * var_pop(return_1d)), 8) + 0.0 AS baseline_r2 FROM prices, c, m WHERE d >= cut""")
def baseline_r2(m: Market):
    p = validation.split(m.prices)
    b = stats.baseline_r2(p.filter(~F.col("is_test")), p.filter("is_test"), "return_1d")
    return b.withColumn("baseline_r2", r("baseline_r2", 8))


@query("fold_accuracy_summary", f"""{fold_sql(5, 10, False).split('SELECT CAST(fold')[0].rstrip()},
    a AS (SELECT fold, round(avg(CAST(pred = y AS INTEGER)), 3) AS accuracy, avg(CAST(pred = y AS INTEGER)) > greatest(avg(y), 1 - avg(y)) + 0.02 AS beats
      FROM p JOIN naive n ON n.d BETWEEN test_start AND test_end GROUP BY 1)
    SELECT count(*) AS n_folds, round(avg(accuracy), 3) AS accuracy_mean, round(min(accuracy), 3) AS accuracy_min, round(max(accuracy), 3) AS accuracy_max,
      count(*) FILTER (WHERE beats) AS folds_beating_baseline FROM a""")
def fold_accuracy_summary(m: Market):
    plan = validation.folds(m.price_daily, 5, 10)
    guesses = naive(m)
    days = guesses.select("d").distinct().join(plan, F.col("d").between(F.col("test_start"), F.col("test_end"))).select("d", "fold")
    rows = guesses.join(days, "d")  # the few folds meet the dates, and rows meet dates on equality
    per = stats.classification(rows, "y", "pred", ["fold"]).withColumn("accuracy", F.round("accuracy", 3))
    return validation.fold_summary(per)


@query("sample_rows", "SELECT ticker, d, close FROM price_daily ORDER BY md5(concat_ws('|', asset_id, d)), asset_id, d LIMIT 3000", "d")
def sample_rows(m: Market):
    return ranking.sample_rows(m.price_daily, ["asset_id", "d"], 3000).select("ticker", "d", "close")
