"""Correlations, tests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.functions import numeric as X
from marketloom.functions.numeric import r
from marketloom.functions.tails import r_p, r_p_sql, t_p_sql
from marketloom.operators import pairs, ranking, returns, stats, technicals
from marketloom.session import cut_lineage
from marketloom.sources.tables import Market


def corr_sql(x: str, y: str) -> str:
    f = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (f"covar_pop({x}, {y}) {f} / nullif(stddev_pop({x}) {f} * stddev_pop({y}) {f}, 0)")


def pairs_sql(x: str, y: str) -> str:
    return f"count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


view("ticker_corrs", f"""WITH a AS (SELECT ticker,
      {pairs_sql('return_1d', 'sentiment_index')} AS n_t, {corr_sql('return_1d', 'sentiment_index')} AS raw_t,
      {pairs_sql('return_1d', 'sentiment_lag1')} AS n_lag1, {corr_sql('return_1d', 'sentiment_lag1')} AS raw_lag1,
      {pairs_sql('return_1d', 'sentiment_lag2')} AS n_lag2, {corr_sql('return_1d', 'sentiment_lag2')} AS raw_lag2,
      count(*) FILTER (WHERE return_1d IS NOT NULL AND sentiment_lag1 <> 0) AS hit_n,
      count(*) FILTER (WHERE return_1d IS NOT NULL AND sentiment_lag1 <> 0 AND (return_1d > 0) = (sentiment_lag1 > 0)) AS hits
      FROM lagged GROUP BY 1),
    b AS (SELECT *, CASE WHEN n_t >= 5 THEN round(raw_t, 4) + 0.0 END AS corr_t,
      CASE WHEN n_lag1 >= 5 THEN round(raw_lag1, 4) + 0.0 END AS corr_lag1,
      CASE WHEN n_lag2 >= 5 THEN round(raw_lag2, 4) + 0.0 END AS corr_lag2 FROM a),
    c AS (SELECT *, atanh(least(greatest(corr_lag1, -0.999999), 0.999999)) AS z,
      1.959963984540054 / sqrt(CASE WHEN n_lag1 >= 4 THEN n_lag1 - 3 END) AS half FROM b)
    SELECT ticker, ticker AS display_name, raw_t, raw_lag1, raw_lag2, n_t, corr_t, n_lag1, corr_lag1, n_lag2, corr_lag2, hit_n,
      round(tanh(z - half), 4) + 0.0 AS ci_lo, round(tanh(z + half), 4) + 0.0 AS ci_hi,
      CASE WHEN n_lag1 < 30 THEN 'low' ELSE 'ok' END AS n_flag,
      CASE WHEN hit_n >= 5 THEN round(hits / hit_n * 100, 1) + 0.0 END AS hit_rate,
      CASE WHEN coalesce(corr_lag1, 0) = 0 AND coalesce(corr_lag2, 0) = 0 THEN 'N/A'
           WHEN abs(coalesce(corr_lag1, 0)) >= abs(coalesce(corr_lag2, 0)) THEN 'Lag 1' ELSE 'Lag 2' END AS best_lag FROM c""")


def lagged(m: Market):
    return returns.with_sentiment_lags(m.metrics)


def corrs(m: Market):
    return stats.ticker_correlations(lagged(m))


@query("ticker_correlations", "SELECT * EXCLUDE (raw_t, raw_lag1, raw_lag2) FROM ticker_corrs")
def ticker_correlations(m: Market):
    return corrs(m).drop("raw_t", "raw_lag1", "raw_lag2")


def _raw(k: str) -> str:
    """The correlation, where there are pairs enough for one."""
    return f"(CASE WHEN n_{k} >= {stats.MIN_PAIRS} THEN raw_{k} END)"


def _stars(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'ns' WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.10 THEN '*' ELSE 'ns' END"


view("ticker_tests", f"""WITH p AS (SELECT *, {', '.join(f'round({r_p_sql(_raw(k), f"n_{k}")}, 4) + 0.0 AS p_{k}' for k in ('t', 'lag1', 'lag2'))} FROM ticker_corrs),
    k AS (SELECT *, p_lag1 * count(p_lag1) OVER () / row_number() OVER (ORDER BY p_lag1 NULLS LAST) AS s FROM p),
    q AS (SELECT *, CASE WHEN p_lag1 IS NOT NULL THEN round(least(min(s) OVER (ORDER BY p_lag1 NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 4) END AS q_lag1 FROM k)
    SELECT * EXCLUDE (s), {_stars('p_t')} AS sig_t, {_stars('p_lag1')} AS sig_lag1, {_stars('p_lag2')} AS sig_lag2,
      CASE WHEN q_lag1 IS NOT NULL THEN {_stars('q_lag1')} END AS sig_lag1_fdr FROM q""")


@query("ticker_correlation_tests", "SELECT * EXCLUDE (raw_t, raw_lag1, raw_lag2) FROM ticker_tests")
def ticker_correlation_tests(m: Market):
    return stats.with_p_values(corrs(m)).drop("raw_t", "raw_lag1", "raw_lag2")


@query("correlation_ranking", "SELECT ticker, corr_lag1 FROM ticker_corrs ORDER BY abs(coalesce(corr_lag1, 0)) DESC, ticker")
def correlation_ranking(m: Market):
    return stats.correlation_ranking(corrs(m)).select("ticker", "corr_lag1")


@query("correlation_summary", """SELECT
    (SELECT ticker FROM ticker_corrs ORDER BY abs(coalesce(corr_lag1, 0)) DESC, ticker DESC LIMIT 1) AS best_ticker,
    (SELECT corr_lag1 FROM ticker_corrs ORDER BY abs(coalesce(corr_lag1, 0)) DESC, ticker DESC LIMIT 1) AS best_r,
    (SELECT round(avg(hit_rate), 1) + 0.0 FROM ticker_corrs) AS avg_hit_rate""")
def correlation_summary(m: Market):
    return stats.correlation_summary(corrs(m))


PAIRS30 = "OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query("rolling_correlation", f"""p AS (SELECT * FROM lagged WHERE return_1d IS NOT NULL AND sentiment_lag1 IS NOT NULL),
    c AS (SELECT ticker, d, CASE WHEN count(*) {PAIRS30} = 30 THEN covar_pop(return_1d, sentiment_lag1) {PAIRS30}
      / nullif(stddev_pop(return_1d) {PAIRS30} * stddev_pop(sentiment_lag1) {PAIRS30}, 0) END AS r FROM p)
    SELECT ticker, d, round(r, 4) + 0.0 AS rolling_r FROM c WHERE r IS NOT NULL""", "d")
def rolling_correlation(m: Market):
    return stats.rolling_correlation(lagged(m))


@query("conditional_returns", """SELECT ticker, CASE WHEN sentiment_lag1 <= -0.15 THEN 'Negative' WHEN sentiment_lag1 <= 0.15 THEN 'Neutral'
      ELSE 'Positive' END AS senti_group, round(avg(return_1d) * 100, 4) + 0.0 AS avg_return, count(*) AS n
    FROM lagged WHERE sentiment_lag1 IS NOT NULL AND return_1d IS NOT NULL GROUP BY 1, 2""")
def conditional_returns(m: Market):
    return stats.conditional_returns(lagged(m))


@query("fdr_qvalues", "SELECT ticker, p_lag1 AS p, q_lag1 AS q FROM ticker_tests")
def fdr_qvalues(m: Market):
    p = corrs(m).select("ticker", F.round(r_p("raw_lag1", F.col("n_lag1")), 4).alias("p"))
    return stats.benjamini_hochberg(p, "p", "q").withColumn("q", F.round("q", 4))


POOLED = """p AS (SELECT ticker, return_1d AS y, sentiment_lag1 AS x FROM lagged
      WHERE return_1d IS NOT NULL AND sentiment_lag1 IS NOT NULL),
    d AS (SELECT ticker, y - avg(y) OVER (PARTITION BY ticker) AS y, x - avg(x) OVER (PARTITION BY ticker) AS x FROM p),
    b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM d),
    g AS (SELECT ticker, sum(x * (y - b * x)) AS s FROM d, b GROUP BY 1),
    e AS (SELECT sqrt(sum(s * s)) AS root, count(*) AS n_tickers FROM g)
    SELECT n, n_tickers, round(b, 6) + 0.0 AS slope, round(root / xx, 6) AS se, round(b / (root / xx), 3) + 0.0 AS t"""


@query("pooled_slope", POOLED + " FROM b, e")
def pooled_slope(m: Market):
    return stats.pooled_slope(lagged(m)).drop("raw_t")


@query("pooled_slope_test", f"{POOLED}, round({t_p_sql('(b / (root / xx))', 'greatest(n_tickers - 1, 1)')}, 4) + 0.0 AS p FROM b, e")
def pooled_slope_test(m: Market):
    return stats.pooled_slope_p(stats.pooled_slope(lagged(m)))


FEATURES = ["rsi_14", "macd_hist", "volatility_20", "momentum_5", "momentum_21", "momentum_63"]
view("targets", """SELECT *, lead(close, 1) OVER w / nullif(close, 0) - 1 AS target_ret_1d,
    lead(close, 5) OVER w / nullif(close, 0) - 1 AS target_ret_5d, lead(close, 21) OVER w / nullif(close, 0) - 1 AS target_ret_21d
    FROM technicals WINDOW w AS (PARTITION BY asset_id ORDER BY d)""")
_TARGETS = ["target_ret_1d", "target_ret_5d", "target_ret_21d"]
CELLS = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({corr_sql(a, b)}, 6) + 0.0 AS r FROM targets"
                           for a in FEATURES for b in _TARGETS)


@query("feature_target_matrix", CELLS.replace("SELECT", "mm AS MATERIALIZED (SELECT * FROM targets) SELECT", 1).replace("FROM targets", "FROM mm").replace("(SELECT * FROM mm)", "(SELECT * FROM targets)"))
def feature_target_matrix(m: Market):
    panel = returns.forward_targets(m.technicals, [1, 5, 21])
    return stats.correlation_matrix(panel, FEATURES, _TARGETS).withColumn("r", r("r"))


_SENTI = ["return_1d", "volume", "sentiment_index", "news_count"]


@query("feature_matrix", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({corr_sql(a, b)}, 6) + 0.0 AS r FROM metrics"
                                            for a in _SENTI for b in _SENTI))
def feature_matrix(m: Market):
    return stats.correlation_matrix(m.metrics, _SENTI, _SENTI).withColumn("r", r("r"))


@query("return_profile", """SELECT count(return_1d) AS n, round(avg(return_1d), 6) AS mean, round(stddev_samp(return_1d), 6) AS std,
    round(min(return_1d), 6) AS min, round(max(return_1d), 6) AS max, round(skewness(return_1d), 6) AS skew,
    round(kurtosis(return_1d), 6) AS kurtosis, round(quantile_cont(return_1d, 0.25), 6) AS q25,
    round(quantile_cont(return_1d, 0.5), 6) AS q50, round(quantile_cont(return_1d, 0.75), 6) AS q75 FROM prices""")
def return_profile(m: Market):
    p = stats.return_profile(m.prices)
    return p.select("n", *[F.round(c, 6).alias(c) for c in p.columns if c != "n"])


@query("return_histogram", """SELECT CAST(least(floor((least(greatest(return_1d, -0.1), 0.1) - -0.1) / ((0.1 - -0.1) / 80)), 79) AS INTEGER) AS bin,
    count(*) AS n FROM prices WHERE return_1d IS NOT NULL GROUP BY 1""")
def return_histogram(m: Market):
    return ranking.histogram(m.prices, "return_1d", -0.1, 0.1, 80)


@query("volatility_by_ticker", "SELECT ticker, round(stddev_samp(return_1d) * 100, 6) AS vol_pct FROM prices GROUP BY 1 ORDER BY 2 DESC")
def volatility_by_ticker(m: Market):
    return (m.prices.groupBy("ticker").agg(F.round(F.stddev_samp("return_1d") * 100, 6).alias("vol_pct"))
            .orderBy(F.desc("vol_pct"), "ticker"))


view("vol20", """SELECT *, abs(return_1d) AS abs_ret, CASE WHEN count(return_1d) OVER v = 20 THEN stddev_samp(return_1d) OVER v END AS vol
    FROM prices WINDOW v AS (PARTITION BY asset_id ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")


def _auto_sql(col: str, lags, label: str) -> str:
    parts = []
    for k in lags:
        parts.append(f"""SELECT {k} AS lag, round(avg(r), 6) + 0.0 AS mean_r, round(min(r), 6) + 0.0 AS min_r, round(max(r), 6) + 0.0 AS max_r,
          '{label}' AS series FROM (SELECT asset_id, {corr_sql(col, 'l')} AS r FROM (SELECT asset_id, {col},
          lag({col}, {k}) OVER (PARTITION BY asset_id ORDER BY d) AS l FROM vol20) GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query("autocorrelations", f"SELECT * FROM ({_auto_sql('return_1d', [1], 'return')} UNION ALL {_auto_sql('abs_ret', [1], 'abs_return')} UNION ALL {_auto_sql('vol', [5, 20], 'vol_20')})")
def autocorrelations(m: Market):
    p = technicals.rolling_volatility(m.prices).withColumn("abs_ret", F.abs("return_1d"))
    parts = [stats.autocorrelations(p, "return_1d", [1], "return"), stats.autocorrelations(p, "abs_ret", [1], "abs_return"),
             stats.autocorrelations(p, "volatility_20", [5, 20], "vol_20")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumns({c: r(c) for c in ("mean_r", "min_r", "max_r")})


@query("effective_sample", """z AS (SELECT asset_id, d, (return_1d - avg(return_1d) OVER w) / nullif(stddev_pop(return_1d) OVER w, 0) AS z
      FROM prices WINDOW w AS (PARTITION BY asset_id)),
    y AS (SELECT d, sum(z) AS s, sum(z * z) AS q, count(*) AS k FROM z WHERE z IS NOT NULL GROUP BY d),
    m AS (SELECT sum(s * s - q) / sum(k * (k - 1)) AS mean_r FROM y),
    c AS (SELECT mean_r, (SELECT count(DISTINCT asset_id) FROM z WHERE z IS NOT NULL) AS n_assets, (SELECT count(return_1d) FROM prices) AS n FROM m)
    SELECT round(mean_r, 6) + 0.0 AS mean_r, n_assets, n, round(1 + (n_assets - 1) * mean_r, 6) AS design_effect,
      round(n / (1 + (n_assets - 1) * mean_r), 3) AS n_eff FROM c""")
def effective_sample(m: Market):
    e = stats.design_effect(m.prices, "return_1d", m.prices.agg(F.count("return_1d")).scalar())
    return e.withColumns({"mean_r": r("mean_r"), "n_eff": F.round("n_eff", 3), "design_effect": F.round("design_effect", 6)})


PAIRS_SQL = """pairs AS (SELECT a.asset_id AS asset_a, b.asset_id AS asset_b, count(*) AS n,
      covar_pop(a.return_1d, b.return_1d) / nullif(stddev_pop(a.return_1d) * stddev_pop(b.return_1d), 0) AS r
      FROM prices a JOIN prices b ON a.d = b.d AND a.asset_id < b.asset_id
      WHERE a.return_1d IS NOT NULL AND b.return_1d IS NOT NULL GROUP BY 1, 2)"""


@query("pair_correlations", f"{PAIRS_SQL} SELECT asset_a, asset_b, n, round(r, 6) + 0.0 AS r FROM pairs")
def pair_correlations(m: Market):
    return pairs.pair_correlations(m.prices, "return_1d").withColumn("r", r("r"))


@query("pair_effective_sample", PAIRS_SQL + """, k AS (SELECT * FROM pairs WHERE n >= 20 AND r IS NOT NULL),
    c AS (SELECT (SELECT avg(r) FROM k) AS mean_r, (SELECT count(*) FROM k) AS n_pairs, (SELECT count(return_1d) FROM prices) AS n,
      (SELECT count(*) FROM (SELECT asset_a FROM k UNION SELECT asset_b FROM k)) AS n_assets)
    SELECT round(mean_r, 6) + 0.0 AS mean_r, n_pairs, n_assets, n, round(1 + (n_assets - 1) * mean_r, 6) AS design_effect,
      round(n / (1 + (n_assets - 1) * mean_r), 3) AS n_eff FROM c""")
def pair_effective_sample(m: Market):
    prices = cut_lineage(m.prices.select("asset_id", "d", "return_1d"), "returns")
    e = pairs.pair_design_effect(pairs.pair_correlations(prices, "return_1d"), prices.agg(F.count("return_1d")).scalar(), 20)
    return e.withColumns({"mean_r": r("mean_r"), "n_eff": F.round("n_eff", 3), "design_effect": F.round("design_effect", 6)})


@query("forecast_band", """v AS (SELECT ticker, d, stddev_samp(return_1d) OVER w20 AS v20, stddev_samp(return_1d) OVER w60 AS v60, count(return_1d) OVER w60 AS n FROM prices
      WINDOW w20 AS (PARTITION BY asset_id ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY asset_id ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    a AS (SELECT ticker, d, v20 * (sqrt(252) * 100) AS current, v60 * (sqrt(252) * 100) AS forecast FROM v WHERE n = 60)
    SELECT ticker, d, round(current, 6) AS current, round(forecast, 6) AS forecast, round(greatest(forecast - 500, 0), 6) AS band_low, round(forecast + 500, 6) AS band_high,
      round(forecast / nullif(current, 0), 6) AS ratio FROM a""", "d")
def forecast_band(m: Market):
    v = technicals.rolling_volatility(m.prices, (20, 60)).filter("volatility_60 IS NOT NULL")
    v = v.withColumns({"current": X.annual_pct("volatility_20"), "forecast": X.annual_pct("volatility_60")})
    lo, hi = X.forecast_band("forecast", F.lit(500.0))
    cols = {"current": "current", "forecast": "forecast", "band_low": lo, "band_high": hi,
            "ratio": F.when(F.col("current") > 0, X.ratio("forecast", "current"))}
    return v.select("ticker", "d", *[F.round(c, 6).alias(k) for k, c in cols.items()])


@query("significance_stars", "SELECT ticker, sig_lag1 AS stars FROM ticker_tests")
def significance_stars(m: Market):
    return corrs(m).select("ticker", X.stars(F.round(r_p("raw_lag1", F.col("n_lag1")), 4)).alias("stars"))


@query("sentiment_share", """c AS (SELECT ticker, d, abs(coalesce(sentiment_index, 0) * 0.5) + abs(coalesce(sentiment_lag1, 0) * 0.2) AS s, abs(coalesce(return_1d, 0) * 0.1) AS t FROM lagged)
    SELECT ticker, d, round(coalesce(s / nullif(s + t, 0), 0), 6) AS sentiment_share FROM c""", "d")
def sentiment_share(m: Market):
    from marketloom.functions import params as P
    from marketloom.operators.learning import share_of_list
    part = lambda c, w: F.struct(F.lit(c).alias("feature"), (F.coalesce(c, F.lit(0.0)) * w).alias("shap"))
    cells = F.array(part("sentiment_index", 0.5), part("sentiment_lag1", 0.2), part("return_1d", 0.1))
    return lagged(m).select("ticker", "d", F.round(share_of_list(cells, P.SENTIMENT_FEATURES), 6).alias("sentiment_share"))
