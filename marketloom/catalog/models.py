"""Fitted models, with the library's own numbers of rounds. They have no SQL
form; rows, baselines, invariants and planted signals are tested instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from marketloom.catalog.base import query
from marketloom.catalog.panels import fund_panel
from marketloom.functions import params as P
from marketloom.functions import text as T
from marketloom.functions.numeric import r
from marketloom.functions.tails import r_p_sql
from marketloom.operators import learning as L
from marketloom.plans import panels, research as R
from marketloom.sources.tables import Market

BOTH = P.TECHNICAL_FEATURES + P.SENTIMENT_FEATURES


def tech(m: Market, horizons=P.DIRECTION_HORIZONS):
    return panels.technical_panel(m.technicals, list(horizons))


def senti(m: Market, horizons=P.DIRECTION_HORIZONS):
    """The sentiment panel of the assets with 30 days of sentiment or more."""
    eligible = panels.eligible_assets(m.sentiment_daily, m.assets).select("ticker")
    return panels.sentiment_panel(m.technicals, m.sentiment_daily, list(horizons)).join(eligible, "ticker", "left_semi")


def each(parts):
    """The reports of several horizons, those that have one."""
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


@query("direction_backtest")
def direction_backtest(m: Market):
    return R.direction_report(tech(m, [5]), explain=False).metrics


@query("ticker_direction", dates="latest_date")
def ticker_direction(m: Market):
    """The report of every ticker's own model."""
    return R.predict_tickers(tech(m, [5]))


@query("direction_signals", dates="latest_date")
def direction_signals(m: Market):
    return R.direction_report(tech(m, [5]), explain=False).latest


@query("direction_explanations")
def direction_explanations(m: Market):
    return R.direction_report(tech(m, [5])).explanation


@query("direction_equity", dates="d")
def direction_equity(m: Market):
    return R.direction_report(tech(m, [5]), kind="logistic", explain=False).curve


@query("direction_walk_forward", dates="test_start test_end")
def direction_walk_forward(m: Market):
    rows = panels.usable(tech(m, [5]), P.TECHNICAL_FEATURES + ["target_dir_5d"])
    rows = R.cut_lineage(rows.select(*R.KEYS, *P.TECHNICAL_FEATURES, "target_dir_5d"), "wf-rows")
    return R.walk_forward_direction(rows, P.TECHNICAL_FEATURES, "target_dir_5d")


@query("sentiment_backtest")
def sentiment_backtest(m: Market):
    return R.direction_report(senti(m, [5]), BOTH, min_rows=60, explain=False).metrics


@query("sentiment_walk_forward", dates="test_start test_end")
def sentiment_walk_forward(m: Market):
    rows = R.cut_lineage(panels.usable(senti(m, [5]), BOTH + ["target_dir_5d"]).select(*R.KEYS, *BOTH, "target_dir_5d"), "wf-rows")
    return R.walk_forward_direction(rows, BOTH, "target_dir_5d", 3, 5)


def grid(m: Market, kind: str):
    s = senti(m)
    return R.direction_grid({"technical": (tech(m), P.TECHNICAL_FEATURES), "technical_same_rows": (s, P.TECHNICAL_FEATURES),
                             "technical_sentiment": (s, BOTH)}, kinds=(kind,))


@query("direction_grid")
def direction_grid(m: Market):
    return grid(m, "logistic")


@query("direction_grid_boosted")
def direction_grid_boosted(m: Market):
    return grid(m, "boosted")


@query("case_studies", dates="d")
def case_studies(m: Market):
    named = m.mentions.select("ticker", "published_d", F.col("source_id").alias("event_id"), F.col("published_d").alias("published_at"),
                              F.concat("sentiment_label", F.lit(" mention by "), F.col("source_id").cast("string")).alias("title"))
    return R.case_studies(senti(m, [5]), named)


@query("global_attribution")
def global_attribution(m: Market):
    return R.global_attribution(tech(m, [21]))


@query("fundamentals_ols")
def fundamentals_ols(m: Market):
    panel = fund_panel(m)
    reports = {h: R.ols_report(panel, h) for h in P.FUNDAMENTAL_HORIZONS}
    return each([out.withColumn("horizon", F.lit(h)) for h, out in reports.items() if out is not None])


@query("fundamentals_ols_folds", dates="test_start test_end")
def fundamentals_ols_folds(m: Market):
    panel = fund_panel(m)
    reports = {h: R.ols_walk_forward(panel, h) for h in P.FUNDAMENTAL_HORIZONS}
    return each([out.withColumn("horizon", F.lit(h)) for h, out in reports.items() if out is not None])


def _stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.10 THEN '*' ELSE 'ns' END"


@query("fundamentals_factors", f"""p AS (SELECT *, {r_p_sql('spearman', 'n')} AS p_s, {r_p_sql('pearson', 'n')} AS p_p FROM factor_tests)
    SELECT feature, horizon, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('pearson', 'spearman'))}, round(p_s, 6) + 0.0 AS p_spearman,
      round(p_p, 6) + 0.0 AS p_pearson, {_stars('p_s')} AS sig_spearman, {_stars('p_p')} AS sig_pearson FROM p""")
def fundamentals_factors(m: Market):
    return R.factor_table(fund_panel(m)).withColumns({c: r(c) for c in ("pearson", "spearman", "p_spearman", "p_pearson")})


def vola(m: Market):
    """The volatility panel. Its bars, read twice by it, and itself, read by
    every fit and forecast, are written once, so that trades are read once."""
    return R.cut_lineage(panels.volatility_panel(R.cut_lineage(m.prices, "vol-bars")), "vol-panel")


def outlooks(m: Market, part: int):
    """One of evaluation and forecasts, for all horizons."""
    return each([out[part] for out in R.volatility_outlooks(vola(m)).values()])


@query("volatility_evaluation", dates="test_start test_end")
def volatility_evaluation(m: Market):
    return outlooks(m, 0)


@query("volatility_forecasts", dates="as_of")
def volatility_forecasts(m: Market):
    return outlooks(m, 1)


@query("volatility_walk_forward", dates="test_start test_end")
def volatility_walk_forward(m: Market):
    return R.volatility_walk_forwards(vola(m))


@query("volatility_ablation")
def volatility_ablation(m: Market):
    return R.volatility_ablation(vola(m))


@query("hypothesis_hit_rate")
def hypothesis_hit_rate(m: Market):
    return R.hit_rate_hypothesis(tech(m))


@query("hypothesis_paired")
def hypothesis_paired(m: Market):
    return R.paired_hypothesis(senti(m))


@query("text_model_scores")
def text_model_scores(m: Market):
    """Class 0 pos (good, clean), 1 neg (toxic), 2 neu; blank texts are neutral."""
    label = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2)
    docs = m.news_text.withColumn("label", label.cast("double"))
    model = L.text_classifier(docs.filter(F.col("quality").isNotNull()))
    p = L.text_probabilities(model, m.news_text.select("doc_id", "text"), ["p_pos", "p_neg", "p_neu"])
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return p.select("doc_id", F.when(blank, 0.0).otherwise(F.round(F.col("p_pos") - F.col("p_neg"), 6)).alias("sentiment_score"),
                    F.when(blank, "neu").otherwise(T.label_from_probabilities("p_pos", "p_neg", "p_neu")).alias("sentiment_label"))


@query("text_model_held_out")
def text_model_held_out(m: Market):
    """As `text_model_scores`, each text scored by a model and a temperature that
    have not seen its label, with the held-out log loss beside that of the class shares."""
    label = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2)
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    docs = m.news_text.withColumns({"label": F.when(F.col("quality").isNotNull(), label), "blank": blank})
    names = ["p_pos", "p_neg", "p_neu"]
    p = L.cross_fitted_texts(docs, names, nested=True, keep=("blank",))
    loss = L.class_log_loss([F.col(c) for c in names], F.col("label"))
    return p.select("doc_id", "fold", F.round("temperature", 6).alias("temperature"), *[F.round(c, 6).alias(c) for c in names],
                    F.round(loss, 6).alias("log_loss"), F.round("share_loss", 6).alias("share_log_loss"),
                    F.when(F.col("blank"), 0.0).otherwise(F.round(F.col("p_pos") - F.col("p_neg"), 6)).alias("sentiment_score"),
                    F.when(F.col("blank"), "neu").otherwise(T.label_from_probabilities("p_pos", "p_neg", "p_neu")).alias("sentiment_label"))
