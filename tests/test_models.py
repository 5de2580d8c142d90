"""Model evaluations on data with a planted signal: each must find it, and must not find one in noise."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.catalog import models as catalog
from marketloom.functions import params as P
from marketloom.operators import learning
from marketloom.plans import research
from marketloom.sources.tables import Market

BOTH = P.TECHNICAL_FEATURES + P.SENTIMENT_FEATURES
DAY = dt.date(2015, 1, 1)


def panel(spark, drives, features=BOTH, horizons=(1, 5, 21), days=130, tickers=2, seed=1):
    """Rows whose direction follows the feature `drives` (noise where it is None)."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tickers):
        for i in range(days):
            x = rng.normal(size=len(features))
            pull = x[features.index(drives)] if drives else 0.0
            up = [int(pull + 0.3 * rng.normal() > 0) for _ in horizons]
            rows.append((f"T{t}", t, DAY + dt.timedelta(days=i), *map(float, x), *up, *[0.02 * (2 * u - 1) for u in up]))
    cols = [f"{f} double" for f in features] + [f"target_dir_{h}d int" for h in horizons] + [f"target_ret_{h}d double" for h in horizons]
    return spark.createDataFrame(rows, "ticker string, asset_id int, d date, " + ", ".join(cols))


def volatility(spark, drives="log_vol_20", horizons=(21,), days=700, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(days):
        x = rng.normal(size=len(P.VOLATILITY_FEATURES))
        y = 0.3 * x[P.VOLATILITY_FEATURES.index(drives)] - 4 + 0.05 * rng.normal()
        for t in range(2):
            rows.append((f"T{t}", t, DAY + dt.timedelta(days=i), *map(float, x), *[float(y)] * len(horizons), *[float(-4 + 0.3 * rng.normal()) for _ in horizons]))
    cols = [f"{f} double" for f in P.VOLATILITY_FEATURES] + [f"target_logvol_{h}d double" for h in horizons] + [f"persistence_{h}d double" for h in horizons]
    return spark.createDataFrame(rows, "ticker string, asset_id int, d date, " + ", ".join(cols))


def test_walk_forward_finds_the_signal(spark):
    strong = research.walk_forward_direction(panel(spark, "rsi_14"), BOTH, "target_dir_5d", 3, 5, "logistic").collect()
    noise = research.walk_forward_direction(panel(spark, None), BOTH, "target_dir_5d", 3, 5, "logistic").collect()
    assert len(strong) == 3 and all(r.accuracy > 0.75 and r.beats_baseline for r in strong)
    assert all(r.accuracy < 0.75 for r in noise)


def test_predict_panel_is_one_row(spark):
    data = panel(spark, "rsi_14", days=260)
    row = research.predict_panel(data, "T1", kind="logistic").collect()
    assert len(row) == 1 and row[0].ticker == "T1" and row[0].n_train + row[0].n_test == 260
    assert row[0].accuracy > 0.75 and row[0].n_folds == 5 and row[0].folds_beating_baseline >= 4
    assert row[0].final_return_strategy > 0 > row[0].final_return_buy_hold - row[0].final_return_strategy
    assert row[0].latest_signal in ("UP", "DOWN") and row[0].latest_date == DAY + dt.timedelta(days=259)
    assert research.predict_panel(data, "none", kind="logistic") is None


def test_grid_shows_which_features_help(spark):
    data = panel(spark, "sentiment_index")
    cells = {(r.features, r.horizon): r for r in research.direction_grid({"technical": (data, P.TECHNICAL_FEATURES), "both": (data, BOTH)}, kinds=("logistic",)).collect()}
    assert len(cells) == 6
    assert all(cells["both", h].accuracy > 0.75 > cells["technical", h].accuracy and cells["both", h].auc > 0.8 for h in (1, 5, 21))


def test_case_studies_are_sure_and_owe_to_sentiment(spark):
    data = panel(spark, "sentiment_index")
    news = data.select("ticker", F.col("d").alias("published_d"), F.lit(1).alias("event_id"), F.col("d").alias("published_at"), F.lit("title").alias("title"))
    rows = research.case_studies(data, news, kind="logistic").collect()
    assert len(rows) == 3 and all(r.confidence >= 0.65 and r.sentiment_share > 0.5 and r.sample_headline == "title" for r in rows)


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_global_attribution_names_the_driver(spark, kind):
    rows = research.global_attribution(panel(spark, "macd_hist"), 21, rounds=5, kind=kind).collect()
    assert rows[0].feature == "macd_hist" and rows[0].mean_abs > 3 * rows[1].mean_abs and len(rows) == len(P.TECHNICAL_FEATURES)


def test_linear_attribution_adds_up(spark):
    data = panel(spark, "rsi_14")
    model = learning.fit_direction(data, P.TECHNICAL_FEATURES, "target_dir_5d", "logistic")
    some = data.limit(4)
    total = {(r.ticker, r.d): r.s for r in learning.linear_attribution(model, some, P.TECHNICAL_FEATURES, ["ticker", "d"]).groupBy("ticker", "d").agg(F.sum("contribution").alias("s")).collect()}
    scored = model.transform(some).withColumn("m", learning.margin(some))
    assert all(total[r.ticker, r.d] + model.stages[-1].intercept == pytest.approx(r.m, abs=1e-9) for r in scored.collect())


def test_hypotheses_reject_only_with_a_signal(spark):
    strong, noise = research.hit_rate_hypothesis(panel(spark, "rsi_14")).collect(), research.hit_rate_hypothesis(panel(spark, None)).collect()
    assert all(r.reject and r.hit_rate > r.baseline for r in strong) and not all(r.reject and r.hit_rate > r.baseline for r in noise)
    paired = research.paired_hypothesis(panel(spark, "sentiment_index")).collect()
    assert len(paired) == 3 and all(r.reject and r.b_only > r.a_only for r in paired)


def test_volatility_outlook_beats_persistence(spark):
    evaluation, forecasts = research.volatility_outlook(volatility(spark, days=1100), 21, rounds=25)
    e = evaluation.first()
    assert e.beats_persistence and e.test_r2 > 0.3 and e.skill > 0.3 and e.horizon == 21
    f = forecasts.collect()
    assert {r.ticker for r in f} == {"T0", "T1"} and all(r.band_low_annpct <= r.forecast_annpct <= r.band_high_annpct for r in f)


def test_volatility_forecasts_read_trades_once(spark, monkeypatch):
    """All forecasts come from one written panel: nothing they return goes back to the trades."""
    outlooks = research.volatility_outlooks
    monkeypatch.setattr(research, "volatility_outlooks", lambda panel: outlooks(panel, rounds=2))
    out = catalog.volatility_forecasts(Market(spark, "/root/testdata/sf0.01"))
    assert not any("lineitem" in f for f in out.inputFiles()) and out.count() == 50
    assert not any("lineitem" in f for f in catalog.vola(Market(spark, "/root/testdata/sf0.001")).inputFiles())


def test_volatility_needs_rows(spark):
    assert research.volatility_outlook(volatility(spark, days=120), 21, rounds=2) is None


def test_volatility_folds_and_ablation(spark):
    data = volatility(spark)
    folds = research.volatility_walk_forward(data, 21, rounds=20).collect()
    assert folds and all(r.skill > 0.2 for r in folds)
    r2 = {r.features: r.test_r2 for r in research.volatility_ablation(data, rounds=20).collect()}
    assert r2["only_log_vol_20"] > 0.3 and r2["all"] > 0.3 and r2["without_log_vol_20"] < 0.1


def test_text_classifier_learns_the_classes(spark):
    words = {0: "gain profit", 1: "loss fraud", 2: "meeting table"}
    rows = [(i, f"{words[i % 3]} word{i % 7} word{i % 5}", float(i % 3)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, label double")
    model = learning.text_classifier(docs)
    new = spark.createDataFrame([(0, "a big gain"), (1, "some fraud"), (2, "the table")], "doc_id int, text string")
    for r in learning.text_probabilities(model, new, ["p0", "p1", "p2"]).collect():
        assert max(range(3), key=lambda i: r[f"p{i}"]) == r.doc_id


def test_small_tables_train_in_few_tasks(spark):
    rows = spark.range(100).repartition(8)
    assert learning.in_tasks(rows, 100).rdd.getNumPartitions() == 1
    assert learning.in_tasks(rows, 200_000).rdd.getNumPartitions() == 4
