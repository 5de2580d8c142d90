import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import numeric as X
from marketloom.functions import tails
from marketloom.operators import learning, ranking, stats
from marketloom.plans import research


def col(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_quantiles_with_a_dominant_value(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(500), rng.normal(size=1000)])
    got = ranking.quantiles(col(spark, x), [], "x", {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "e": 0.0, "f": 1.0}).first()
    np.testing.assert_allclose([got.a, got.b, got.c, got.d, got.e, got.f], np.quantile(x, [.01, .25, .5, .99, 0, 1]))


def test_quantiles_per_key(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 5.0)]
    got = {r.k: (r.lo, r.hi) for r in ranking.quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"lo": .01, "hi": .99}).collect()}
    assert got == {"a": (1.0, 99.0), "b": (5.0, 5.0)}


def test_average_ranks(spark):
    x = [3, 1, 1, 2, 3, 3]
    got = {r.x: r.rk for r in ranking.average_ranks(col(spark, x), [], "x", "rk").collect()}
    want = pd.Series(x).rank()
    assert all(got[float(v)] == w for v, w in zip(x, want))


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"pe_ratio": rng.integers(0, 12, 400).astype(float)})
    df["fwd_ret_63d"] = np.round(df["pe_ratio"] * 0.1 + rng.normal(size=400), 1)
    pairs = stats.long_pairs(spark.createDataFrame(df), ["pe_ratio"], [63])
    r = stats.rank_correlations(pairs).first()
    assert r.n == 400
    assert r.pearson == pytest.approx(df.corr().iloc[0, 1]) and r.spearman == pytest.approx(df.corr("spearman").iloc[0, 1])


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "x double, y double")
    assert df.agg(X.corr("x", "y").alias("r")).first().r is None


def test_skew_and_kurtosis_are_bias_corrected(spark):
    x = pd.Series(np.random.default_rng(2).exponential(size=200))
    r = col(spark, x).agg(X.sample_skew("x").alias("s"), X.sample_kurtosis("x").alias("k")).first()
    assert r.s == pytest.approx(x.skew()) and r.k == pytest.approx(x.kurt())


def test_winsor_bounds_come_from_train(spark):
    train = col(spark, range(101))
    test = col(spark, [-500, 50, 10545])
    out = stats.winsorise(test, stats.winsor_bounds(train, ["x"]), ["x"]).orderBy("x").collect()
    assert [r.x for r in out] == [1.0, 50.0, 99.0]


def test_baseline_r2(spark):
    train, test = [1.0, 2.0, 3.0], [4.0, 6.0]
    got = stats.baseline_r2(col(spark, train, "y"), col(spark, test, "y"), "y").first().baseline_r2
    assert got == pytest.approx(1 - ((4 - 2) ** 2 + (6 - 2) ** 2) / 2)


@pytest.mark.parametrize("t,dof,p", [(2.0, 10, 0.07338803), (1.959963985, 1e7, 0.05), (0.0, 5, 1.0), (12.706204736, 1, 0.05)])
def test_t_tail(t, dof, p):
    assert tails.t_two_sided(t, dof) == pytest.approx(p, abs=1e-6)


def test_other_tails(spark):
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.chi2_1_upper(3.841458820694124) == pytest.approx(0.05)
    assert tails.binomial_two_sided(2, 10) == pytest.approx(0.109375) and tails.binomial_two_sided(5, 10) == 1.0
    df = spark.createDataFrame([(0.5, 30.0), (None, 30.0)], "r double, n double").select(tails.r_p("r", "n").alias("p")).collect()
    assert df[0].p == pytest.approx(0.004900, abs=1e-5) and df[1].p is None


def test_tails_as_columns_equal_the_plain_forms(spark):
    rows = [(t, d) for t in (0.0, 0.3, 1.5, -2.2, 4.0, 9.0, 40.0) for d in (1.0, 2.0, 5.0, 30.0, 400.0, 1e5)]
    got = spark.createDataFrame(rows, "t double, d double").select("t", "d", tails.t_p("t", "d").alias("p"), tails.z_p("t").alias("z")).collect()
    for r in got:
        assert r.p == pytest.approx(tails.t_two_sided(r.t, r.d), abs=1e-8)
        assert r.z == pytest.approx(tails.normal_two_sided(r.t), abs=1e-10)
    counts = [(a, b) for a in range(0, 24, 3) for b in range(0, 24, 5)] + [(40, 12), (25, 0)]
    got = spark.createDataFrame(counts, "a int, b int").select("a", "b", tails.mcnemar_p("a", "b").alias("p")).collect()
    for r in got:
        n = r.a + r.b
        want = tails.binomial_two_sided(min(r.a, r.b), n) if n < 25 else tails.chi2_1_upper((abs(r.a - r.b) - 1) ** 2 / n)
        assert r.p == pytest.approx(want, abs=1e-9)
    odd = spark.createDataFrame([(1.0, 10.0), (-1.0, 5.0), (0.2, 2.0), (0.3, None)], "r double, n double").select(tails.r_p("r", "n").alias("p")).collect()
    assert [r.p for r in odd] == [0.0, 0.0, 1.0, None]


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.04]
    got = {i: r.q for i, r in enumerate(stats.benjamini_hochberg(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p", "q").orderBy("i").collect())}
    known = [v for v in p if v is not None]
    order = sorted(known)
    q = lambda v: min(min(1.0, w * len(known) / (j + 1)) for j, w in enumerate(order) if w >= v)
    assert got[4] is None and all(got[i] == pytest.approx(q(v)) for i, v in enumerate(p) if v is not None)


def test_fisher_interval(spark):
    df = spark.createDataFrame([(0.5, 30), (1.0, 10), (0.5, 3), (None, 9)], "r double, n int")
    lo, hi = X.fisher_ci("r", "n")
    rows = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    z, half = math.atanh(0.5), 1.959963984540054 / math.sqrt(27)
    assert (rows[0].lo, rows[0].hi) == (round(math.tanh(z - half), 4), round(math.tanh(z + half), 4)) and rows[1].hi == 1.0
    assert rows[2].lo is None and rows[3].lo is None


def panel(spark, n_tickers=6, n=40, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n_tickers, n)) + np.arange(n_tickers)[:, None]
    y = 0.3 * x + rng.normal(size=x.shape) + 5 * np.arange(n_tickers)[:, None]
    rows = [(f"T{t}", float(x[t, i]), float(y[t, i])) for t in range(n_tickers) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "ticker string, sentiment_lag1 double, return_1d double")


def test_pooled_slope_against_demeaning(spark):
    x, y, df = panel(spark)
    xd, yd = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    beta = (xd * yd).sum() / (xd ** 2).sum()
    se = math.sqrt((((xd * (yd - beta * xd)).sum(1)) ** 2).sum()) / (xd ** 2).sum()
    r = stats.pooled_slope_p(stats.pooled_slope(df)).first()
    assert (r.n, r.n_tickers) == (240, 6)
    assert (r.slope, r.se, r.t) == (pytest.approx(beta, abs=1e-6), pytest.approx(se, abs=1e-6), pytest.approx(beta / se, abs=1e-3))
    assert 0 <= r.p <= 1


def test_pooled_slope_guards(spark):
    one = spark.createDataFrame([("T", float(i), float(i)) for i in range(30)], "ticker string, sentiment_lag1 double, return_1d double")
    r = stats.pooled_slope(one).first()
    assert (r.n, r.slope, r.se) == (30, None, None)


def test_mean_pair_correlation_equals_all_pairs_when_balanced(spark):
    rng = np.random.default_rng(4)
    common = rng.normal(size=200)
    x = pd.DataFrame({a: common + rng.normal(size=200) for a in range(4)})
    rows = [(a, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x.loc[i, a])) for a in range(4) for i in range(200)]
    df = spark.createDataFrame(rows, "asset_id int, d date, v double")
    got = stats.design_effect(df, "v", F.lit(800)).first()
    c = x.corr().to_numpy()
    mean = (c.sum() - 4) / 12
    assert got.mean_r == pytest.approx(mean) and got.design_effect == pytest.approx(1 + 3 * mean)
    assert got.n_eff == pytest.approx(800 / (1 + 3 * mean))


def test_mcnemar_exact_and_chi_square(spark):
    def table(a_only, b_only):
        rows = [(True, False)] * a_only + [(False, True)] * b_only + [(True, True)] * 3
        return stats.mcnemar_test(spark.createDataFrame(rows, "correct_a boolean, correct_b boolean")).first()
    small, large = table(2, 8), table(30, 10)
    assert (small.statistic, small.p_value) == (2.0, pytest.approx(0.109375))
    assert large.statistic == pytest.approx(19 ** 2 / 40) and large.p_value == pytest.approx(tails.chi2_1_upper(19 ** 2 / 40))


def test_auc_with_ties(spark):
    y, s = [1, 0, 1, 0, 1], [0.9, 0.9, 0.5, 0.1, 0.1]
    pairs = [(a > b) + 0.5 * (a == b) for i, a in enumerate(s) for j, b in enumerate(s) if y[i] == 1 and y[j] == 0]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    assert stats.auc(df, "y", "s").first().auc == pytest.approx(sum(pairs) / len(pairs))


def test_classification_without_positives(spark):
    r = stats.classification(spark.createDataFrame([(0, 0), (1, 0)], "y int, p int"), "y", "p").first()
    assert (r.precision, r.recall, r.f1, r.accuracy, r.beats_majority) == (0.0, 0.0, 0.0, 0.5, "~tie")


def weekly(spark, signal, n=200, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    y = signal * x[:, 0] * 0.05 + rng.normal(0, 0.1, n)
    rows = [(dt.date(2015, 1, 1) + dt.timedelta(weeks=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    cols = ", ".join(f"{f} double" for f in research.P.FUNDAMENTAL_FEATURES)
    return spark.createDataFrame(rows, f"anchor_date date, {cols}, fwd_ret_63d double")


def test_ols_finds_a_signal_and_no_noise(spark):
    strong, noise = research.ols_report(weekly(spark, 3), 63).first(), research.ols_report(weekly(spark, 0), 63).first()
    assert strong.test_r2 > 0.2 and strong.beats_baseline and strong.n_train + strong.n_test == 200
    assert noise.test_r2 < 0.10
    assert strong.coef_revenue_growth_qoq == pytest.approx(0.15, abs=0.05)


def test_ols_needs_enough_rows(spark):
    assert research.ols_report(weekly(spark, 1, n=25), 63) is None


def test_ols_folds_are_ordered(spark):
    rows = research.ols_walk_forward(weekly(spark, 3), 63).orderBy("fold").collect()
    assert len(rows) == 5 and all(a.test_end < b.test_start for a, b in zip(rows, rows[1:]))


def direction(spark, n=240, seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.normal(), rng.normal()
        rows.append(("T", 1, dt.date(2015, 1, 1) + dt.timedelta(days=i), a, b, int(a + 0.2 * rng.normal() > 0), float(a / 100)))
    return spark.createDataFrame(rows, "ticker string, asset_id int, d date, feat_a double, feat_b double, target_dir_5d int, target_ret_5d double")


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_direction_report(spark, kind):
    rep = research.direction_report(direction(spark), ["feat_a", "feat_b"], kind=kind, rounds=5)
    m = rep.metrics.first()
    assert m.accuracy > 0.8 and m.beats_baseline and m.n_train + m.n_test == 240 and m.n_test_days == 60
    assert rep.latest.first().latest_signal in ("UP", "DOWN") and rep.latest.first().latest_confidence >= 0.5
    parts = rep.explanation.collect()
    assert [p.feature for p in parts] == ["feat_a", "feat_b"]
    assert abs(parts[0].contribution) >= abs(parts[1].contribution)


def test_too_few_rows_give_no_report(spark):
    assert research.direction_report(direction(spark, 100), ["feat_a", "feat_b"], kind="logistic") is None


def test_attribution_is_additive(spark):
    rows = direction(spark)
    model = learning.fit_direction(rows, ["feat_a", "feat_b"], "target_dir_5d", "boosted", rounds=3)
    some = rows.limit(5)
    a = learning.sampled_attribution(model, some, rows, ["feat_a", "feat_b"], ["d"], permutations=4)
    total = {r.d: r.s for r in a.groupBy("d").agg(F.sum("contribution").alias("s")).collect()}
    base = rows.agg(F.avg("feat_a").alias("feat_a"), F.avg("feat_b").alias("feat_b"))
    out = lambda df: model.transform(df).withColumn("m", learning.margin(df))
    b = out(base).first().m
    for r in out(some).collect():
        assert total[r.d] == pytest.approx(r.m - b, abs=1e-9)


def test_sentiment_share(spark):
    t = "array<struct<feature:string,value:double,shap:double>>"
    rows = [(1, [("sentiment_index", 0.1, 0.4)]), (2, [("rsi_14", 50.0, 0.4)]), (3, [("sentiment_lag1", 0.1, -0.3), ("rsi_14", 50.0, 0.3)]), (4, [])]
    df = spark.createDataFrame(rows, f"i int, e {t}")
    got = [r.s for r in df.select("i", learning.share_of_list("e", research.P.SENTIMENT_FEATURES).alias("s")).orderBy("i").collect()]
    assert got == [1.0, 0.0, 0.5, 0.0]
    long = spark.createDataFrame([(3, "sentiment_lag1", -0.3), (3, "rsi_14", 0.3)], "i int, feature string, contribution double")
    assert learning.sentiment_share(long, ["i"], research.P.SENTIMENT_FEATURES).first().sentiment_share == 0.5


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7)
    a = {r.id for r in ranking.sample_rows(df.repartition(7), ["id"], 50).collect()}
    assert a == {r.id for r in ranking.sample_rows(df.repartition(3), ["id"], 50).collect()} and len(a) == 50
