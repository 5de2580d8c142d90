"""Correlations, tests and evaluation metrics."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions import numeric as X
from marketloom.functions.tails import mcnemar_p, r_p, t_p
from marketloom.functions.text import display_name
from marketloom.operators import ranking
from marketloom.operators.rows import beside
from marketloom.session import cut_lineage

MIN_PAIRS = 5


def ticker_correlations(lagged: DataFrame) -> DataFrame:
    """Per ticker: Pearson r of the return with sentiment at lag 0, 1 and 2,
    pairs, interval, best lag and hit rate. One aggregation over the panel."""
    aggs = []
    for name, col in (("t", "sentiment_index"), ("lag1", "sentiment_lag1"), ("lag2", "sentiment_lag2")):
        n = X.pairs("return_1d", col)
        aggs += [n.alias(f"n_{name}"),
                 F.when(n >= MIN_PAIRS, X.corr("return_1d", col)).alias(f"raw_{name}")]
    ok = (F.col("return_1d").isNotNull() & F.col("sentiment_lag1").isNotNull()
          & (F.col("sentiment_lag1") != 0))
    hit = (F.col("return_1d") > 0) == (F.col("sentiment_lag1") > 0)
    aggs += [F.count_if(ok).alias("hit_n"), F.count_if(ok & hit).alias("hits")]
    out = lagged.groupBy("ticker").agg(*aggs)
    out = out.withColumns({f"corr_{k}": X.r(f"raw_{k}", 4) for k in ("t", "lag1", "lag2")})
    lo, hi = X.fisher_ci("corr_lag1", "n_lag1")
    a1 = F.abs(F.coalesce("corr_lag1", F.lit(0.0)))
    a2 = F.abs(F.coalesce("corr_lag2", F.lit(0.0)))
    return out.withColumns({
        "display_name": display_name("ticker"), "ci_lo": lo, "ci_hi": hi,
        "n_flag": F.when(F.col("n_lag1") < 30, "low").otherwise("ok"),
        "hit_rate": F.when(F.col("hit_n") >= MIN_PAIRS, X.r(F.col("hits") / F.col("hit_n") * 100, 1)),
        "best_lag": F.when((a1 == 0) & (a2 == 0), "N/A").when(a1 >= a2, "Lag 1").otherwise("Lag 2"),
    }).drop("hits")


def with_p_values(corrs: DataFrame) -> DataFrame:
    """p-values and stars per lag and the corrected q-value of lag 1."""
    out = corrs.withColumns({f"p_{k}": F.round(r_p(f"raw_{k}", F.col(f"n_{k}").cast("double")), 4)
                             for k in ("t", "lag1", "lag2")})
    out = out.withColumns({f"sig_{k}": X.stars(f"p_{k}") for k in ("t", "lag1", "lag2")})
    out = benjamini_hochberg(out, "p_lag1", "q_lag1").withColumn("q_lag1", F.round("q_lag1", 4))
    return out.withColumn("sig_lag1_fdr", F.when(F.col("q_lag1").isNotNull(), X.stars("q_lag1")))


def benjamini_hochberg(tests: DataFrame, p: str, q: str) -> DataFrame:
    """q-values over the rows with a p-value; one row per test, so the window
    is as small as the number of tests."""
    order = Window.partitionBy(F.col(p).isNull()).orderBy(F.col(p))
    m = F.count(p).over(Window.partitionBy(F.col(p).isNull()))
    scaled = tests.withColumn("_scaled", F.col(p) * m / F.row_number().over(order))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    value = F.least(F.min("_scaled").over(rest), F.lit(1.0))
    return scaled.withColumn(q, F.when(F.col(p).isNotNull(), value)).drop("_scaled")


def correlation_ranking(corrs: DataFrame) -> DataFrame:
    """Strongest lag-1 correlation first, NULL as 0."""
    return corrs.orderBy(F.abs(F.coalesce("corr_lag1", F.lit(0.0))).desc(), "ticker")


def correlation_summary(corrs: DataFrame) -> DataFrame:
    """Best ticker, its r, and the mean hit rate over tickers that have one."""
    key = F.struct(F.abs(F.coalesce("corr_lag1", F.lit(0.0))).alias("a"), F.col("ticker"))
    best = F.max_by(F.struct("ticker", "corr_lag1"), key)
    return corrs.agg(best.alias("b"), X.r(F.avg("hit_rate"), 1).alias("avg_hit_rate")).select(
        F.col("b.ticker").alias("best_ticker"), F.col("b.corr_lag1").alias("best_r"), "avg_hit_rate")


def rolling_correlation(lagged: DataFrame, rows: int = 30) -> DataFrame:
    """r over the last `rows` complete pairs per ticker, 4 decimals."""
    both = lagged.filter(F.col("return_1d").isNotNull() & F.col("sentiment_lag1").isNotNull())
    w = X.trailing("asset_id", "d", rows)
    rho = F.when(F.count(F.lit(1)).over(w) == rows, X.corr_over("return_1d", "sentiment_lag1", w))
    return (both.select("ticker", "d", X.r(rho, 4).alias("rolling_r"))
            .filter(F.col("rolling_r").isNotNull()))


def conditional_returns(lagged: DataFrame) -> DataFrame:
    """Mean next return by sentiment bucket: (.., -0.15], (-0.15, 0.15], above."""
    x = F.col("sentiment_lag1")
    bucket = F.when(x <= -0.15, "Negative").when(x <= 0.15, "Neutral").otherwise("Positive")
    return (lagged.filter(x.isNotNull() & F.col("return_1d").isNotNull())
            .groupBy("ticker", bucket.alias("senti_group"))
            .agg(X.r(F.avg("return_1d") * 100, 4).alias("avg_return"),
                 F.count(F.lit(1)).alias("n")))


def pooled_slope(panel: DataFrame, y: str = "return_1d", x: str = "sentiment_lag1",
                 cluster: str = "ticker") -> DataFrame:
    """Fixed-effects slope with cluster-robust error, as one row.

    Demeaned sums of squares and products per cluster are n*var and n*cov, so
    rows are read once and only one row per cluster is left to combine.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n = F.count(F.lit(1)).cast("double")
    per = panel.filter(both).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), (n * F.var_pop(x)).alias("xx"),
        (n * F.covar_pop(x, y)).alias("xy"))
    beta = F.try_divide(F.sum("xy").over(Window.partitionBy()), F.sum("xx").over(Window.partitionBy()))
    score = per.withColumn("beta", beta).withColumn("s", F.col("xy") - F.col("beta") * F.col("xx"))
    out = score.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_tickers"),
                    F.max("beta").alias("b"), F.sum("xx").alias("xx"),
                    F.sum(F.col("s") * F.col("s")).alias("meat"))
    usable = (F.col("n") >= 10) & (F.col("n_tickers") >= 2) & (F.col("xx") > 0)
    se = F.when(usable & (F.col("meat") > 0), F.sqrt("meat") / F.col("xx"))
    return out.withColumn("_se", se).select(
        "n", "n_tickers", F.when(usable, X.r("b")).alias("slope"), X.r("_se").alias("se"),
        X.r(F.col("b") / F.col("_se"), 3).alias("t"), (F.col("b") / F.col("_se")).alias("raw_t"))


def pooled_slope_p(pooled: DataFrame) -> DataFrame:
    dof = F.greatest(F.col("n_tickers") - 1, F.lit(1)).cast("double")
    return pooled.withColumn("p", F.round(t_p("raw_t", dof), 4)).drop("raw_t")


def correlation_matrix(df: DataFrame, rows: list[str], cols: list[str]) -> DataFrame:
    """Pairwise-complete r of every (row, col) pair, in one aggregation."""
    pairs = [(a, b) for a in rows for b in cols]
    one = df.agg(*[X.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(cells))


def long_pairs(panel: DataFrame, features: list[str], horizons: list[int], prefix: str = "fwd_ret_",
               suffix: str = "d") -> DataFrame:
    """(feature, horizon, x, y) for every complete pair."""
    combos = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).alias("x"),
                 F.col(f"{prefix}{h}{suffix}").alias("y")) for f in features for h in horizons])
    return panel.select(F.inline(combos)).filter("x IS NOT NULL AND y IS NOT NULL")


def rank_correlations(pairs: DataFrame, min_n: int = 15) -> DataFrame:
    """Pearson and Spearman per (feature, horizon). Equal pairs are counted
    first, both sides are ranked in one pass, and ranks are joined by value, so
    no column is ranked in one task."""
    keys = ["feature", "horizon"]
    counted = cut_lineage(pairs.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")), "pairs")
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("value")) for c in ("x", "y")])
    values = counted.select(*keys, "w", F.inline(sides))
    ranks = cut_lineage(ranking.average_ranks(values, [*keys, "side"], "value", "rank", "w"), "ranks")
    side = lambda c: ranks.filter(F.col("side") == c).select(*keys, F.col("value").alias(c), F.col("rank").alias(f"r{c}"))
    ranked = counted.join(side("x"), [*keys, "x"]).join(side("y"), [*keys, "y"])
    sums = ranked.groupBy(*keys).agg(
        F.sum("w").alias("n"), _weighted_corr("x", "y").alias("pearson"),
        _weighted_corr("rx", "ry").alias("spearman"))
    return sums.filter(F.col("n") >= min_n)


def _weighted_corr(a: str, b: str) -> Column:
    """Pearson r with row counts as weights."""
    w, x, y = F.col("w"), F.col(a), F.col(b)
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    num = F.sum(w * x * y) - sx * sy / n
    den = F.sqrt((F.sum(w * x * x) - sx * sx / n) * (F.sum(w * y * y) - sy * sy / n))
    return F.try_divide(num, den)


def winsor_bounds(train: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(feature, lo, hi) from the training rows, linear interpolation."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return ranking.quantiles(train.select(F.inline(cells)), ["feature"], "x", {"lo": lo, "hi": hi})


def winsorise(df: DataFrame, bounds: DataFrame, cols: list[str]) -> DataFrame:
    """Clip each column to its bounds; the bounds are one row of constants."""
    of = lambda side, c: F.max(F.when(F.col("feature") == c, F.col(side)))
    row = bounds.agg(*[of(side, c).alias(f"_{side}_{c}") for c in cols for side in ("lo", "hi")])
    clipped = {c: X.clip(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols}
    return beside(df, row).withColumns(clipped).select(*df.columns)


def r_squared(y: str, pred: str) -> Column:
    """R2 as an aggregate, against the scored rows' own mean."""
    e = F.col(y) - F.col(pred)
    return 1 - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(y))


def baseline_r2(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """R2 on the test rows of always predicting the training mean."""
    mean = train.agg(F.avg(y)).scalar()
    return test.withColumn("_mean", mean).agg(r_squared(y, "_mean").alias("baseline_r2"))


def proportion_z(n_correct: Column, n: Column, p0: Column) -> Column:
    """One-sample z with the variance of the sample rate."""
    p = n_correct / n
    return F.try_divide(p - p0, F.sqrt(p * (1 - p) / n))


def mcnemar(rows: DataFrame, a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """2x2 table and statistic of two classifiers on the same rows."""
    a, b = F.col(a), F.col(b)
    t = rows.agg(F.count_if(a & b).alias("both_correct"), F.count_if(a & ~b).alias("a_only"),
                 F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("both_wrong"))
    n = F.col("a_only") + F.col("b_only")
    gap = F.abs(F.col("a_only") - F.col("b_only")) - 1
    stat = F.when(n < 25, F.least("a_only", "b_only").cast("double")).otherwise(
        F.try_divide((gap * gap).cast("double"), n.cast("double")))
    return t.withColumn("statistic", stat)


def mcnemar_test(rows: DataFrame, a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    t = mcnemar(rows, a, b)
    return t.withColumn("p_value", mcnemar_p(F.col("a_only").cast("double"), F.col("b_only").cast("double")))


def classification(preds: DataFrame, y: str, pred: str, keys: list[str] = ()) -> DataFrame:
    """Accuracy, majority baseline, verdicts, precision, recall and F1."""
    yy, pp = F.col(y), F.col(pred)
    counts = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((yy == 1) & (pp == 1)).alias("tp"),
        F.count_if((yy == 0) & (pp == 1)).alias("fp"), F.count_if((yy == 1) & (pp == 0)).alias("fn"),
        F.count_if(yy == pp).alias("hits"), F.avg(yy.cast("double")).alias("up"))
    zero = F.lit(0.0)
    out = counts.withColumns({
        "accuracy": F.col("hits") / F.col("n"),
        "baseline": F.greatest(F.col("up"), 1 - F.col("up")),
        "precision": F.coalesce(X.ratio("tp", F.col("tp") + F.col("fp")), zero),
        "recall": F.coalesce(X.ratio("tp", F.col("tp") + F.col("fn")), zero)})
    f1 = F.coalesce(X.ratio(2 * F.col("precision") * F.col("recall"),
                            F.col("precision") + F.col("recall")), zero)
    edge = F.col("accuracy") - F.col("baseline")
    return out.withColumns({
        "f1": f1, "beats_baseline": edge > 0.02,
        "beats_majority": F.when(edge > 0.02, "YES").when(edge < -0.02, "no").otherwise("~tie"),
    }).drop("tp", "fp", "fn", "hits", "up")


def auc(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks of the scores."""
    rows = scored.select(F.col(y).alias("_y"), F.col(score).alias("_s"))
    counted = rows.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("pos"),
                                     F.count_if(F.col("_y") == 0).alias("neg"))
    ranks = ranking.average_ranks(rows, [], "_s", "rank")
    total = counted.join(ranks, "_s").agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"),
        F.sum(F.col("pos") * F.col("rank")).alias("rs"))
    p = F.col("p")
    return total.select(F.try_divide(F.col("rs") - p * (p + 1) / 2, p * F.col("q")).alias("auc"))


def skill(scored: DataFrame, y: str, model: str, persist: str, keys: list[str] = ()) -> DataFrame:
    """Model against persistence on the same rows: R2 of both, skill, and the
    median absolute error in annualised percent, for each of the `keys`."""
    em, ep = F.col(y) - F.col(model), F.col(y) - F.col(persist)
    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r_squared(y, model).alias("test_r2"),
        r_squared(y, persist).alias("persist_r2"),
        (1 - F.try_divide(F.avg(em * em), F.avg(ep * ep))).alias("skill"))
    err = lambda c: X.annual_pct(F.abs(F.exp(y) - F.exp(c)))
    cells = F.array(F.struct(F.lit("m").alias("k"), err(model).alias("e")),
                    F.struct(F.lit("p").alias("k"), err(persist).alias("e")))
    med = ranking.quantiles(scored.select(*keys, F.inline(cells)), [*keys, "k"], "e", {"median": 0.5})
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("median")))
    med = med.groupBy(*keys).agg(pick("m").alias("mae_model_annpct"), pick("p").alias("mae_persist_annpct"))
    return base.join(med, list(keys)) if keys else beside(base, med)


def autocorrelations(df: DataFrame, col: str, lags: list[int], label: str) -> DataFrame:
    """corr(x, lag k of x) per asset, then mean, least and largest over assets."""
    w = Window.partitionBy("asset_id").orderBy("d")
    lagged = df.withColumns({f"_l{k}": F.lag(col, k).over(w) for k in lags})
    per = lagged.groupBy("asset_id").agg(*[X.corr(col, f"_l{k}").alias(f"r{k}") for k in lags])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])
    return (per.select(F.inline(cells)).groupBy("lag")
            .agg(F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"))
            .withColumn("series", F.lit(label)))


def design_effect(panel: DataFrame, value: str, n_rows: Column) -> DataFrame:
    """Mean same-day correlation across assets, design effect and effective n.

    Values are standardised per asset; the mean product over all same-day pairs
    follows from each day's sum and sum of squares, (S^2 - Q) / (k (k - 1)), so
    no pair is ever formed.
    """
    w = Window.partitionBy("asset_id")
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    rows = panel.select("asset_id", "d", z.alias("z")).filter(F.col("z").isNotNull())
    days = rows.groupBy("d").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"),
                                 F.count(F.lit(1)).alias("k"))
    mean = days.agg(F.try_divide(F.sum(F.col("s") * F.col("s") - F.col("q")),
                                 F.sum(F.col("k") * (F.col("k") - 1)).cast("double")).alias("mean_r"))
    out = mean.withColumns({"n_assets": rows.agg(F.count_distinct("asset_id")).scalar(), "n": n_rows})
    deff = 1 + (F.col("n_assets") - 1) * F.col("mean_r")
    return out.withColumn("design_effect", deff).withColumn("n_eff", F.try_divide(F.col("n"), deff))


def return_profile(prices: DataFrame) -> DataFrame:
    """Count, moments and quartiles of the pooled returns."""
    prices = cut_lineage(prices.select("return_1d"), "returns")
    q = ranking.quantiles(prices, [], "return_1d", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    m = prices.agg(
        F.count("return_1d").alias("n"), F.avg("return_1d").alias("mean"),
        F.stddev_samp("return_1d").alias("std"), F.min("return_1d").alias("min"),
        F.max("return_1d").alias("max"), X.sample_skew("return_1d").alias("skew"),
        X.sample_kurtosis("return_1d").alias("kurtosis"))
    return beside(m, q)
