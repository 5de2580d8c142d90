"""Model evaluations: direction, sentiment, fundamentals, volatility, hypotheses.

Every fit reads its panel several times, so the complete rows are written to the
shared folder once. What reaches the driver are fold boundaries, fitted models
and single-row metrics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from marketloom.functions import params as P
from marketloom.functions.numeric import annual_pct, forecast_band, ratio
from marketloom.functions.tails import mcnemar_p, r_p, z_p
from marketloom.operators import learning as L
from marketloom.operators import news, ranking, stats, validation
from marketloom.operators.learning import in_parallel
from marketloom.operators.rows import beside
from marketloom.plans.panels import usable
from marketloom.session import cut_lineage

KEYS = ["ticker", "asset_id", "d"]


def latest_rows(panel: DataFrame, features: list[str]) -> DataFrame:
    """Each ticker's newest row with every feature present; it has one row a day."""
    rows = usable(panel, features)
    rest = [c for c in rows.columns if c not in ("ticker", "d")]
    return rows.groupBy("ticker").agg(F.max("d").alias("d"), *[F.max_by(c, "d").alias(c) for c in rest])


def signals(model: L.Model, panel: DataFrame, features: list[str]) -> DataFrame:
    """Latest signal per ticker with its confidence."""
    scored = L.predict_direction(model, latest_rows(panel, features))
    return scored.select("ticker", "asset_id", F.col("d").alias("latest_date"),
                         F.when(F.col("pred") == 1, "UP").otherwise("DOWN").alias("latest_signal"),
                         F.round("confidence", 3).alias("latest_confidence"))


def walk_forward_direction(rows: DataFrame, features: list[str], target: str, n_folds: int = 5,
                           min_test: int = 10, kind: str = "boosted", rounds: int = 200) -> DataFrame:
    """Accuracy against the majority baseline per expanding fold; folds that are
    too thin or whose training rows have one class are left out."""
    plan = validation.folds(rows, n_folds, min_test)
    bounds = plan.orderBy("fold").collect()
    trains = [rows.filter(F.col("d") <= F.lit(b.train_end)) for b in bounds]
    tests = [rows.filter(F.col("d").between(F.lit(b.test_start), F.lit(b.test_end))) for b in bounds]
    y, facts = F.col(target), {}
    if bounds:
        seen = lambda b: F.col("d") <= F.lit(b.train_end)
        counts = rows.agg(*[c for b in bounds for c in (
            F.count_if(seen(b) & (y == 1)), F.count_if(seen(b) & (y == 0)),
            F.count_if(F.col("d").between(F.lit(b.test_start), F.lit(b.test_end))))]).first()
        facts = {i: tuple(counts[3 * i:3 * i + 3]) for i in range(len(bounds))}
    taken = [i for i, (up, down, n) in facts.items() if up and down and n >= min_test]
    if kind == "logistic":
        models = in_parallel([lambda i=i: L.fit_direction(trains[i], features, target, kind, rounds) for i in taken])
    else:
        models = L.fit_boosted(L.direction_plan(rounds), [(trains[i], features, target) for i in taken])
    parts = [L.predict_direction(m, tests[i]).select(F.lit(bounds[i].fold).alias("fold"), "d", target, "pred")
             for i, m in zip(taken, models)]
    if not parts:
        return plan.select("fold", "test_start", "test_end").limit(0).withColumns(
            {"n": F.lit(0), "n_test_days": F.lit(0), "accuracy": F.lit(0.0), "baseline": F.lit(0.0),
             "beats_baseline": F.lit(False)})
    preds = reduce(DataFrame.unionByName, parts)
    days = preds.groupBy("fold").agg(F.count_distinct("d").alias("n_test_days"))
    per = stats.classification(preds, target, "pred", ["fold"]).select(
        "fold", "n", F.round("accuracy", 3).alias("accuracy"), F.round("baseline", 3).alias("baseline"), "beats_baseline")
    return plan.select("fold", "test_start", "test_end").join(per, "fold").join(days, "fold")


@dataclass(frozen=True)
class DirectionReport:
    """Everything one direction model reports."""
    metrics: DataFrame
    curve: DataFrame
    latest: DataFrame
    explanation: DataFrame
    model: L.Model


def direction_report(panel: DataFrame, features: list[str] = P.TECHNICAL_FEATURES, horizon: int = 5,
                     min_rows: int = 120, kind: str = "boosted", rounds: int = 200,
                     explain: bool = True) -> DirectionReport | None:
    """Fit on the first 75% of dates, backtest on the rest, signal today.

    The panel decides the scope: one ticker's rows for a per-ticker model, all
    for a pooled one. None when there is too little to evaluate honestly.
    """
    target, ret = f"target_dir_{horizon}d", f"target_ret_{horizon}d"
    rows = cut_lineage(usable(panel, features + [target]).select(*KEYS, *features, target, ret), "direction-rows")
    if rows.count() < min_rows:
        return None
    rows = cut_lineage(validation.split(rows), "direction-split")
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    if test.isEmpty() or train.select(target).distinct().count() < 2:
        return None
    model = L.fit_direction(train, features, target, kind, rounds)
    preds = cut_lineage(L.predict_direction(model, test), "direction-preds")
    counts = rows.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
                      F.count_distinct(F.when(~F.col("is_test"), F.col("d"))).alias("n_train_days"),
                      F.count_distinct(F.when(F.col("is_test"), F.col("d"))).alias("n_test_days"))
    score = stats.classification(preds, target, "pred").drop("n")
    metrics = beside(counts, score)
    curve = validation.equity_curve(preds, "ticker", ret, "pred").select("ticker", "d", "strategy", "buy_hold")
    last = latest_rows(panel, features)
    explanation = (explain_rows(model, last, features, ["ticker"]) if explain else None)
    return DirectionReport(metrics, curve, signals(model, panel, features), explanation, model)


def predict_panel(panel: DataFrame, ticker: str, features: list[str] = P.TECHNICAL_FEATURES, horizon: int = 5,
                  min_rows: int = 120, kind: str = "boosted", rounds: int = 200) -> DataFrame | None:
    """One ticker's own direction model as one row: hold-out metrics, the growth
    of following it and of holding, the fold summary and today's signal. None
    when the ticker has too little to evaluate honestly."""
    target = f"target_dir_{horizon}d"
    own = panel.filter(F.col("ticker") == ticker)
    report = direction_report(own, features, horizon, min_rows, kind, rounds, explain=False)
    if report is None:
        return None
    rows = cut_lineage(usable(own, features + [target]).select(*KEYS, *features, target), "predict-rows")
    folds = validation.fold_summary(walk_forward_direction(rows, features, target, kind=kind, rounds=rounds))
    growth = report.curve.agg(*[(F.max_by(c, "d") - 1).alias(f"final_return_{c}") for c in ("strategy", "buy_hold")])
    out = beside(beside(report.metrics, growth), report.latest.select("ticker", "latest_date", "latest_signal", "latest_confidence"))
    named = folds.withColumnRenamed("accuracy_mean", "fold_accuracy_mean").drop("accuracy_min", "accuracy_max")
    return beside(out, named).withColumn("horizon", F.lit(horizon))


def predict_tickers(panel: DataFrame, features: list[str] = P.TECHNICAL_FEATURES, horizon: int = 5, min_rows: int = 120,
                    rounds: int = 200, n_folds: int = 5, min_test: int = 10, test_fraction: float = 0.25) -> DataFrame:
    """`predict_panel` for every ticker with enough rows: each ticker's own
    hold-out model, fold models and signal of today.

    The dates of a ticker are numbered in a window over its own rows, which the
    calendar bounds; every (ticker, fit) is then boosted where its rows lie and
    the reports are aggregates over all predictions."""
    target, ret = f"target_dir_{horizon}d", f"target_ret_{horizon}d"
    rows = usable(panel, features + [target]).select("ticker", "d", *features, target, ret)
    own = Window.partitionBy("ticker")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(own), "i": F.row_number().over(own.orderBy("d")) - 1}).filter(F.col("n") >= min_rows)
    k = F.least(F.lit(n_folds), F.greatest(F.lit(1), F.floor(F.col("n") / min_test).cast("int") - 1))
    rows = cut_lineage(rows.withColumn("k", k).withColumn("seg", F.floor(F.col("n") / (F.col("k") + 1)).cast("int")), "ticker-rows")

    # fit 0 is the hold-out, fit 1.. the folds; a row trains, tests or stands aside
    cut, start = F.floor(F.col("n") * (1 - test_fraction)).cast("int"), F.col("fit") * F.col("seg")
    stop = F.when(F.col("fit") < F.col("k"), start + F.col("seg")).otherwise(F.col("n"))
    each = rows.withColumn("fit", F.explode(F.sequence(F.lit(0), F.col("k"))))
    each = each.withColumn("is_test", F.when(F.col("fit") == 0, F.col("i") >= cut).when(F.col("i") < start, False)
                           .when(F.col("i") < stop, True)).filter(F.col("is_test").isNotNull())
    last = latest_rows(panel, features).join(rows.select("ticker").distinct(), "ticker", "left_semi")
    cast = [F.col(target).cast("double").alias("label"), F.col(ret).cast("double").alias("ret"), L.feature_array(features).alias("x")]
    fits = each.select("ticker", "fit", "d", "is_test", F.lit(False).alias("is_last"), *cast).unionByName(
        last.select("ticker", F.lit(0).alias("fit"), "d", F.lit(True).alias("is_test"), F.lit(True).alias("is_last"), *cast))
    scored = L.boosting.fit_predict_groups(L.direction_plan(rounds), cut_lineage(fits, "ticker-fits"), ["ticker", "fit"], ["d", "is_last", "label", "ret"])
    p = 1 / (1 + F.exp(-F.col("margin")))
    scored = cut_lineage(scored.withColumns({"proba_up": p, "pred": (p >= 0.5).cast("int"), "label": F.nanvl("label", F.lit(None)),
                                             "ret": F.nanvl("ret", F.lit(None))}), "ticker-preds")

    held = scored.filter((F.col("fit") == 0) & ~F.col("is_last"))
    metrics = stats.classification(held, "label", "pred", ["ticker"]).withColumnRenamed("n", "n_test")
    sizes = rows.groupBy("ticker").agg(F.count_if(F.col("i") < cut).alias("n_train"), F.count_distinct(F.when(F.col("i") < cut, F.col("d"))).alias("n_train_days"),
                                       F.count_distinct(F.when(F.col("i") >= cut, F.col("d"))).alias("n_test_days"))
    curve = validation.equity_curve(held, "ticker", "ret", "pred")
    growth = curve.groupBy("ticker").agg(*[(F.max_by(c, "d") - 1).alias(f"final_return_{c}") for c in ("strategy", "buy_hold")])
    signal = scored.filter("is_last").select(
        "ticker", F.col("d").alias("latest_date"), F.when(F.col("pred") == 1, "UP").otherwise("DOWN").alias("latest_signal"),
        F.round(F.greatest("proba_up", 1 - F.col("proba_up")), 3).alias("latest_confidence"))
    folds = stats.classification(scored.filter("fit > 0"), "label", "pred", ["ticker", "fit"]).filter(F.col("n") >= min_test)
    summary = folds.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg(F.round("accuracy", 3)), 3).alias("fold_accuracy_mean"),
                                          F.count_if("beats_baseline").alias("folds_beating_baseline"))
    out = reduce(lambda a, b: a.join(b, "ticker"), [sizes, metrics, growth, signal])
    out = out.join(summary, "ticker", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_folds", "folds_beating_baseline")})
    return out.withColumn("horizon", F.lit(horizon))


def explain_rows(model: L.Model, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Exact contribution per feature, largest first by absolute size inside a row."""
    exact = L.tree_attribution if isinstance(model, L.Boosted) else L.linear_attribution
    a = exact(model, rows, features, keys)
    return a.orderBy(*keys, F.abs("contribution").desc(), "feature")


def direction_grid(panels: dict[str, tuple[DataFrame, list[str]]], horizons: list[int] = P.DIRECTION_HORIZONS,
                   kinds: tuple[str, ...] = ("logistic", "boosted"), rounds: int = 200,
                   min_rows: int = 60) -> DataFrame:
    """{model} x {horizon} x {feature set}: accuracy, precision, recall, F1, AUC
    and the verdict against the majority baseline."""
    saved = {n: (cut_lineage(df.select(*KEYS, *fs, *[f"target_dir_{h}d" for h in horizons]), "grid-panel"), fs)
             for n, (df, fs) in panels.items()}

    def cell(name, h):
        rows, features = saved[name]
        target = f"target_dir_{h}d"
        clean = usable(rows, features + [target])
        if clean.limit(min_rows).count() < min_rows:
            return None
        clean = cut_lineage(validation.split(clean), "grid-split")
        train, test = clean.filter(~F.col("is_test")), clean.filter("is_test")
        if test.isEmpty() or train.select(target).distinct().count() < 2:
            return None
        return name, h, target, train, test, features

    def report(kind, model, name, h, target, test):
        preds = cut_lineage(L.predict_direction(model, test).select(target, "pred", "proba_up"), "grid-preds")
        area = stats.auc(preds, target, "proba_up").scalar()
        return stats.classification(preds, target, "pred").select(
            F.lit(name).alias("features"), F.lit(kind).alias("model"), F.lit(h).alias("horizon"), "n", "accuracy",
            "baseline", "precision", "recall", "f1", "beats_majority", area.alias("auc"))

    cells = [c for c in in_parallel([lambda n=n, h=h: cell(n, h) for n in saved for h in horizons]) if c is not None]
    tasks = []
    for kind in kinds:
        if kind == "logistic":
            models = in_parallel([lambda c=c: L.fit_direction(c[3], c[5], c[2], "logistic") for c in cells])
        else:
            models = L.fit_boosted(L.direction_plan(rounds), [(c[3], c[5], c[2]) for c in cells])
        tasks += [lambda k=kind, m=m, c=c: report(k, m, c[0], c[1], c[2], c[4]) for m, c in zip(models, cells)]
    return reduce(DataFrame.unionByName, in_parallel(tasks))


def case_studies(panel: DataFrame, headlines: DataFrame, horizon: int = 5, top: int = 3,
                 min_confidence: float = 0.65, min_rows: int = 60, kind: str = "boosted",
                 rounds: int = 200) -> DataFrame | None:
    """Correct, confident test predictions that owe most to sentiment, each with
    the first headline of its ticker and day."""
    features = P.TECHNICAL_FEATURES + P.SENTIMENT_FEATURES
    target, ret = f"target_dir_{horizon}d", f"target_ret_{horizon}d"
    rows = cut_lineage(validation.split(usable(panel, features + [target, ret])
                                        .select(*KEYS, *features, target, ret)), "case-rows")
    if rows.limit(min_rows).count() < min_rows:
        return None
    train = rows.filter(~F.col("is_test"))
    model = L.fit_direction(train, features, target, kind, rounds)
    preds = L.predict_direction(model, rows.filter("is_test"))
    sure = cut_lineage(preds.filter((F.col("pred") == F.col(target)) & (F.col("confidence") >= min_confidence)), "case-sure")
    a = explain_rows(model, sure, features, KEYS)
    share = L.sentiment_share(a, KEYS, P.SENTIMENT_FEATURES)
    best = sure.join(share, KEYS).orderBy(F.desc("sentiment_share"), "ticker", "d").limit(top)
    first = news.first_headline(headlines)
    return best.join(first, ["ticker", "d"], "left").select(
        "ticker", "d", F.when(F.col("pred") == 1, "UP").otherwise("DOWN").alias("signal"),
        F.round("confidence", 3).alias("confidence"), F.round(F.col(ret) * 100, 2).alias("realized_return_pct"),
        F.round("sentiment_index", 3).alias("sentiment_index"),
        F.round("sentiment_share", 3).alias("sentiment_share"), "sample_headline")


def global_attribution(panel: DataFrame, horizon: int = 21, sample: int = 3000, rounds: int = 200,
                       kind: str = "boosted", features: list[str] = P.TECHNICAL_FEATURES) -> DataFrame:
    """Mean absolute contribution per feature over a repeatable sample of test
    rows, with the spread of the predicted probabilities next to it."""
    target = f"target_dir_{horizon}d"
    rows = cut_lineage(validation.split(usable(panel, features + [target]).select(*KEYS, *features, target)), "global-rows")
    train = rows.filter(~F.col("is_test"))
    model = L.fit_direction(train, features, target, kind, rounds)
    picked = cut_lineage(ranking.sample_rows(rows.filter("is_test"), ["ticker", "d"], sample), "global-sample")
    p = L.predict_direction(model, picked)
    spread = p.agg(F.min("proba_up").alias("proba_min"), F.max("proba_up").alias("proba_max"),
                   F.stddev_samp("proba_up").alias("proba_std"),
                   F.avg(((F.col("proba_up") > 0.45) & (F.col("proba_up") < 0.55)).cast("int")).alias("share_undecided"))
    a = explain_rows(model, picked, features, KEYS)
    mean = a.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return beside(mean, spread).orderBy(F.desc("mean_abs"))


def ols_report(panel: DataFrame, horizon: int, features: list[str] = P.FUNDAMENTAL_FEATURES,
               day: str = "anchor_date", min_n: int = 15) -> DataFrame | None:
    """Winsorised multi-feature OLS with a chronological hold-out: R2 on train
    and test, the train-mean baseline and the coefficients."""
    y = f"fwd_ret_{horizon}d"
    rows = cut_lineage(validation.split(usable(panel, features + [y]).select(day, *features, y), day=day), "ols-rows")
    return _ols(rows.filter(~F.col("is_test")), rows.filter("is_test"), features, y, min_n, min_n)


def _ols(train: DataFrame, test: DataFrame, features: list[str], y: str, min_train: int, min_test: int) -> DataFrame | None:
    n_train, n_test = train.count(), test.count()
    if n_train < min_train or n_test < min_test:
        return None
    bounds = cut_lineage(stats.winsor_bounds(train, features), "winsor")
    wtrain, wtest = stats.winsorise(train, bounds, features), stats.winsorise(test, bounds, features)
    model = L.fit_ols(wtrain, features, y)
    r2 = lambda rows: L.predict_value(model, rows).agg(stats.r_squared(y, "pred"))
    base = stats.baseline_r2(train, test, y)
    out = r2(wtest).toDF("test_r2").withColumns({
        "train_r2": r2(wtrain).scalar(), "baseline_r2": base.scalar(),
        "n_train": F.lit(n_train), "n_test": F.lit(n_test)})
    coefs = model.stages[-1].coefficients.toArray().tolist()
    return out.withColumn("beats_baseline", F.col("test_r2") > F.col("baseline_r2")).withColumns(
        {f"coef_{f}": F.lit(float(c)) for f, c in zip(features, coefs)})


def ols_walk_forward(panel: DataFrame, horizon: int, features: list[str] = P.FUNDAMENTAL_FEATURES,
                     day: str = "anchor_date", n_folds: int = 5, min_train: int = 15,
                     min_test: int = 20) -> DataFrame | None:
    """The OLS per expanding fold, each against its own train-mean baseline."""
    y = f"fwd_ret_{horizon}d"
    rows = cut_lineage(usable(panel, features + [y]).select(day, *features, y), "ols-folds")
    bounds = validation.folds(rows, n_folds, min_test, day).orderBy("fold").collect()

    def one(b):
        train = rows.filter(F.col(day) <= F.lit(b.train_end))
        test = rows.filter(F.col(day).between(F.lit(b.test_start), F.lit(b.test_end)))
        out = _ols(train, test, features, y, min_train, min_test)
        return None if out is None else out.select(
            F.lit(b.fold).alias("fold"), F.lit(b.test_start).alias("test_start"), F.lit(b.test_end).alias("test_end"),
            "n_test", "test_r2", "baseline_r2", "beats_baseline")

    parts = [p for p in in_parallel([lambda b=b: one(b) for b in bounds]) if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def factor_table(panel: DataFrame, horizons: list[int] = P.FUNDAMENTAL_HORIZONS) -> DataFrame:
    """Spearman and Pearson with p-values and stars per (feature, horizon)."""
    from marketloom.functions.numeric import stars
    t = stats.rank_correlations(stats.long_pairs(panel, P.FUNDAMENTAL_FEATURES, horizons))
    n = F.col("n").cast("double")
    t = t.withColumns({"p_spearman": r_p("spearman", n), "p_pearson": r_p("pearson", n)})
    return t.withColumns({"sig_spearman": stars("p_spearman"), "sig_pearson": stars("p_pearson")})


def volatility_rows(panel: DataFrame, horizon: int, features: list[str] = P.VOLATILITY_FEATURES) -> DataFrame:
    cols = features + [f"target_logvol_{horizon}d", f"persistence_{horizon}d"]
    return usable(panel, cols).select(*KEYS, *cols)


def volatility_outlook(panel: DataFrame, horizon: int, features: list[str] = P.VOLATILITY_FEATURES,
                       rounds: int = 300, min_rows: int = 500) -> tuple[DataFrame, DataFrame] | None:
    """`volatility_outlooks` of one horizon; None where it has too few rows."""
    return volatility_outlooks(panel, [horizon], features, rounds, min_rows).get(horizon)


def volatility_outlooks(panel: DataFrame, horizons: list[int] = P.VOLATILITY_HORIZONS, features: list[str] = P.VOLATILITY_FEATURES,
                        rounds: int = 300, min_rows: int = 500) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By horizon (evaluation, forecasts): the hold-out fit's skill against
    persistence, and the forecast per ticker of a second fit on all rows, with a
    band. The fits of all horizons are boosted together."""
    def prepared(h):
        rows = cut_lineage(validation.split(volatility_rows(panel, h, features)), "vol-rows")
        n = rows.agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).first()
        return (h, rows) if n.train >= min_rows and n.test >= min_rows else None

    ready = dict(p for p in in_parallel([lambda h=h: prepared(h) for h in horizons]) if p is not None)
    parts = [(rows, features, f"target_logvol_{h}d") for h, df in ready.items() for rows in (df.filter(~F.col("is_test")), df)]
    models = L.fit_boosted(L.volatility_plan(rounds), parts)
    last = latest_rows(panel, features)
    out = {}
    for (h, rows), held, live in zip(ready.items(), models[::2], models[1::2]):
        train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
        preds = cut_lineage(L.predict_value(held, test), "vol-preds")
        score = cut_lineage(stats.skill(preds, f"target_logvol_{h}d", "pred", f"persistence_{h}d"), "vol-score")
        evaluation = score.withColumns({
            "horizon": F.lit(h), "beats_persistence": F.col("skill") > 0,
            "n_train": train.agg(F.count(F.lit(1))).scalar(), "test_start": test.agg(F.min("d")).scalar(),
            "test_end": test.agg(F.max("d")).scalar()})
        latest = L.predict_value(live, last)
        error = score.select("mae_model_annpct").scalar()
        found = latest.withColumns({"current": annual_pct(F.exp("log_vol_20")), "forecast": annual_pct(F.exp("pred"))})
        lo, hi = forecast_band("forecast", error)
        out[h] = evaluation, found.select(
            "ticker", F.col("d").alias("as_of"), F.lit(h).alias("horizon"),
            F.round("current", 1).alias("current_annpct"), F.round("forecast", 1).alias("forecast_annpct"),
            F.round(F.when(F.col("current") > 0, ratio("forecast", "current")), 2).alias("ratio_to_current"),
            F.round(lo, 1).alias("band_low_annpct"), F.round(hi, 1).alias("band_high_annpct"))
    return out


def volatility_walk_forward(panel: DataFrame, horizon: int, features: list[str] = P.VOLATILITY_FEATURES,
                            rounds: int = 300, n_folds: int = 5, min_train: int = 500, min_test: int = 100) -> DataFrame | None:
    """Skill per fixed fold of one horizon."""
    found = volatility_walk_forwards(panel, [horizon], features, rounds, n_folds, min_train, min_test)
    return found and found.drop("horizon")


def volatility_walk_forwards(panel: DataFrame, horizons: list[int] = P.VOLATILITY_HORIZONS, features: list[str] = P.VOLATILITY_FEATURES,
                             rounds: int = 300, n_folds: int = 5, min_train: int = 500, min_test: int = 100) -> DataFrame | None:
    """Skill per horizon and fixed fold; folds with too few rows are left out.
    The fits of all folds and horizons are boosted together, and their test rows
    scored in one pass."""
    def prepared(h):
        rows = cut_lineage(volatility_rows(panel, h, features), "vol-folds")
        bounds = validation.folds(rows, n_folds, fixed=True).orderBy("fold").collect()
        inside = lambda b: F.col("d").between(F.lit(b.test_start), F.lit(b.test_end))
        if not bounds:
            return []
        n = rows.agg(*[c for b in bounds for c in (F.count_if(F.col("d") <= F.lit(b.train_end)), F.count_if(inside(b)))]).first()
        y = [F.col(f"target_logvol_{h}d").alias("y"), F.col(f"persistence_{h}d").alias("persistence")]
        return [(h, b, rows.filter(F.col("d") <= F.lit(b.train_end)), rows.filter(inside(b)).select(*features, *y))
                for i, b in enumerate(bounds) if n[2 * i] >= min_train and n[2 * i + 1] >= min_test]

    folds = [f for found in in_parallel([lambda h=h: prepared(h) for h in horizons]) for f in found]
    if not folds:
        return None
    models = L.fit_boosted(L.volatility_plan(rounds), [(train, features, f"target_logvol_{h}d") for h, _, train, _ in folds])
    tests = reduce(DataFrame.unionByName, [test.withColumns({
        "horizon": F.lit(h), "fold": F.lit(b.fold), "test_start": F.lit(b.test_start), "test_end": F.lit(b.test_end), "model": F.lit(i)})
        for i, (h, b, _, test) in enumerate(folds)])
    pred = L.boosting.margins({i: m.ensemble for i, m in enumerate(models)}, "model", L.feature_array(features))
    preds = cut_lineage(tests.withColumn("pred", pred), "vol-fold")
    return stats.skill(preds, "y", "pred", "persistence", ["horizon", "fold", "test_start", "test_end"])


# The published feature subsets.
ABLATIONS = {"all": P.VOLATILITY_FEATURES, "only_log_vol_20": ["log_vol_20"],
             "without_log_vol_20": [f for f in P.VOLATILITY_FEATURES if f != "log_vol_20"],
             "only_5_20_60": ["log_vol_5", "log_vol_20", "log_vol_60"]}


def volatility_ablation(panel: DataFrame, horizon: int = 21, rounds: int = 300) -> DataFrame:
    """Test R2 per feature subset on the same rows."""
    target, persist = f"target_logvol_{horizon}d", f"persistence_{horizon}d"
    rows = cut_lineage(validation.split(volatility_rows(panel, horizon)), "ablation")
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")

    models = L.fit_boosted(L.volatility_plan(rounds), [(train, features, target) for features in ABLATIONS.values()])

    def one(name, model):
        return L.predict_value(model, test).agg(
            stats.r_squared(target, "pred").alias("test_r2"),
            stats.r_squared(target, persist).alias("persist_r2")).withColumn("features", F.lit(name))

    return reduce(DataFrame.unionByName, [one(n, m) for n, m in zip(ABLATIONS, models)])


def hit_rate_hypothesis(panel: DataFrame, horizons: list[int] = P.DIRECTION_HORIZONS,
                        features: list[str] = P.TECHNICAL_FEATURES, alpha: float = 0.05) -> DataFrame:
    """H1: hit rate of the logistic model against the majority rate (z-test)."""
    saved = cut_lineage(panel.select(*KEYS, *features, *[f"target_dir_{h}d" for h in horizons]), "h1-panel")

    def one(h):
        target = f"target_dir_{h}d"
        rows = validation.split(usable(saved, features + [target]))
        model = L.fit_direction(rows.filter(~F.col("is_test")), features, target, "logistic")
        preds = L.predict_direction(model, rows.filter("is_test"))
        up = F.avg(F.col(target).cast("double"))
        a = preds.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("pred") == F.col(target)).alias("k"), up.alias("up"))
        return a.select(F.lit(h).alias("horizon"), "n_test", (F.col("k") / F.col("n_test")).alias("hit_rate"),
                        F.greatest(F.col("up"), 1 - F.col("up")).alias("baseline"), "k")

    t = reduce(DataFrame.unionByName, in_parallel([lambda h=h: one(h) for h in horizons]))
    t = t.withColumn("z_stat", stats.proportion_z(F.col("k"), F.col("n_test"), F.col("baseline"))).drop("k")
    t = t.withColumn("p_value", z_p("z_stat"))
    return t.withColumn("reject", F.col("p_value") < alpha)


def paired_hypothesis(panel: DataFrame, horizons: list[int] = P.DIRECTION_HORIZONS, alpha: float = 0.05) -> DataFrame:
    """H2: technical against technical + sentiment on the same rows (McNemar)."""
    tech, both = P.TECHNICAL_FEATURES, P.TECHNICAL_FEATURES + P.SENTIMENT_FEATURES
    saved = cut_lineage(panel.select(*KEYS, *both, *[f"target_dir_{h}d" for h in horizons]), "h2-panel")

    def one(h):
        target = f"target_dir_{h}d"
        rows = validation.split(usable(saved, both + [target]))
        train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
        a = L.predict_direction(L.fit_direction(train, tech, target, "logistic"), test)
        a = a.withColumn("correct_a", F.col("pred") == F.col(target)).drop("pred", "proba_up", "confidence")
        b = L.predict_direction(L.fit_direction(train, both, target, "logistic"), a)
        b = b.withColumn("correct_b", F.col("pred") == F.col(target))
        return stats.mcnemar(b).withColumn("horizon", F.lit(h))

    t = reduce(DataFrame.unionByName, in_parallel([lambda h=h: one(h) for h in horizons]))
    t = t.withColumn("p_value", mcnemar_p(F.col("a_only").cast("double"), F.col("b_only").cast("double")))
    return t.withColumn("reject", F.col("p_value") < alpha)


def fundamentals_hypothesis(panel: DataFrame, horizons: list[int] = P.FUNDAMENTAL_HORIZONS,
                            alpha: float = 0.05) -> DataFrame:
    """H3: Pearson r of each factor with each forward return, corrected over all tests."""
    t = factor_table(panel, horizons).select("feature", "horizon", "n", F.col("pearson").alias("r"),
                                             F.col("p_pearson").alias("p_raw"))
    t = stats.benjamini_hochberg(t, "p_raw", "p_fdr_adjusted")
    return t.withColumn("significant_after_correction", F.col("p_fdr_adjusted") < alpha)
