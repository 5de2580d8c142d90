"""Chronological splits and walk-forward folds. Only the distinct dates (one
row per calendar day) pass through a single window; rows are labelled by joins
on the date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def date_index(panel: DataFrame, day: str = "d") -> DataFrame:
    """(day, i, n): 0-based position of each distinct date and their number."""
    days = panel.select(day).distinct()
    order = Window.orderBy(day)
    return days.select(day, (F.row_number().over(order) - 1).alias("i"),
                       F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def cutoff(panel: DataFrame, test_fraction: float = 0.25, day: str = "d") -> Column:
    """dates[int(n * (1 - f))] as a scalar."""
    idx = date_index(panel, day)
    return (idx.filter(F.col("i") == F.floor(F.col("n") * (1 - test_fraction)).cast("int"))
            .agg(F.min(day)).scalar())


def split(panel: DataFrame, test_fraction: float = 0.25, day: str = "d") -> DataFrame:
    """Adds `is_test`: train is strictly before the cutoff date."""
    return panel.withColumn("is_test", F.col(day) >= cutoff(panel, test_fraction, day))


def folds(panel: DataFrame, n_folds: int = 5, min_test: int = 10, day: str = "d",
          fixed: bool = False) -> DataFrame:
    """(fold, train_end, test_start, test_end) of expanding-window folds.

    The number of folds shrinks to what the dates support, and the last fold
    runs to the end. With `fixed` neither happens: always `n_folds` equal
    segments, as the volatility evaluation uses.
    """
    idx = date_index(panel, day)
    n = F.col("n")
    usable = F.greatest(F.lit(1), F.floor(n / min_test).cast("int") - 1)
    k = F.lit(n_folds) if fixed else F.least(F.lit(n_folds), usable)
    head = idx.filter("i = 0").select("n", k.cast("int").alias("k")).withColumn(
        "seg", F.floor(n / (F.col("k") + 1)).cast("int"))
    each = head.filter("seg >= 1").select("n", "k", "seg", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("fold"))
    stop = F.least((F.col("fold") + 1) * F.col("seg"), n)
    if not fixed:
        stop = F.when(F.col("fold") < F.col("k"), stop).otherwise(n)
    plan = each.select("fold", (F.col("fold") * F.col("seg")).alias("a"), stop.cast("int").alias("b"))
    at = lambda pos, name: idx.select(F.col("i").alias(pos), F.col(day).alias(name))
    plan = plan.withColumns({"ia": F.col("a") - 1, "ib": F.col("b") - 1})
    return (plan.join(at("ia", "train_end"), "ia").join(at("a", "test_start"), "a")
            .join(at("ib", "test_end"), "ib").select("fold", "train_end", "test_start", "test_end"))


def fold_rows(panel: DataFrame, plan: DataFrame, day: str = "d") -> DataFrame:
    """Row counts per fold and role. The few folds are joined to the distinct
    dates, counted per date, rather than to the rows."""
    per_day = panel.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
    role = (F.when(F.col(day) <= F.col("train_end"), "train")
            .when(F.col(day).between(F.col("test_start"), F.col("test_end")), "test"))
    return (per_day.join(plan, F.col(day) <= F.col("test_end"))
            .withColumn("role", role).filter(F.col("role").isNotNull())
            .groupBy("fold", "train_end", "test_start", "test_end").agg(
                F.coalesce(F.sum(F.when(F.col("role") == "train", F.col("rows"))), F.lit(0)).alias("n_train"),
                F.coalesce(F.sum(F.when(F.col("role") == "test", F.col("rows"))), F.lit(0)).alias("n_test"),
                F.count_if(F.col("role") == "test").alias("n_test_days")))


def fold_summary(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Number of folds, mean, least and largest metric, folds beating baseline;
    no row when there are no folds."""
    return results.agg(
        F.count(F.lit(1)).alias("n_folds"), F.round(F.avg(metric), 3).alias(f"{metric}_mean"),
        F.round(F.min(metric), 3).alias(f"{metric}_min"), F.round(F.max(metric), 3).alias(f"{metric}_max"),
        F.count_if(F.col("beats_baseline")).alias("folds_beating_baseline")).filter("n_folds > 0")


def equity_curve(preds: DataFrame, key: str, ret: str, pred: str, day: str = "d") -> DataFrame:
    """Compounded growth of following the signal (long only) and of holding."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    hold = F.coalesce(F.col(ret), F.lit(0.0))
    follow = F.when(F.col(pred) == 1, hold).otherwise(0.0)
    return preds.withColumns({"strategy": F.product(1 + follow).over(w) + 0.0,
                              "buy_hold": F.product(1 + hold).over(w) + 0.0})


def non_overlapping(preds: DataFrame, key: str, horizon: int, day: str = "d") -> DataFrame:
    """Every horizon-th row per key, for a curve without overlapping returns."""
    w = Window.partitionBy(key).orderBy(day)
    return (preds.withColumn("_i", F.row_number().over(w) - 1)
            .filter(F.col("_i") % horizon == 0).drop("_i"))
