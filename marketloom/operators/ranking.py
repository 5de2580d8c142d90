"""Exact distributed quantiles and ranks.

`percentile` and un-partitioned windows hold a whole column in one task. Here
values are first counted (map-side combine, so a value that fills a third of
the column is one row), the counted values are range-partitioned and written
once, and running counts come from per-partition totals. Only the totals, one
row per partition and key, pass through a single window.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window, functions as F

from marketloom.session import cut_lineage


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, below): per key, how often each value occurs and how
    many rows hold a smaller one. `weight` counts rows that stand for several."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    placed = (counted.repartitionByRange(*[F.col(c) for c in [*keys, value]])
              .withColumn("_part", F.spark_partition_id()))
    placed = cut_lineage(placed, "value-ranks")
    totals = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_part",
                         F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = (Window.partitionBy(*keys, "_part").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.withColumn("_upto", F.sum("n").over(within))
            .join(base, [*keys, "_part"])
            .select(*keys, value, "n", (F.col("_base") + F.col("_upto") - F.col("n")).alias("below")))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with the linearly interpolated quantiles named in `probs`."""
    ranks = value_ranks(df, keys, value)
    total = ranks.groupBy(*keys).agg(F.sum("n").alias("_n"))
    rows = ranks.join(total, keys) if keys else ranks.withColumn("_n", total.scalar())
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo = F.floor(at)
        hi = F.least(lo + 1, F.col("_n") - 1)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        low, high = F.max(F.when(holds(lo), F.col(value))), F.max(F.when(holds(hi), F.col(value)))
        share = F.max(at - lo)
        out.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str,
                  weight: str | None = None) -> DataFrame:
    """(keys, value, out): the 1-based rank of each value, ties averaged."""
    return value_ranks(df, keys, value, weight).select(
        *keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin of the values clipped to [lo, hi]."""
    x = F.least(F.greatest(F.col(value), F.lit(lo)), F.lit(hi))
    b = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def range_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the column's own range."""
    lo, hi = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    at = F.try_divide((F.col(value) - lo) * bins, hi - lo)
    b = F.coalesce(F.least(F.floor(at), F.lit(bins - 1)), F.lit(0)).cast("int")
    return (df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def sample_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A repeatable sample: the n rows with the smallest MD5 of their key."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys)), *keys).limit(n)


