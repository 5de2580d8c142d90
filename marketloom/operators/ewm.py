"""Exponentially weighted means as a blocked scan over one window sort.

y_1 = x_1, y_t = (1-a) y_{t-1} + a x_t. Rows of a series are cut into blocks.
Inside a block the recurrence is a running sum of a x_i q^-i scaled by q^j
(q = 1-a); the block is so short that q^-i stays in the range of doubles. The
value a block starts from is a fold over the last values of the blocks before
it, so a row carries one number per earlier block, not the whole history. All
windows share the series' own partitioning and order: one shuffle for any number
of means. A series holds one row per key and day, so it is bounded by the calendar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 256
#: Decades that q^-i may span inside a block.
DECADES = 250


@dataclass(frozen=True)
class Ewm:
    """One mean: `source` smoothed with `alpha` into `out`, seeded at 1-based
    row `first` of the series, NULL before `min_rows` values were seen."""
    source: str
    out: str
    alpha: float
    min_rows: int
    first: int = 1


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def block_rows(alpha: float, longest: int = BLOCK) -> int:
    """Rows of a block: `longest`, or fewer where q^-rows would leave the range."""
    return max(1, min(longest, int(DECADES / -math.log10(1.0 - alpha))))


def add_ewm(df: DataFrame, specs: list[Ewm], key: str = "asset_id", order: str = "d",
            block: int = BLOCK) -> DataFrame:
    """Add every mean in `specs`, with 0 < alpha <= 1. Source columns must be
    non-null from their `first` row on (callers filter null closes before)."""
    series = Window.partitionBy(key).orderBy(order)
    keep = df.columns
    df = df.withColumn("_row", F.row_number().over(series))
    local, final = {}, {}
    for spec in specs:
        if not 0 < spec.alpha <= 1:
            raise ValueError("alpha must lie above 0 and at most at 1")
        q = 1.0 - spec.alpha
        i = F.col("_row") - spec.first
        if q == 0:  # nothing of the past remains
            final[spec.out] = F.when(i >= spec.min_rows - 1, F.col(spec.source))
            continue
        rows = block_rows(spec.alpha, block)
        j = F.pmod(i, F.lit(rows)).cast("double")
        seen = F.when(i >= 0, F.col(spec.source))
        u = F.when(i == 0, seen).otherwise(seen * spec.alpha)
        in_block = Window.partitionBy(key, F.floor(i / rows)).orderBy(order)
        part = F.sum(u * F.pow(F.lit(q), -j)).over(in_block) * F.pow(F.lit(q), j)
        local[f"_l_{spec.out}"] = part
        final[spec.out] = _combine(spec, q, i, j, series, rows)
    df = df.withColumns(local)
    return df.withColumns(final).select(*keep, *[s.out for s in specs])


def _combine(spec: Ewm, q: float, i: Column, j: Column, series, block: int) -> Column:
    part = F.col(f"_l_{spec.out}")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.collect_list(F.when((i >= 0) & (j == block - 1), part)).over(before)
    carry = F.aggregate(ends, F.lit(0.0), lambda acc, e: acc * (q ** block) + e)
    value = part + carry * F.pow(F.lit(q), j + 1)
    return F.when(i >= spec.min_rows - 1, value)
