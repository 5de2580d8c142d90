"""Null-safe numeric expressions. Undefined results are NULL, never NaN or inf."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F
from pyspark.sql.window import WindowSpec

from marketloom.functions import params as P


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """NULL for NaN and +-inf."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def trailing(key: str, order: str, rows: int) -> WindowSpec:
    """The last `rows` rows per key, today included."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)


def leading(key: str, order: str, rows: int) -> WindowSpec:
    """The next `rows` rows per key, today excluded."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(1, rows)


def full(agg: Column, value: str | Column, window: WindowSpec, rows: int) -> Column:
    """`agg` over `window`, NULL until `rows` non-null values are in it."""
    return F.when(F.count(col(value)).over(window) == rows, agg.over(window))


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson r as an aggregate over complete pairs; NULL for a constant side."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_over(x: str | Column, y: str | Column, window: WindowSpec) -> Column:
    """Pearson r over a window whose rows are complete pairs."""
    x, y = col(x), col(y)
    return F.try_divide(F.covar_pop(x, y).over(window),
                        F.stddev_pop(x).over(window) * F.stddev_pop(y).over(window))


def pairs(x: str | Column, y: str | Column) -> Column:
    """Number of complete pairs."""
    return F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1))


def sample_skew(x: str | Column) -> Column:
    """Bias-corrected skewness (G1)."""
    n = F.count(col(x)).cast("double")
    return F.when(n >= 3, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis (G2)."""
    n = F.count(col(x)).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(col(x)) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def log_vol(v: str | Column, floor: float = P.MIN_VOL) -> Column:
    """Log volatility with a floor; NULL stays NULL."""
    return F.when(col(v).isNotNull(), F.ln(F.greatest(col(v), F.lit(floor))))


def annual_pct(v: str | Column) -> Column:
    return col(v) * F.lit(math.sqrt(P.ANNUAL_DAYS) * 100)


def fisher_ci(rho: str | Column, n: str | Column) -> tuple[Column, Column]:
    """95% interval of a Pearson r, 4 decimals, NULL below 4 pairs."""
    rho, n = col(rho), col(n)
    z = F.atanh(F.least(F.greatest(rho, F.lit(-0.999999)), F.lit(0.999999)))
    ok = rho.isNotNull() & (n >= 4)
    half = F.lit(P.Z_975) / F.sqrt(F.when(n >= 4, (n - 3).cast("double")))
    return (F.when(ok, r(F.tanh(z - half), 4)), F.when(ok, r(F.tanh(z + half), 4)))


def stars(p: str | Column) -> Column:
    p = col(p)
    return (F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("ns"))


def forecast_band(forecast: str | Column, error: str | Column) -> tuple[Column, Column]:
    f, e = col(forecast), col(error)
    return F.greatest(f - e, F.lit(0.0)), f + e


def clip(x: str | Column, lo: Column, hi: Column) -> Column:
    """x inside [lo, hi]; NULL stays NULL."""
    x = col(x)
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
