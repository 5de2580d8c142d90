"""Tail probabilities as column expressions. Spark SQL has no distribution
functions, so these are integrals by a fold of fixed length, for the few rows
of a result. The plain forms on top serve single values and tests."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_1_upper(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k successes in n fair trials."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
            for i in range(k + 1)]
    return min(1.0, 2.0 * sum(math.exp(v) for v in logs))


#: Intervals of the fixed-length integrals below, an even number.
INTERVALS = 1_000
#: Standard deviations beyond which a tail counts as nothing.
_FAR = 12.0


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _integral(f: Callable[[Column], Column], low: Column, high: Column) -> Column:
    """Simpson's rule as a fold over a fixed number of points."""
    width = (high - low) / INTERVALS

    def step(total: Column, i: Column) -> Column:
        share = F.when((i == 0) | (i == INTERVALS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + share * f(low + width * i)

    return F.aggregate(F.sequence(F.lit(0), F.lit(INTERVALS)), F.lit(0.0), step) * width / 3.0


def t_p(t: str | Column, dof: str | Column) -> Column:
    """Two-sided p of a t statistic: with t = sqrt(dof) tan(a), the share of
    cos(a) ^ (dof - 1) beyond the angle of t."""
    t, dof = _column(t), _column(dof).cast("double")
    height = lambda a: F.pow(F.cos(a), dof - 1.0)
    end = F.least(F.lit(math.pi / 2), F.lit(_FAR) / F.sqrt(dof))
    at = F.least(F.atan(F.abs(t) / F.sqrt(dof)), end)
    return F.least(F.lit(1.0), _integral(height, at, end) / _integral(height, F.lit(0.0), end))


def z_p(z: str | Column) -> Column:
    """Two-sided p of a z statistic."""
    a = F.abs(_column(z))
    return F.least(F.lit(1.0), _integral(lambda u: F.exp(-u * u / 2.0), a, a + _FAR) * math.sqrt(2 / math.pi))


def r_p(r: str | Column, n: str | Column) -> Column:
    """Two-sided p of a Pearson or Spearman r over n pairs."""
    r, n = _column(r), _column(n).cast("double")
    t = r * F.sqrt((n - 2.0) / (1.0 - r * r))
    return F.when(r.isNull() | n.isNull(), None).when(F.abs(r) >= 1.0, 0.0).when(n < 3, 1.0).otherwise(t_p(t, n - 2.0))


def binomial_p(k: str | Column, n: str | Column) -> Column:
    """Exact two-sided test of k successes in n < 25 fair trials."""
    k, n = _column(k).cast("int"), _column(n).cast("int")
    k = F.least(k, n - k)
    start = F.struct(F.lit(1.0).alias("ways"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        return F.struct((s["ways"] * (n - i) / (i + 1)).alias("ways"), (s["sum"] + F.when(i <= k, s["ways"]).otherwise(0.0)).alias("sum"))

    ways = F.aggregate(F.sequence(F.lit(0), F.lit(24)), start, step, lambda s: s["sum"])
    return F.least(F.lit(1.0), 2.0 * ways / F.pow(F.lit(2.0), n))


def mcnemar_p(a_only: str | Column, b_only: str | Column) -> Column:
    """Exact below 25 discordant pairs, otherwise chi-square with correction."""
    a, b = _column(a_only).cast("double"), _column(b_only).cast("double")
    n, gap = a + b, F.abs(a - b) - 1.0
    return F.when(n < 25, binomial_p(F.least(a, b), n)).otherwise(z_p(F.sqrt(gap * gap / n)))


# The same folds as SQL text.


def _integral_sql(height: str, low: str, high: str) -> str:
    """`height` is an expression over {u}."""
    point = f"({low} + ({high} - {low}) * i / {INTERVALS}.0)"
    share = f"CASE WHEN i = 0 OR i = {INTERVALS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return (f"(list_sum(list_transform(range({INTERVALS + 1}), lambda i: CAST({share} AS DOUBLE) * {height.replace('{u}', point)}))"
            f" * ({high} - {low}) / {INTERVALS * 3}.0)")


def t_p_sql(t: str, dof: str) -> str:
    dof = f"CAST({dof} AS DOUBLE)"
    end = f"least(pi() / 2, {_FAR} / sqrt({dof}))"
    height = f"pow(cos({{u}}), {dof} - 1.0)"
    low = f"least(atan(abs({t}) / sqrt({dof})), {end})"
    return f"least(1.0, {_integral_sql(height, low, end)} / {_integral_sql(height, '0.0', end)})"


def z_p_sql(z: str) -> str:
    return f"least(1.0, {_integral_sql('exp(-{u} * {u} / 2.0)', f'abs({z})', f'(abs({z}) + {_FAR})')} * sqrt(2.0 / pi()))"


def r_p_sql(r: str, n: str) -> str:
    t = f"({r} * sqrt(({n} - 2.0) / (1.0 - {r} * {r})))"
    return (f"CASE WHEN {r} IS NULL OR {n} IS NULL THEN NULL WHEN abs({r}) >= 1.0 THEN 0.0 WHEN {n} < 3 THEN 1.0 "
            f"ELSE {t_p_sql(t, f'({n} - 2.0)')} END")
