"""Normal distribution, intervals and other expressions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Z95 = 1.959964
#: Polynomial for the normal tail (error below 7.5e-8), rational form of its inverse.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INVERSE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INVERSE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INVERSE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INVERSE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _horner(x, coefficients):
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """Phi(x)."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * _horner(t, TAIL[::-1])
    return F.when(x < 0, tail).otherwise(1 - tail)


def normal_cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{TAIL[4]}"
    for c in TAIL[3::-1]:
        poly = f"({poly}) * {t} + ({c})"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * ({poly}))"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def t_two_sided(t: Column, dof: Column) -> Column:
    """Share of Student's t with ``dof`` >= 1 (fractions too) that lies farther out than ``t``; null without both.

    The density's tail from abs(t) on over that from 0 on. Points at exp(x - exp(-x)) past the tail's start, x in even
    steps, make plain sums converge at any ``dof``, and small shares keep their digits."""

    def tail(start: Column) -> Column:
        def at(i: Column) -> Column:
            x = i * 0.05 - 4
            past = F.exp(x - F.exp(-x))
            u = start + past
            return F.exp(-(dof + 1) / 2 * F.log1p(u * u / dof)) * past * (1 + F.exp(-x))

        return F.aggregate(F.sequence(F.lit(0), F.lit(680)), F.lit(0.0), lambda total, i: total + at(i))

    return F.when(t.isNotNull() & dof.isNotNull(), F.try_divide(tail(F.abs(t).cast("double")), tail(F.lit(0.0))))


def t_two_sided_sql(t: str, dof: str, cells: int = 2000) -> str:
    """The same by Simpson's rule over powers of the cosine of angles atan(t / sqrt(dof)), for moderate ``dof``."""

    def part(low: str) -> str:
        angle = f"({low} + (pi() / 2 - {low}) * i / {cells})"
        return f"(pi() / 2 - {low}) * list_sum([(CASE WHEN i IN (0, {cells}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * greatest(cos({angle}), 0) ** ({dof} - 1) FOR i IN range(0, {cells + 1})])"

    return f"({part(f'atan(abs({t}) / sqrt({dof}))')} / ({part('0')}))"


def normal_quantile(p: Column) -> Column:
    """Inverse of Phi, relative error below 1.2e-9."""
    low = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    edge = _horner(low, INVERSE_C) / _horner(low, (*INVERSE_D, 1.0))
    q = p - 0.5
    r = q * q
    middle = q * _horner(r, INVERSE_A) / _horner(r, (*INVERSE_B, 1.0))
    return F.when(p < 0.02425, edge).when(p > 1 - 0.02425, -edge).otherwise(middle)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a share: exactly 0 and 1 at the extremes, null without cases."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    low = F.when(n == 0, F.lit(None)).when(k == 0, 0.0).otherwise(F.try_divide(centre - half, scale))
    high = F.when(n == 0, F.lit(None)).when(k == n, 1.0).otherwise(F.try_divide(centre + half, scale))
    return low, high


def wilson_sql(k: str, n: str, z: float = Z95) -> tuple[str, str]:
    p, n = f"(({k})::DOUBLE / nullif({n}, 0))", f"({n})::DOUBLE"
    centre, half, scale = f"({p} + {z * z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n})))", f"(1 + {z * z} / {n})"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0.0 ELSE ({centre} - {half}) / {scale} END)", f"(CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1.0 ELSE ({centre} + {half}) / {scale} END)")


def trailing(partition: list[str], order: list[str], rows: int) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(rows - 1), 0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def no_nan(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from 10 on, exact products below."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 12, F.ln(F.factorial(F.least(n.cast("int"), F.lit(12))).cast("double"))).otherwise(series)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p of k successes of n at one half: min(1, 2 P(X <= min(k, n - k)))."""
    low = F.least(k, n - k)
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))
