"""Element-wise functions of one or two values, and distribution functions as plain expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import EPSILON, finite, no_nan

Value = Column | float


def col(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def sign(x: Column) -> Column:
    return F.signum(x)


def inverse(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def log(x: Column, base: float | None = None) -> Column:
    if base is not None and (base <= 0 or base == 1):
        raise ValueError(f"log base must be positive and not 1: {base}")
    e = F.ln(x) if base is None else F.ln(x) / math.log(base)
    return F.when(x > 0, e)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def add(x: Column, y: Value) -> Column:
    return no_nan(x + col(y))


def subtract(x: Column, y: Value) -> Column:
    return no_nan(x - col(y))


def multiply(x: Column, y: Value) -> Column:
    return no_nan(x * col(y))


def divide(x: Column, y: Value) -> Column:
    """By a factor: NULL where |y| is 1e-10 at most. By a number: NULL only for 0."""
    if isinstance(y, Column):
        return F.when(F.abs(y) > EPSILON, no_nan(F.try_divide(x, y)))
    return F.lit(None).cast("double") if y == 0 else no_nan(x / F.lit(float(y)))


def left_divide(v: float, x: Column) -> Column:
    """A number by a factor: NULL only where x is exactly 0."""
    return F.try_divide(F.lit(float(v)), x)


def power(x: Value, y: Value) -> Column:
    """x ** y without infinities; anything to the 0 is 1 and 1 to anything is 1, missing values included."""
    a, b = col(x), col(y)
    return F.when(F.coalesce(b == 0, F.lit(False)) | F.coalesce(a == 1, F.lit(False)), 1.0).otherwise(finite(F.pow(a, b)))


def signed_power(x: Column, y: Value) -> Column:
    size = power(F.abs(x), y)
    return F.when(x.isNotNull(), finite(F.signum(x) * size))


def maximum(x: Column, y: Value) -> Column:
    b = col(y)
    return F.when(x.isNotNull() & b.isNotNull(), F.greatest(x, b))


def minimum(x: Column, y: Value) -> Column:
    b = col(y)
    return F.when(x.isNotNull() & b.isNotNull(), F.least(x, b))


def _flag(test: Column, missing: float) -> Column:
    return F.coalesce(test.cast("double"), F.lit(missing))


def lt(x: Column, y: Value) -> Column:
    return _flag(x < col(y), 0.0)


def le(x: Column, y: Value) -> Column:
    return _flag(x <= col(y), 0.0)


def gt(x: Column, y: Value) -> Column:
    return _flag(x > col(y), 0.0)


def ge(x: Column, y: Value) -> Column:
    return _flag(x >= col(y), 0.0)


def eq(x: Column, y: Value) -> Column:
    return _flag(x == col(y), 0.0)


def ne(x: Column, y: Value) -> Column:
    """Unlike the other comparisons, a missing value is different from everything: 1."""
    return _flag(x != col(y), 1.0)


def where(cond: Column, x: Column, y: Value) -> Column:
    return F.when(cond.isNotNull() & (cond != 0), x).otherwise(col(y))


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    e = F.lit(coefficients[0])
    for c in coefficients[1:]:
        e = e * x + c
    return e


# Acklam's rational approximation of the normal quantile (fixed values).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_TAIL = 0.02425


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    tail = lambda q: _poly(PPF_C, q) / _poly((*PPF_D, 1.0), q)
    low, high = F.sqrt(-2.0 * F.ln(p)), F.sqrt(-2.0 * F.ln(1.0 - p))
    mid = p - 0.5
    centre = _poly(PPF_A, mid * mid) * mid / _poly((*PPF_B, 1.0), mid * mid)
    inside = F.when(p < PPF_TAIL, tail(low)).when(p > 1 - PPF_TAIL, -tail(high)).otherwise(centre)
    return F.when((p > 0) & (p < 1), inside)


# Hart's rational approximation of the normal distribution function (fixed values).
CDF_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT, CDF_ZERO, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631


def norm_cdf(x: Column) -> Column:
    """Distribution function of the standard normal distribution."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    fraction = a + 0.65
    for k in (4, 3, 2, 1):
        fraction = a + k / fraction
    upper = F.when(a > CDF_ZERO, 0.0).when(a < CDF_SPLIT, density * _poly(CDF_N, a) / _poly(CDF_D, a)).otherwise(density / fraction / ROOT_TWO_PI)
    return F.when(x > 0, 1.0 - upper).otherwise(F.when(x.isNotNull(), upper))


DRIVERS = ("gaussian", "uniform", "cauchy")


def ppf(driver: str, p: Column) -> Column:
    if driver not in DRIVERS:
        raise ValueError(f"driver must be one of {DRIVERS}: {driver}")
    return {"gaussian": norm_ppf, "uniform": lambda e: e, "cauchy": lambda e: F.tan(math.pi * (e - 0.5))}[driver](p)
