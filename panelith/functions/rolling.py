"""Time-series functions: over the trailing grid rows of one symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import EPSILON, TOLERANCE, finite, full, no_nan, over, safe_divide, series, trailing
from .cross import condition_2x2
from .elementwise import ppf


def delay(x: Column, w: int) -> Column:
    return over(F.lag(x, w), series()) if w else x


def delta(x: Column, w: int) -> Column:
    return x - delay(x, w)


def step(x: Column, start: int = 0) -> Column:
    """The grid row's number; the values do not matter."""
    return (over(F.row_number(), series()) - 1 + start).cast("double")


def total(x: Column, w: int) -> Column:
    return full(x, w, over(F.sum(x), trailing(w)))


def product(x: Column, w: int) -> Column:
    return full(x, w, over(F.product(x), trailing(w)))


def mean(x: Column, w: int) -> Column:
    return full(x, w, over(F.avg(x), trailing(w)))


def median(x: Column, w: int) -> Column:
    return full(x, w, over(F.percentile(x, 0.5), trailing(w)))


def std_dev(x: Column, w: int) -> Column:
    return full(x, w, no_nan(over(F.stddev_samp(x), trailing(w))))


def minimum(x: Column, w: int) -> Column:
    return full(x, w, over(F.min(x), trailing(w)))


def maximum(x: Column, w: int) -> Column:
    return full(x, w, over(F.max(x), trailing(w)))


def _values(x: Column, w: int) -> Column:
    return over(F.collect_list(x), trailing(w))


def arg_max(x: Column, w: int) -> Column:
    """Rows back to the highest value, the earliest of equals."""
    v = _values(x, w)
    return full(x, w, (w - F.array_position(v, F.array_max(v))).cast("double"))


def arg_min(x: Column, w: int) -> Column:
    v = _values(x, w)
    return full(x, w, (w - F.array_position(v, F.array_min(v))).cast("double"))


def count_nans(x: Column, w: int) -> Column:
    """Missing values in the frame, which may be short; NULL if all are."""
    t = trailing(w)
    return F.when(over(F.count(x), t) >= 1, (over(F.count(F.lit(1)), t) - over(F.count(x), t)).cast("double"))


def av_diff(x: Column, w: int) -> Column:
    return x - mean(x, w)


def rank(x: Column, w: int) -> Column:
    """Share of the window not above the current value; NULL if all are equal."""
    t = trailing(w)
    below = F.size(F.filter(_values(x, w), lambda v: v <= x))
    return full(x, w, F.when(over(F.min(x), t) < over(F.max(x), t), below / F.lit(float(w))))


def scale(x: Column, w: int, constant: float = 0.0) -> Column:
    low, high = minimum(x, w), maximum(x, w)
    return finite(safe_divide(x - low, high - low) + float(constant))


def zscore(x: Column, w: int) -> Column:
    return finite(safe_divide(av_diff(x, w), std_dev(x, w)))


def quantile(x: Column, w: int, driver: str = "gaussian") -> Column:
    r = rank(x, w)
    return F.when(r.isNotNull(), ppf(driver, F.greatest(F.lit(TOLERANCE), F.least(F.lit(1 - TOLERANCE), r))))


def kurtosis(x: Column, w: int) -> Column:
    """Population excess kurtosis."""
    t = trailing(w)
    return full(x, w, F.when((over(F.min(x), t) < over(F.max(x), t)) & (over(F.stddev_pop(x), t) >= EPSILON), over(F.kurtosis(x), t)))


def skewness(x: Column, w: int) -> Column:
    """Of the distances to the rolling means, so the first value comes after 2 w - 1 rows."""
    d = av_diff(x, w)
    cubes, squares = total(d * d * d, w), total(d * d, w)
    return finite(safe_divide(float(w) * cubes, F.pow(squares, F.lit(1.5)) * float((w - 1) * (w - 2))))


def backfill(x: Column, w: int, k: int = 1) -> Column:
    """A missing value becomes the k-th latest of the frame, which may be short."""
    if k < 1:
        raise ValueError("k counts from 1")
    return F.coalesce(x, F.try_element_at(_values(x, w), F.lit(-k)))


def _decay(x: Column, w: int, weight, dense: bool) -> tuple[Column, Column]:
    """Weighted total and weight of a frame that may be short; ``weight(age, size)``, age 0 the newest."""
    frame = over(F.collect_list(F.struct(x.alias("x"))), trailing(w))
    at = F.transform(frame, lambda s, i: F.struct(s["x"].alias("x"), weight(F.size(frame) - 1 - i, F.size(frame)).alias("w")))
    used = F.filter(at, lambda s: s["x"].isNotNull()) if dense else at
    top = F.aggregate(used, F.lit(0.0), lambda a, s: a + F.coalesce(s["x"], F.lit(0.0)) * s["w"])
    return top, F.aggregate(used, F.lit(0.0), lambda a, s: a + s["w"])


def decay_exp_window(x: Column, w: int, factor: float = 0.5, nan: bool = True) -> Column:
    """Weights factor ** age, the newest heaviest. With ``nan`` only present values count, else missing ones are 0."""
    if not 0 < factor < 1:
        raise ValueError(f"factor must lie between 0 and 1: {factor}")
    top, weight = _decay(x, w, lambda age, _: F.pow(F.lit(float(factor)), age.cast("double")), nan)
    return F.when(over(F.count(x), trailing(w)) >= 1, F.try_divide(top, weight)).otherwise(F.lit(None if nan else 0.0).cast("double"))


def decay_linear(x: Column, w: int, dense: bool = False) -> Column:
    """Weights falling from the oldest row to the newest. Without ``dense`` missing values count as 0.

    With ``dense`` the weights run over the present values alone.
    """
    t = trailing(w)
    if dense:
        frame = over(F.collect_list(x), t)
        parts = F.transform(frame, lambda v, i: F.struct(v.alias("x"), (F.size(frame) - i).cast("double").alias("w")))
    else:
        frame = over(F.collect_list(F.struct(x.alias("x"))), t)
        parts = F.transform(frame, lambda s, i: F.struct(F.coalesce(s["x"], F.lit(0.0)).alias("x"), (F.size(frame) - i).cast("double").alias("w")))
    top = F.aggregate(parts, F.lit(0.0), lambda a, s: a + s["x"] * s["w"])
    weight = F.aggregate(parts, F.lit(0.0), lambda a, s: a + s["w"])
    return F.when(over(F.count(x), t) >= 1, F.try_divide(top, weight))


def _pair(x: Column, y: Column, w: int, e: Column) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return F.when(over(F.count(both), trailing(w)) == w, no_nan(e))


def covariance(x: Column, y: Column, w: int) -> Column:
    return _pair(x, y, w, over(F.covar_samp(x, y), trailing(w)))


def corr(x: Column, y: Column, w: int) -> Column:
    t = trailing(w)
    varied = (over(F.min(x), t) < over(F.max(x), t)) & (over(F.min(y), t) < over(F.max(y), t))
    e = F.try_divide(over(F.covar_samp(x, y), t), over(F.stddev_samp(x), t) * over(F.stddev_samp(y), t))
    return _pair(x, y, w, F.when(varied, e))


def autocorr(x: Column, w: int, lag: int = 1) -> Column:
    if lag < 1:
        raise ValueError("lag counts from 1")
    return corr(x, delay(x, lag), w)


def cv(x: Column, w: int) -> Column:
    """Coefficient of variation."""
    return finite(std_dev(x, w) / (F.abs(mean(x, w)) + EPSILON))


def jumpiness(x: Column, w: int) -> Column:
    path = total(F.abs(delta(x, 1)), w)
    return finite(safe_divide(path, maximum(x, w) - minimum(x, w) + EPSILON))


def vr(x: Column, w: int, k: int = 2) -> Column:
    """Variance of k-step changes over k times that of single steps."""
    if k < 1:
        raise ValueError("k counts from 1")
    var = lambda e: F.pow(std_dev(e, w), F.lit(2.0))
    return finite(safe_divide(var(delta(x, k)), float(k) * var(delta(x, 1)) + EPSILON))


def reversal_count(x: Column, w: int) -> Column:
    """Share of changes of direction among neighbouring differences; frames may be short."""
    frame = over(F.collect_list(F.struct(x.alias("x"))), trailing(w))
    pairs = F.zip_with(F.slice(frame, 2, w), F.slice(frame, 1, F.greatest(F.lit(0), F.size(frame) - 1)), lambda b, a: b["x"] - a["x"])
    moves = F.transform(F.filter(pairs, lambda d: d.isNotNull()), lambda d: F.signum(d))
    n = F.size(moves)
    turns = F.zip_with(F.slice(moves, 2, w), F.slice(moves, 1, F.greatest(F.lit(0), n - 1)), lambda b, a: F.when(b != a, 1).otherwise(0))
    count = F.aggregate(turns, F.lit(0), lambda a, t: a + t)
    return F.when((over(F.count(x), trailing(w)) >= 3) & (n >= 2), F.try_divide(count.cast("double"), (n - 1).cast("double")))


def regression(y: Column, x: Column, w: int, lag: int = 0, rettype: int = 0) -> Column:
    """Rolling least squares with intercept on one regressor.

    Rows that lack either value drop out; three must be left. ``rettype``: 0 residual and 3 fitted
    value of the last row left, 1 intercept, 2 (and 100) slope, 4 residual, 5 total sum of squares,
    6 R squared, 7 mean square error, 9 standard error of the intercept; 8 needs a second regressor.
    """
    z = delay(x, lag)
    both = y.isNotNull() & z.isNotNull()
    a, b, t = F.when(both, y), F.when(both, z), trailing(w)
    n, s, ss = over(F.count(b), t).cast("double"), over(F.sum(b), t), over(F.sum(b * b), t)
    usable = (over(F.row_number(), series()) >= w) & (n >= 3) & (condition_2x2(n, s, ss) <= EPSILON**-1)
    sxx, syy, sxy = over(F.regr_sxx(a, b), t), over(F.regr_syy(a, b), t), over(F.regr_sxy(a, b), t)
    slope = F.try_divide(sxy, sxx)
    start = over(F.avg(a), t) - slope * over(F.avg(b), t)
    last = over(F.last(F.when(both, F.struct(y.alias("y"), z.alias("z"))), ignorenulls=True), t)
    fitted = start + slope * last["z"]
    sse = F.greatest(F.lit(0.0), syy - slope * sxy)
    varied = over(F.min(a), t) < over(F.max(a), t)
    mse = F.when(n > 2, sse / (n - 2))
    kinds = {
        0: last["y"] - fitted,
        1: start,
        2: slope,
        3: fitted,
        4: sse,
        5: F.when(varied, syy).otherwise(0.0),
        6: F.when(varied, 1.0 - F.try_divide(sse, syy)),
        7: mse,
        9: F.when(mse > 0, F.sqrt(mse * F.try_divide(ss, n * sxx))),
        100: slope,
    }
    return F.when(usable, no_nan(kinds[rettype])) if rettype in kinds else F.lit(None).cast("double")


def trend_strength(x: Column, w: int) -> Column:
    """R squared of the values on the row number."""
    return regression(x, step(x), w, 0, 6)
