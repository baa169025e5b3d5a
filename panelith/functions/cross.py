"""Cross-sectional functions: over all symbols of a timestamp, or over a group of them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .base import EPSILON, SYMBOL, TOLERANCE, TS, clean, cross, no_nan, over
from .elementwise import ppf


def rank(x: Column) -> Column:
    """Share of the symbols, ties at their lowest; NULL for the period if any is missing or all are equal."""
    c = cross()
    place = over(F.rank(), c.orderBy(x.asc_nulls_last())) / over(F.count(F.lit(1)), c)
    return clean(x, F.when(over(F.min(x), c) < over(F.max(x), c), place))


def mean(x: Column) -> Column:
    return clean(x, over(F.avg(x), cross()))


def median(x: Column) -> Column:
    return clean(x, over(F.median(x), cross()))


def normalize(x: Column, use_std: bool = False, limit: float = 0.0) -> Column:
    c = cross()
    e = x - over(F.avg(x), c)
    if use_std:
        sd = over(F.stddev_samp(x), c)
        e = F.when((sd > 0) & ~F.isnan(sd), e / sd)
    if limit != 0:
        e = F.when(e.isNotNull(), F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), e)))
    return e


def zscore(x: Column) -> Column:
    return normalize(x, True)


def scale(x: Column, scale: float = 1.0, long_scale: float | None = None, short_scale: float | None = None) -> Column:
    """To a total of absolute values, or the positive and negative side each to its own.

    The negative side is divided by its own total of absolute values and multiplied by minus the
    short scale, which makes it positive; that is how this operator is defined.
    """
    c = cross()
    if long_scale is None and short_scale is None:
        total = over(F.sum(F.abs(x)), c)
        return F.when(total == 0, x).otherwise(F.try_divide(x, total) * float(scale))
    up = float(scale if long_scale is None else long_scale)
    down = float(scale if short_scale is None else short_scale)
    longs = over(F.sum(F.when(x > 0, x).otherwise(0.0)), c)
    shorts = over(F.sum(F.when(x < 0, -x).otherwise(0.0)), c)
    positive = x if up <= 0 else F.try_divide(x, longs) * up
    negative = x if down <= 0 else F.try_divide(x, shorts) * -down
    return F.when(x > 0, positive).when(x < 0, negative).otherwise(x)


def quantile(x: Column, driver: str = "gaussian", sigma: float = 1.0) -> Column:
    """Ranks (ties by symbol) pressed into the open unit interval and mapped to a distribution."""
    c = cross()
    n = over(F.count(x), c)
    r = over(F.row_number(), c.orderBy(x.asc_nulls_last(), SYMBOL)) / n
    squeeze = lambda e: F.greatest(F.lit(TOLERANCE), F.least(F.lit(1 - TOLERANCE), e))
    p = squeeze(1.0 / n + squeeze(r) * (1.0 - 2.0 / n))
    mapped = ppf(driver, p)
    return F.when(x.isNotNull() & (n >= 2), mapped * float(sigma) if sigma != 1 else mapped)


def spread(x: Column, pct: float) -> Column:
    """+0.5 for the highest share of the symbols, -0.5 for the lowest; missing values sort highest."""
    if not 0 < pct < 1:
        raise ValueError(f"pct must lie between 0 and 1: {pct}")
    c = cross()
    size = over(F.count(F.lit(1)), c)
    picked = F.greatest(F.lit(1), F.floor(size * float(pct)))
    place = over(F.row_number(), c.orderBy(x.asc_nulls_last(), SYMBOL))
    side = F.when(place <= picked, -0.5).when(place > size - picked, 0.5).otherwise(0.0)
    return F.when(over(F.count(x), c) < 2, 0.0).otherwise(side)


def signal(x: Column) -> Column:
    """Demeaned and divided by the total of absolute values: half long, half short."""
    c = cross()
    centred = x - over(F.avg(x), c)
    total = over(F.sum(F.abs(centred)), c)
    return clean(x, F.when(total >= EPSILON, centred / total))


def vector_neut(x: Column, y: Column) -> Column:
    """x less its projection on y over the cells that have both; no intercept."""
    c = cross()
    both = x.isNotNull() & y.isNotNull()
    yy, xy = F.when(both, y), F.when(both, x)
    square = over(F.sum(yy * yy), c)
    usable = (over(F.count(yy), c) >= 2) & (over(F.stddev_pop(yy), c) >= F.greatest(F.lit(EPSILON), 1e-4 * F.abs(over(F.avg(yy), c)))) & (square >= EPSILON)
    return F.when(both & usable, x - F.try_divide(over(F.sum(xy * yy), c), square) * y).otherwise(x)


def condition_2x2(n: Column, s: Column, ss: Column) -> Column:
    """Ratio of the eigenvalues of [[n, s], [s, ss]]; NULL where the lesser is not positive."""
    half = (n + ss) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), (n - ss) * (n - ss) / 4 + s * s))
    high = half + root
    low = F.try_divide(n * ss - s * s, high)  # stabler than half - root
    return F.when(low > 0, high / low)


def regression_neut(y: Column, x: Column) -> Column:
    """Residual of a cross-sectional least squares fit with intercept on one regressor."""
    c = cross()
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, y), F.when(both, x)
    n, s, ss = over(F.count(b), c).cast("double"), over(F.sum(b), c), over(F.sum(b * b), c)
    cond = condition_2x2(n, s, ss)
    mean_x, mean_y = s / n, over(F.avg(a), c)
    sxx = over(F.sum((b - mean_x) * (b - mean_x)), c)
    slope = F.try_divide(over(F.sum((b - mean_x) * (a - mean_y)), c), sxx)
    return F.when(both & (n >= 2) & (cond <= 1e20), (y - mean_y) - slope * (x - mean_x))


# Group functions: ``g`` is the group id of a cell; a NULL group gives NULL.


def _grouped(g: Column) -> Window:
    return Window.partitionBy(TS, g)


def _in(g: Column, e: Column) -> Column:
    return F.when(g.isNotNull(), no_nan(e))


def group_neutralize(x: Column, g: Column) -> Column:
    return _in(g, x - over(F.avg(x), _grouped(g)))


def group_mean(x: Column, g: Column) -> Column:
    """For every member, those without a value too."""
    return _in(g, over(F.avg(x), _grouped(g)))


def group_median(x: Column, g: Column) -> Column:
    return _in(g, over(F.median(x), _grouped(g)))


def group_rank(x: Column, g: Column) -> Column:
    """Share of the members with a value, ties at their average."""
    w = _grouped(g)
    ties = over(F.count(F.lit(1)), Window.partitionBy(TS, g, x))
    place = over(F.rank(), w.orderBy(x.asc_nulls_last())) + (ties - 1) / 2
    return _in(g, F.when(x.isNotNull(), F.try_divide(place, over(F.count(x), w))))


def group_scale(x: Column, g: Column) -> Column:
    """To 0..1 within the group; 0.5 for every member where there is no range."""
    w = _grouped(g)
    low, span = over(F.min(x), w), over(F.max(x), w) - over(F.min(x), w)
    return _in(g, F.when(span.isNull() | (span <= EPSILON), 0.5).otherwise(F.try_divide(x - low, span)))


def group_zscore(x: Column, g: Column) -> Column:
    w = _grouped(g)
    sd = over(F.stddev_samp(x), w)
    return _in(g, F.when((sd > EPSILON) & ~F.isnan(sd), F.try_divide(x - over(F.avg(x), w), sd)))


def group_normalize(x: Column, g: Column, scale: float = 1.0) -> Column:
    """To a total of absolute values; 0 for every member where that is nothing."""
    total = F.coalesce(over(F.sum(F.abs(x)), _grouped(g)), F.lit(0.0))
    return _in(g, F.when(total <= EPSILON, 0.0).otherwise(F.try_divide(x, total) * float(scale)))


def average_rank(x: Column) -> Column:
    """Average rank among the values of a timestamp, from 1; NULL for missing values."""
    c = cross()
    ties = over(F.count(F.lit(1)), Window.partitionBy(TS, x))
    return F.when(x.isNotNull(), over(F.rank(), c.orderBy(x.asc_nulls_last())) + (ties - 1) / 2)
