"""Column helpers shared by all panel functions. Missing is NULL everywhere; NaN never leaves a function."""

from __future__ import annotations

import re
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TS, SYMBOL = "ts", "symbol"
#: Fixed values that results depend on.
EPSILON = 1e-10
TOLERANCE = 1e-6


class Kept:
    """Window expressions met while factors are compiled: each becomes a column once, however often it is used."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.new: list[tuple[str, Column]] = []

    def keep(self, e: Column) -> Column:
        key = str(e)
        if key not in self.names:
            self.names[key] = f"_w{len(self.names)}"
            self.new.append((self.names[key], e))
        return F.col(self.names[key])

    def take(self) -> list[dict[str, Column]]:
        """The new columns, in steps none of which uses a column of its own."""
        steps: list[dict[str, Column]] = []
        for name, e in self.new:
            used = set(re.findall(r"\b_w\d+\b", str(e)))
            if not steps or used & steps[-1].keys():
                steps.append({})
            steps[-1][name] = e
        self.new = []
        return steps


KEPT: ContextVar[Kept | None] = ContextVar("kept", default=None)


def over(e: Column, window) -> Column:
    """``e`` over a window; while factors are compiled, a reference to the column that holds it."""
    e = e.over(window)
    kept = KEPT.get()
    return e if kept is None else kept.keep(e)


def cross() -> Window:
    """All symbols of one timestamp."""
    return Window.partitionBy(TS)


def series() -> Window:
    """One symbol in time order."""
    return Window.partitionBy(SYMBOL).orderBy(TS)


def trailing(w: int) -> Window:
    """The last ``w`` grid rows of a symbol, the current one included."""
    if w < 1:
        raise ValueError("a window needs at least one row")
    return series().rowsBetween(-(w - 1), 0)


def no_nan(e: Column) -> Column:
    """``e``, evaluated once, with NaN made NULL."""
    return F.nanvl(e, F.lit(None).cast("double"))


def finite(e: Column) -> Column:
    return F.when(~F.isnan(e) & (F.abs(e) != float("inf")), e)


def clean(x: Column, e: Column) -> Column:
    """``e`` where no symbol of the timestamp lacks ``x``."""
    return F.when(over(F.count(x), cross()) == over(F.count(F.lit(1)), cross()), e)


def full(x: Column, w: int, e: Column) -> Column:
    """``e`` where the window is filled and lacks nothing."""
    return F.when(over(F.count(x), trailing(w)) == w, e)


def safe_divide(x: Column, y: Column, eps: float = EPSILON) -> Column:
    """x / y where |y| exceeds ``eps``."""
    return F.when(F.abs(y) > eps, no_nan(F.try_divide(x, y)))


def num(v: float) -> str:
    """A number as it appears in derived names: integral values without a point."""
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))
