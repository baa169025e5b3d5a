"""Panels: dense (timestamp, symbol) grids with value columns, and lazy factors over them.

A factor is an expression node. Nodes of one panel compile to columns of one DataFrame: equal nodes
are compiled once, and nodes are evaluated in stages ordered so that the data change their
partitioning (by symbol for rolling windows, by timestamp for cross-sections) as seldom as possible.
Factors of different grids meet in an inner join on (ts, symbol) and go on as one grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith import report
from panelith.functions import cross, elementwise, rolling
from panelith.functions.base import KEPT, SYMBOL, TS, Kept, num

NONE, BY_TS, BY_SYMBOL = "none", "ts", "symbol"


class Panel:
    """A dense grid: every timestamp with every symbol, missing cells NULL."""

    def __init__(self, frame: DataFrame, columns: list[str]):
        self.frame, self.columns = frame, sorted(columns)

    # Sources

    @classmethod
    def from_frame(cls, df: DataFrame, ts: str = TS, symbol: str = SYMBOL, columns: Iterable[str] | None = None, ordinal: str | None = None) -> Panel:
        """Densifies sparse rows. Rows that repeat a key need an ``ordinal``, whose highest wins.

        Without one the keys have to be unique; NaN becomes NULL.
        """
        names = list(columns) if columns is not None else [c for c in df.columns if c not in (ts, symbol, ordinal)]
        if not names:
            raise ValueError("a panel needs at least one value column")
        rows = df.where(F.col(ts).isNotNull() & F.col(symbol).isNotNull())
        if ordinal is not None:
            latest = Window.partitionBy(ts, symbol).orderBy(F.col(ordinal).desc())
            rows = rows.withColumn("_at", F.row_number().over(latest)).where("_at = 1")
        value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
        rows = rows.select(F.col(ts).alias(TS), F.col(symbol).cast("string").alias(SYMBOL), *map(value, names))
        # The grid of all pairs is the panel's definition, not a join of rows with rows. The symbols are dealt
        # out first: few as they may be, the grid is as wide as they are spread, and stays spread by symbol.
        wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spine = rows.select(TS).distinct().crossJoin(rows.select(SYMBOL).distinct().repartition(wide, SYMBOL))
        return cls(spine.join(rows, [TS, SYMBOL], "left"), names)

    @classmethod
    def from_records(cls, spark, columns: list[str], records: list[tuple]) -> Panel:
        """(timestamp, symbol, value, ...) tuples; of repeated keys the last wins."""
        if not columns or any(len(r) != len(columns) + 2 for r in records):
            raise ValueError("every record needs a timestamp, a symbol and one value for each column")
        if not records:
            raise ValueError("a panel needs at least one record")
        rows = [(str(r[0]), str(r[1]), i, *(None if v is None else float(v) for v in r[2:])) for i, r in enumerate(records)]
        schema = f"{TS} string, {SYMBOL} string, _n long, " + ", ".join(f"`{c}` double" for c in columns)
        return cls.from_frame(spark.createDataFrame(rows, schema), columns=columns, ordinal="_n")

    # Shape

    def column_names(self) -> list[str]:
        return list(self.columns)

    def timestamps(self) -> DataFrame:
        return self.frame.select(TS).distinct().orderBy(TS)

    def symbols(self) -> DataFrame:
        return self.frame.select(SYMBOL).distinct().orderBy(SYMBOL)

    def __len__(self) -> int:
        return self.frame.count()

    def is_empty(self) -> bool:
        return self.frame.isEmpty()

    def info(self) -> DataFrame:
        """One row: sizes, range, and missing cells of each column."""
        counts = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in self.columns]
        return self.frame.agg(F.count("*").alias("n_rows"), F.lit(len(self.columns)).alias("n_columns"), F.countDistinct(SYMBOL).alias("n_symbols"), F.countDistinct(TS).alias("n_periods"), F.min(TS).alias("first"), F.max(TS).alias("last"), *counts)

    def describe(self) -> str:
        return report.panel_info(self.info().first(), self.columns)

    def __str__(self) -> str:
        return report.panel_line(self.info().first(), self.columns)

    # Subsets, taken from the finished grid

    def select(self, columns: Iterable[str]) -> Panel:
        names = [c for c in dict.fromkeys(columns) if c not in (TS, SYMBOL, "timestamp")]
        if missing := [c for c in names if c not in self.columns]:
            raise KeyError(f"no such column: {missing[0]}")
        if not names:
            raise ValueError("no value column is left")
        return Panel(self.frame.select(TS, SYMBOL, *names), names)

    def slice_time(self, start=None, end=None) -> Panel:
        """The closed interval; either side may be open."""
        df = self.frame
        if start is not None:
            df = df.where(F.col(TS) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(TS) <= F.lit(end))
        return Panel(df, self.columns)

    def slice_symbols(self, symbols: Iterable[str]) -> Panel:
        return Panel(self.frame.where(F.col(SYMBOL).isin(*symbols)), self.columns)

    def records(self) -> DataFrame:
        return self.frame.select(TS, SYMBOL, *self.columns).orderBy(TS, SYMBOL)

    # Factors

    def factor(self, column: str) -> Factor:
        if column not in self.columns:
            raise KeyError(f"no such column: {column}")
        return Factor(self, ("column", column), (), NONE, lambda: F.col(column), column)

    def compute(self, **factors: Factor) -> DataFrame:
        """(ts, symbol, one column for each factor), all of this panel."""
        return compile_factors(self, factors)


@dataclass(frozen=True)
class Factor:
    """A lazy matrix: an operation on other factors of one panel, with a derived name."""

    panel: Panel = field(compare=False, repr=False)
    key: tuple
    inputs: tuple[Factor, ...] = field(repr=False)
    needs: str = field(compare=False)
    build: Callable[..., Column] = field(compare=False, repr=False)
    name: str = field(compare=False)

    @classmethod
    def from_records(cls, spark, records: list[tuple], name: str = "factor") -> Factor:
        """(timestamp, symbol, value) tuples on their dense grid; of repeated keys the last wins."""
        return Panel.from_records(spark, ["value"], records).factor("value").rename(name)

    @classmethod
    def from_matrix(cls, spark, timestamps: list, symbols: list[str], values: list[list], name: str = "factor") -> Factor:
        """A row of ``values`` for each timestamp, a column for each symbol; None and NaN are missing."""
        if len(values) != len(timestamps) or any(len(r) != len(symbols) for r in values):
            raise ValueError("a matrix needs a row for each timestamp and a column for each symbol")
        return cls.from_records(spark, [(t, s, v) for t, row in zip(timestamps, values) for s, v in zip(symbols, row)], name)

    def rename(self, name: str) -> Factor:
        return Factor(self.panel, self.key, self.inputs, self.needs, self.build, name)

    def frame(self, column: str = "value") -> DataFrame:
        return self.panel.compute(**{column: self})

    def map(self, function: Callable[[Column], Column], name: str) -> Factor:
        """Any element-wise column function."""
        return self._op("map", (function,), NONE, function, name)

    def _op(self, op: str, params: tuple, needs: str, build: Callable[..., Column], name: str, *others: Factor) -> Factor:
        factors = (self, *others)
        if any(f.panel is not self.panel for f in others):
            factors = align(*factors)
        return Factor(factors[0].panel, (op, *params, *(f.key for f in factors)), factors, needs, build, name)

    # Access

    def records(self) -> DataFrame:
        return self.frame("factor").select(F.col(TS).alias("timestamp"), SYMBOL, "factor").orderBy("timestamp", SYMBOL)

    def row(self, ts) -> DataFrame:
        return self.frame().where(F.col(TS) == F.lit(ts))

    def series(self, symbol: str) -> DataFrame:
        return self.frame().where(F.col(SYMBOL) == symbol)

    def get(self, ts, symbol: str) -> float | None:
        row = self.row(ts).where(F.col(SYMBOL) == symbol).first()
        return row["value"] if row else None

    def weights(self, ts=None) -> DataFrame:
        """(symbol, weight) of one period, the last by default; missing ones are left out."""
        df = self.frame("weight")
        if ts is None:
            at = df.agg(F.max(TS).alias("_last"))
            df = df.join(F.broadcast(at), F.col(TS) == F.col("_last"))  # one row
        else:
            df = df.where(F.col(TS) == F.lit(ts))
        return df.where("weight is not null").select(SYMBOL, "weight").orderBy(SYMBOL)

    def info(self) -> DataFrame:
        """One row: counts, mean, sample deviation and range over all cells."""
        x = F.col("value")
        return self.frame().agg(F.count(x).alias("n_valid"), F.count_if(x.isNull()).alias("n_missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))

    def __str__(self) -> str:
        r = self.panel.info().first()
        return report.factor_line(self.name, r.n_periods, r.n_symbols, r["first"], r["last"])

    def is_signal(self, ts=None) -> DataFrame:
        """(ts, is_signal): longs near 0.5, shorts near -0.5, and their sum near 0."""
        df = self.frame()
        x = F.col("value")
        near = lambda e, to: F.abs(e - to) <= 1e-2 + 1e-5 * abs(to)
        longs, shorts = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, x).otherwise(0.0))
        out = df.groupBy(TS).agg((near(longs, 0.5) & near(shorts, -0.5) & near(longs + shorts, 0.0) & (F.count(x) > 0)).alias("is_signal"))
        return out if ts is None else out.where(F.col(TS) == F.lit(ts))

    # Operators

    def __add__(self, o):
        return self.add(o)

    def __radd__(self, o):
        return self._left("+", o, lambda v: lambda x: elementwise.add(x, v))

    def __sub__(self, o):
        return self.subtract(o)

    def __rsub__(self, o):
        return self.scalar_sub(o)

    def __mul__(self, o):
        return self.multiply(o)

    def __rmul__(self, o):
        return self._left("*", o, lambda v: lambda x: elementwise.multiply(x, v))

    def __truediv__(self, o):
        return self.divide(o)

    def __rtruediv__(self, o):
        return self.scalar_div(o)

    def __pow__(self, o):
        return self.power(o)

    def __rpow__(self, o):
        return self.scalar_power(o)

    def __neg__(self):
        return self.reverse()

    def __lt__(self, o):
        return self.lt(o)

    def __le__(self, o):
        return self.le(o)

    def __gt__(self, o):
        return self.gt(o)

    def __ge__(self, o):
        return self.ge(o)

    def _left(self, sign: str, v: float, build) -> Factor:
        return self._op(f"left{sign}", (float(v),), NONE, build(float(v)), f"({num(v)}{sign}{self.name})")

    def scalar_sub(self, v: float) -> Factor:
        return self._left("-", v, lambda v: lambda x: F.lit(v) - x)

    def scalar_div(self, v: float) -> Factor:
        return self._left("/", v, lambda v: lambda x: elementwise.left_divide(v, x))

    def scalar_power(self, b: float) -> Factor:
        return self._left("**", b, lambda b: lambda x: elementwise.power(b, x))

    def where_cond(self, cond: Factor, other: Factor | float) -> Factor:
        """This factor where ``cond`` is present and not 0, else ``other``.

        Against a factor the grid is what the two share, and a cell without condition takes the
        other; against a number it is what this factor shares with the condition.
        """
        name = f"where({self.name})"
        if not isinstance(other, Factor):
            v = float(other)
            return self._op("where", (v,), NONE, lambda x, c: elementwise.where(c, x, v), name, cond)
        if cond.panel is self.panel and other.panel is self.panel:
            return self._op("where", (), NONE, lambda x, c, o: elementwise.where(c, x, o), name, cond, other)
        x, o = align(self, other) if other.panel is not self.panel else (self, other)
        left = x.panel.compute(x=x, o=o).join(cond.frame("c"), [TS, SYMBOL], "left")
        grid = Panel(left, ["x", "o", "c"])
        return grid.factor("x").where_cond(grid.factor("c"), grid.factor("o")).rename(name)

    def group_map(self, groups: dict[str, float], name: str | None = None) -> Factor:
        """The group id of each cell's symbol, constant over time; NULL for symbols not in the map."""
        pairs = tuple(sorted((str(k), float(v)) for k, v in groups.items()))
        lookup = F.create_map(*[F.lit(v) for p in pairs for v in p]) if pairs else None
        build = (lambda x: F.try_element_at(lookup, F.col(SYMBOL))) if pairs else (lambda x: F.lit(None).cast("double"))
        return self._op("group_map", pairs, NONE, build, name or f"group({self.name})")

    def group_named(self, mapping: str) -> Factor:
        if mapping not in GROUPINGS:
            raise ValueError(f"unknown grouping {mapping}; there are {sorted(GROUPINGS)}")
        return self.group_map(GROUPINGS[mapping], f"group({mapping})")

    def regression_neut(self, *regressors: Factor) -> Factor:
        """Cross-sectional residuals on any number of regressors, with intercept."""
        name = f"regression_neut({self.name},[{','.join(f.name for f in regressors)}])"
        if not regressors:
            return self._op("null", (), NONE, lambda x: F.lit(None).cast("double"), name)
        if len(regressors) == 1:
            return self._op("regression_neut", (), BY_TS, cross.regression_neut, name, regressors[0])
        from panelith.operators.linear import neutralize_many

        return neutralize_many(self, regressors, name)

    def ts_regression(self, regressors: Factor | list[Factor], w: int, lag: int = 0, rettype: int = 0) -> Factor:
        xs = [regressors] if isinstance(regressors, Factor) else list(regressors)
        name = f"ts_regression({self.name},{','.join(f.name for f in xs)},{w},lag={lag},rettype={rettype})"
        if not xs:
            return self._op("null", (), NONE, lambda x: F.lit(None).cast("double"), name)
        if len(xs) == 1:
            return self._op("ts_regression", (w, lag, rettype), BY_SYMBOL, lambda y, x: rolling.regression(y, x, w, lag, rettype), name, xs[0])
        from panelith.operators.linear import regress_many

        return regress_many(self, xs, w, lag, rettype, name)


#: Built-in groupings (fixed values).
GROUPINGS = {
    "SECTOR_L1_L2": {"ETH": 1.0, "SOL": 1.0, "SUI": 1.0, "ARB": 2.0, "OP": 2.0, "POL": 2.0},
    "DAPP_ACTIVITY": {"POL": 1.0, "ETH": 1.0, "ARB": 1.0, "OP": 1.0, "SUI": 2.0, "SOL": 2.0},
}


def _text(p) -> str:
    return str(p) if isinstance(p, (bool, str)) else num(p)


def _bound(name: str, defaults: tuple, args: tuple, kwargs: dict) -> dict:
    """The parameters by name; surplus, unknown and repeated ones are errors."""
    values, given = dict(defaults), dict(zip(dict(defaults), args))
    if len(args) > len(values):
        raise TypeError(f"{name} takes {len(values)} parameters, not {len(args)}")
    if wrong := [k for k in kwargs if k not in values or k in given]:
        raise TypeError(f"{name} got {wrong[0]} twice or does not know it")
    return {**values, **given, **kwargs}


def _unary(name: str, function, needs: str, label: str, *defaults: tuple[str, object]):
    """A method for ``function(x, *params)``; ``label`` formats the derived name from n (own name) and the parameters."""

    def method(self: Factor, *args, **kwargs) -> Factor:
        values = _bound(name, defaults, args, kwargs)
        if missing := [k for k, v in values.items() if v is REQUIRED]:
            raise TypeError(f"{name} needs {missing[0]}")
        function(F.lit(1.0), **values)  # bad parameters fail here, not when the plan runs
        return self._op(name, tuple(values.items()), needs, lambda x: function(x, **values), label.format(n=self.name, **{k: _text(v) for k, v in values.items() if v is not None}))

    method.__name__, method.__doc__ = name, function.__doc__
    setattr(Factor, name, method)


def _binary(name: str, function, label: str, needs: str = NONE, *defaults: tuple[str, object]):
    """A method for ``function(x, y, *params)``, y a factor or, for element-wise functions, a number."""

    def method(self: Factor, other, *args, **kwargs) -> Factor:
        values = _bound(name, defaults, args, kwargs)
        shown = other.name if isinstance(other, Factor) else num(other)
        title = label.format(n=self.name, o=shown, **{k: _text(v) for k, v in values.items()})
        if isinstance(other, Factor):
            return self._op(name, tuple(values.items()), needs, lambda x, y: function(x, y, **values), title, other)
        if needs != NONE:
            raise TypeError(f"{name} needs a factor")
        return self._op(name, (("value", float(other)), *values.items()), needs, lambda x: function(x, float(other), **values), title)

    method.__name__, method.__doc__ = name, function.__doc__
    setattr(Factor, name, method)


REQUIRED = object()
W = ("w", REQUIRED)

for _name, _function, _label, *_defaults in (
    ("abs", F.abs, "abs({n})"),
    ("sign", elementwise.sign, "sign({n})"),
    ("inverse", elementwise.inverse, "inverse({n})"),
    ("ln", elementwise.log, "log({n})"),
    ("sqrt", elementwise.sqrt, "sqrt({n})"),
    ("s_log_1p", elementwise.signed_log, "s_log_1p({n})"),
    ("reverse", lambda x: x * -1.0, "({n}*-1)"),
):
    _unary(_name, _function, NONE, _label, *_defaults)


def _log(self: Factor, base: float | None = None) -> Factor:
    """Logarithm, natural or to ``base``; NULL where the value is not positive."""
    elementwise.log(F.lit(1.0), base)
    return self._op("log", (base,), NONE, lambda x: elementwise.log(x, base), f"log({self.name})" if base is None else f"log({self.name},base={num(base)})")


Factor.log = _log

for _name, _function, _label in (
    ("add", elementwise.add, "({n}+{o})"),
    ("subtract", elementwise.subtract, "({n}-{o})"),
    ("multiply", elementwise.multiply, "({n}*{o})"),
    ("divide", elementwise.divide, "({n}/{o})"),
    ("power", elementwise.power, "({n}**{o})"),
    ("signed_power", elementwise.signed_power, "signed_power({n},{o})"),
    ("maximum", elementwise.maximum, "max({n},{o})"),
    ("minimum", elementwise.minimum, "min({n},{o})"),
    ("lt", elementwise.lt, "({n}<{o})"),
    ("le", elementwise.le, "({n}<={o})"),
    ("gt", elementwise.gt, "({n}>{o})"),
    ("ge", elementwise.ge, "({n}>={o})"),
    ("eq_val", elementwise.eq, "({n}=={o})"),
    ("ne_val", elementwise.ne, "({n}!={o})"),
):
    _binary(_name, _function, _label)

for _name, _function, _label, *_defaults in (
    ("rank", cross.rank, "rank({n})"),
    ("cs_mean", cross.mean, "mean({n})"),
    ("cs_median", cross.median, "median({n})"),
    ("normalize", cross.normalize, "normalize({n},use_std={use_std},limit={limit})", ("use_std", False), ("limit", 0.0)),
    ("zscore", cross.zscore, "zscore({n})"),
    ("quantile", cross.quantile, "quantile({n},driver={driver},sigma={sigma})", ("driver", "gaussian"), ("sigma", 1.0)),
    ("spread", cross.spread, "spread({n},{pct})", ("pct", REQUIRED)),
    ("signal", cross.signal, "signal({n})"),
):
    _unary(_name, _function, BY_TS, _label, *_defaults)


def _scale(self: Factor, scale: float = 1.0, long_scale: float | None = None, short_scale: float | None = None) -> Factor:
    parts = [f"scale={num(scale)}"] + ([f"longscale={num(long_scale)}"] if long_scale is not None else []) + ([f"shortscale={num(short_scale)}"] if short_scale is not None else [])
    return self._op("scale", (scale, long_scale, short_scale), BY_TS, lambda x: cross.scale(x, scale, long_scale, short_scale), f"scale({self.name},{','.join(parts)})")


_scale.__doc__ = cross.scale.__doc__
Factor.scale = _scale
_binary("vector_neut", cross.vector_neut, "vector_neut({n},{o})", BY_TS)
for _name in ("neutralize", "mean", "median", "rank", "scale", "zscore"):
    _binary(f"group_{_name}", getattr(cross, f"group_{_name}"), f"group_{_name}({{n}},{{o}})", BY_TS)
_binary("group_normalize", cross.group_normalize, "group_normalize({n},{o},{scale})", BY_TS, ("scale", 1.0))

for _name, _function, _label, *_defaults in (
    ("delay", rolling.delay, "({n},{w})", W),
    ("delta", rolling.delta, "({n},{w})", W),
    ("step", rolling.step, "({start})", ("start", 0)),
    ("sum", rolling.total, "({n},{w})", W),
    ("product", rolling.product, "({n},{w})", W),
    ("mean", rolling.mean, "({n},{w})", W),
    ("median", rolling.median, "({n},{w})", W),
    ("std_dev", rolling.std_dev, "({n},{w})", W),
    ("min", rolling.minimum, "({n},{w})", W),
    ("max", rolling.maximum, "({n},{w})", W),
    ("arg_max", rolling.arg_max, "({n},{w})", W),
    ("arg_min", rolling.arg_min, "({n},{w})", W),
    ("count_nans", rolling.count_nans, "({n},{w})", W),
    ("av_diff", rolling.av_diff, "({n},{w})", W),
    ("rank", rolling.rank, "({n},{w})", W),
    ("scale", rolling.scale, "({n},{w},{constant})", W, ("constant", 0.0)),
    ("zscore", rolling.zscore, "({n},{w})", W),
    ("quantile", rolling.quantile, "({n},{w},{driver})", W, ("driver", "gaussian")),
    ("kurtosis", rolling.kurtosis, "({n},{w})", W),
    ("skewness", rolling.skewness, "({n},{w})", W),
    ("backfill", rolling.backfill, "({n},{w},{k})", W, ("k", 1)),
    ("decay_exp_window", rolling.decay_exp_window, "({n},{w},{factor},{nan})", W, ("factor", 0.5), ("nan", True)),
    ("decay_linear", rolling.decay_linear, "({n},{w},dense={dense})", W, ("dense", False)),
    ("autocorr", rolling.autocorr, "({n},{w},{lag})", W, ("lag", 1)),
    ("cv", rolling.cv, "({n},{w})", W),
    ("jumpiness", rolling.jumpiness, "({n},{w})", W),
    ("trend_strength", rolling.trend_strength, "({n},{w})", W),
    ("vr", rolling.vr, "({n},{w},{k})", W, ("k", 2)),
    ("reversal_count", rolling.reversal_count, "({n},{w})", W),
):
    _unary(f"ts_{_name}", _function, BY_SYMBOL, f"ts_{_name}{_label}", *_defaults)
_binary("ts_corr", rolling.corr, "ts_corr({n},{o},{w})", BY_SYMBOL, W)
_binary("ts_covariance", rolling.covariance, "ts_covariance({n},{o},{w})", BY_SYMBOL, W)


def align(*factors: Factor) -> tuple[Factor, ...]:
    """The factors on the grid that all share: an inner join on (ts, symbol)."""
    panels: dict[int, list[int]] = {}
    for i, f in enumerate(factors):
        panels.setdefault(id(f.panel), []).append(i)
    frames = [factors[ids[0]].panel.compute(**{f"f{i}": factors[i] for i in ids}) for ids in panels.values()]
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.join(frame, [TS, SYMBOL])
    grid = Panel(joined, [f"f{i}" for i in range(len(factors))])
    return tuple(grid.factor(f"f{i}").rename(f.name) for i, f in enumerate(factors))


def compile_factors(panel: Panel, factors: dict[str, Factor]) -> DataFrame:
    """One DataFrame with a column for each factor; equal subexpressions become one column."""
    order: dict[tuple, Factor] = {}

    def visit(f: Factor) -> None:
        if f.panel is not panel:
            raise ValueError("factors of other panels have to be aligned first")
        if f.key not in order:
            for i in f.inputs:
                visit(i)
            order[f.key] = f

    for f in factors.values():
        visit(f)
    done: dict[tuple, str] = {}
    for key, f in order.items():
        if key[0] == "column":
            done[key] = f"_n{len(done)}"
    left = [f for f in order.values() if f.key not in done]
    df = panel.frame.select(TS, SYMBOL, *[F.col(k[1]).alias(c) for k, c in done.items()])
    side, kept = None, Kept()
    while left:
        ready = [f for f in left if all(i.key in done for i in f.inputs)]
        # Element-wise nodes first, then those of the partitioning at hand, then change it.
        stage = [f for f in ready if f.needs == NONE] or [f for f in ready if f.needs == side]
        if not stage:
            side = max((BY_SYMBOL, BY_TS), key=lambda s: sum(f.needs == s for f in ready))
            stage = [f for f in ready if f.needs == side]
        new = {f.key: f"_n{len(done) + i}" for i, f in enumerate(stage)}
        token = KEPT.set(kept)
        try:
            built = {new[f.key]: f.build(*[F.col(done[i.key]) for i in f.inputs]) for f in stage}
        finally:
            KEPT.reset(token)
        for step in [*kept.take(), built]:
            df = df.withColumns(step)
        done.update(new)
        left = [f for f in left if f.key not in done]
    return df.select(TS, SYMBOL, *[F.col(done[f.key]).alias(c) for c, f in factors.items()])
