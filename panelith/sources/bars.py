"""Market data: bar sources, derived columns, and alignment to a panel.

A bar source is any DataFrame (symbol, ts, open, high, low, close, volume). Fetching over a network is
not part of the engine: land the bars as files and read them here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelith.functions.base import SYMBOL, TS
from panelith.plans.panel import Panel

OHLCV = ("open", "high", "low", "close", "volume")
#: Interval names and their lengths; 1M is a calendar month (fixed values).
TIMEFRAMES = {
    "1s": "1 second", "1m": "1 minute", "3m": "3 minutes", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes",
    "1h": "1 hour", "2h": "2 hours", "4h": "4 hours", "6h": "6 hours", "8h": "8 hours", "12h": "12 hours",
    "1d": "1 day", "3d": "3 days", "1w": "7 days", "1M": "1 month",
}
#: Symbols that were renamed: new name, old name, first day of the new one (fixed values).
RENAMES = {"POL": ("MATIC", "2024-09-01")}


def step(timeframe: str):
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe}; there are {list(TIMEFRAMES)}")
    return F.expr(f"INTERVAL {TIMEFRAMES[timeframe]}")


def is_intraday(timeframe: str) -> bool:
    step(timeframe)
    return timeframe[-1] in "smh"


def read_bars(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Bars with open_time in epoch milliseconds and numbers as text or doubles; a malformed number fails."""
    raw = spark.read.csv(path, header=True) if format == "csv" else spark.read.format(format).load(path)
    return raw.select(F.col(SYMBOL).cast("string").alias(SYMBOL), F.timestamp_millis(F.col("open_time").cast("long")).alias(TS), *[F.col(c).cast("double").alias(c) for c in OHLCV])


def parse_klines(df: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, json) rows, each an array [open_time, open, high, low, close, volume, ...], as bars."""
    item = F.from_json(column, "array<string>", {"mode": "FAILFAST"})
    rows = df.select(SYMBOL, item.alias("k"))
    return rows.select(SYMBOL, F.timestamp_millis(F.element_at("k", 1).cast("long")).alias(TS), *[F.element_at("k", i + 2).cast("double").alias(c) for i, c in enumerate(OHLCV)])


def between(bars: DataFrame, start=None, end=None) -> DataFrame:
    """The closed interval; it reaches the scan as a pushed filter."""
    if start is not None:
        bars = bars.where(F.col(TS) >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col(TS) <= F.lit(end).cast("timestamp"))
    return bars


def _grid(keys: DataFrame, low: str, high: str, timeframe: str) -> DataFrame:
    return keys.withColumn(TS, F.explode(F.sequence(low, high, step(timeframe)))).drop(low, high)


def splice_rename(old: DataFrame, new: DataFrame, old_symbol: str, new_symbol: str, timeframe: str) -> DataFrame:
    """Old and new bars under the new symbol, whose gaps are filled: prices carried forward, volume 0.

    Where both have a cell the new one counts.
    """
    named = old.withColumn(SYMBOL, F.when(F.col(SYMBOL) == old_symbol, new_symbol).otherwise(F.col(SYMBOL))).withColumn("_n", F.lit(0))
    both = named.unionByName(new.withColumn("_n", F.lit(1)))
    columns = [c for c in old.columns if c not in (SYMBOL, TS)]
    both = both.groupBy(SYMBOL, TS).agg(*[F.max_by(c, "_n").alias(c) for c in columns])
    renamed, others = both.where(F.col(SYMBOL) == new_symbol), both.where(F.col(SYMBOL) != new_symbol)
    span = renamed.groupBy(SYMBOL).agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"))
    every = _grid(span, "lo", "hi", timeframe).unionByName(renamed.select(SYMBOL, TS)).distinct().join(renamed, [SYMBOL, TS], "left")
    so_far = Window.partitionBy(SYMBOL).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    filled = every.select(SYMBOL, TS, *[(F.coalesce(c, F.lit(0.0)) if c == "volume" else F.last(c, ignorenulls=True).over(so_far)).alias(c) for c in columns])
    return others.select(SYMBOL, TS, *columns).unionByName(filled)


def with_renames(bars: DataFrame, symbols: list[str], timeframe: str, start=None) -> DataFrame:
    """The wanted symbols' bars; one that was renamed is spliced with its old name's."""
    wanted = bars.where(F.col(SYMBOL).isin(*symbols))
    for new_symbol, (old_symbol, cutoff) in RENAMES.items():
        if new_symbol in symbols and (start is None or str(start) < cutoff):
            at = F.lit(cutoff).cast("timestamp")
            old = bars.where((F.col(TS) < at) & F.col(SYMBOL).isin(old_symbol, *[s for s in symbols if s != new_symbol]))
            return splice_rename(old, wanted.where(F.col(TS) >= at), old_symbol, new_symbol, timeframe)
    return wanted


def benchmark(bars: DataFrame, symbols: list[str], bases: tuple[str, ...] = ("BTC", "ETH")) -> DataFrame:
    """(symbol, ts, BTC_close, ETH_close): the base symbols' closes for every symbol."""
    spark = bars.sparkSession
    closes = bars.where(F.col(SYMBOL).isin(*bases)).groupBy(TS).agg(*[F.max(F.when(F.col(SYMBOL) == b, F.col("close"))).alias(f"{b}_close") for b in bases])
    names = spark.createDataFrame([(s,) for s in symbols], f"{SYMBOL} string")
    return closes.crossJoin(F.broadcast(names)).select(SYMBOL, TS, *[f"{b}_close" for b in bases])  # the caller's list of symbols


def calendar(spark: SparkSession, symbols: list[str], timeframe: str, start: str, end: str) -> DataFrame:
    """(symbol, ts, year, month, day, dayofweek from Monday 1, dayofmonth_position by tens, is_week_end)."""
    if start is None or end is None:
        raise ValueError("a calendar needs a start and an end")
    times = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), step(timeframe))).alias(TS))
    names = spark.createDataFrame([(s,) for s in symbols], f"{SYMBOL} string")
    as_double = lambda e, n: e.cast("double").alias(n)
    return times.crossJoin(F.broadcast(names)).select(
        SYMBOL, TS, as_double(F.year(TS), "year"), as_double(F.month(TS), "month"), as_double(F.dayofmonth(TS), "day"), as_double(F.weekday(TS) + 1, "dayofweek"),
        as_double(1 + F.floor((F.dayofmonth(TS) - 1) / 10), "dayofmonth_position"), as_double((F.weekday(TS) >= 5).cast("int"), "is_week_end"),
    )


def vwap(bars: DataFrame, timeframe: str) -> DataFrame:
    """(symbol, ts, vwap) of the typical price: by day from hourly bars, else running within each UTC day."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    day = F.date_trunc("day", TS)
    if timeframe == "1d":
        return bars.groupBy(SYMBOL, day.alias(TS)).agg(F.try_divide(F.sum(typical), F.sum("volume")).alias("vwap"))
    so_far = Window.partitionBy(SYMBOL, day).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    return bars.select(SYMBOL, TS, F.try_divide(F.sum(typical).over(so_far), F.sum("volume").over(so_far)).alias("vwap"))


def merge(sources: list[DataFrame]) -> DataFrame:
    """Outer join of sources on (symbol, ts); of columns that several have, the first source's value counts."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns and c not in (SYMBOL, TS)]
        b = b.withColumnsRenamed({c: f"_{c}" for c in shared})
        return a.join(b, [SYMBOL, TS], "full").withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared])

    return reduce(join, sources)


#: Names of the sources that ``fetch`` takes (fixed values).
SOURCES = ("ohlcv", "benchmark", "calendar", "vwap")


def parse_source(name: str) -> str:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {list(SOURCES)}")
    return name


def fetch(bars: DataFrame, symbols: list[str], timeframe: str, sources: list[str], start=None, end=None, hourly: DataFrame | None = None, bases: tuple[str, ...] = ("BTC", "ETH")) -> Panel:
    """The named sources in the given order, merged on (symbol, ts) and aligned; the first value of a cell counts.

    ``bars`` are all symbols' bars of the timeframe, ``hourly`` those that a daily vwap is made of. After
    ``ohlcv`` the others end with the day of its last bar, at midnight.
    """
    step(timeframe)
    parts = []
    for name in map(parse_source, sources):
        if name == "ohlcv":
            part = between(with_renames(bars, symbols, timeframe, start), start, end).select(SYMBOL, TS, *OHLCV)
            last = part.agg(F.date_trunc("day", F.max(TS)).alias("t")).first()["t"]
            end = last if last is not None else end
        elif name == "benchmark":
            part = between(benchmark(bars, symbols, bases), start, end)
        elif name == "calendar":
            part = calendar(bars.sparkSession, symbols, timeframe, start, end)
        else:
            part = between(vwap((hourly if hourly is not None else bars).where(F.col(SYMBOL).isin(*symbols)), timeframe), start, end)
        parts.append(part)
    return to_panel(merge(parts), symbols, timeframe)


def parse_symbols(df: DataFrame, column: str = "json") -> DataFrame:
    """(symbol) of market lists, each an object {"symbols": [{"symbol": ...}, ...]}, once each."""
    item = F.from_json(column, "struct<symbols: array<struct<symbol: string>>>", {"mode": "FAILFAST"})
    return df.select(F.explode(item["symbols"]["symbol"]).alias(SYMBOL)).where(F.col(SYMBOL).isNotNull()).distinct()


def to_panel(frame: DataFrame, symbols: list[str], timeframe: str) -> Panel:
    """The wanted symbols on a regular grid, missing cells carried forward.

    The grid begins where every symbol has had a first close, and ends with the last cell of all.
    """
    if "close" not in frame.columns:
        raise ValueError("alignment needs the column close")
    columns = [c for c in frame.columns if c not in (SYMBOL, TS)]
    clean = frame.select(SYMBOL, TS, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    first = clean.where("close is not null").groupBy(SYMBOL).agg(F.min(TS).alias("t")).agg(F.max("t").alias("lo"))
    span = first.crossJoin(clean.agg(F.max(TS).alias("hi"))).where("lo <= hi")  # one row
    wanted = clean.where(F.col(SYMBOL).isin(*symbols))
    spine = _grid(wanted.select(SYMBOL).distinct().crossJoin(F.broadcast(span)), "lo", "hi", timeframe)
    so_far = Window.partitionBy(SYMBOL).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    filled = spine.join(wanted, [SYMBOL, TS], "left").select(TS, SYMBOL, *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns])
    return Panel(filled, columns)
