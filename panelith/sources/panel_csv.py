"""Panels from and to CSV: columns timestamp and symbol, every other column a number, missing cells empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith import report
from panelith.functions.base import SYMBOL, TS
from panelith.plans.panel import Factor, Panel


def read_panel(spark: SparkSession, path: str, timestamps: str = "string") -> Panel:
    """A field that is no number is missing; a row with another number of fields fails the read.

    Of rows that repeat a key the last by file position wins. ``timestamps`` may be timestamp or date.
    """
    raw = spark.read.option("header", True).option("quote", "").option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    names = [c.strip() for c in raw.columns]
    raw = raw.toDF(*names)
    if "timestamp" not in names or SYMBOL not in names:
        raise ValueError("a panel file needs the columns timestamp and symbol")
    columns = [c for c in names if c not in ("timestamp", SYMBOL)]
    value = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)").alias(c)
    rows = raw.withColumn("_n", F.monotonically_increasing_id()).select(F.trim("timestamp").cast(timestamps).alias(TS), F.trim(SYMBOL).alias(SYMBOL), "_n", *map(value, columns))
    return Panel.from_frame(rows, columns=columns, ordinal="_n")


def _rows(panel: Panel) -> DataFrame:
    return panel.frame.select(F.col(TS).alias("timestamp"), SYMBOL, *panel.columns)


def write_panel(panel: Panel, path: str) -> None:
    """A folder of CSV files in (timestamp, symbol) order, overwritten."""
    _rows(panel).orderBy("timestamp", SYMBOL).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_factor(factor: Factor, path: str) -> None:
    factor.records().write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def _text(v) -> str:
    return "" if v is None else (str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v))


def to_csv_string(data: Panel | Factor, limit: int = 100_000) -> str:
    """A small panel or factor as one text; more than ``limit`` rows fail rather than flood the driver."""
    df = data.records() if isinstance(data, Factor) else _rows(data).orderBy("timestamp", SYMBOL)
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write files instead")
    return "\n".join([",".join(df.columns), *(",".join(_text(v) for v in r) for r in rows)]) + "\n"


def show(factor: Factor, max_rows: int = 20) -> str:
    """The first and last periods as a table, one column for each symbol."""
    df = factor.frame("v")
    times = df.select(TS).distinct()
    n = times.count()
    half = max_rows // 2
    head = [r[TS] for r in times.orderBy(TS).limit(n if n <= max_rows else half).collect()]
    tail = [] if n <= max_rows else [r[TS] for r in times.orderBy(F.desc(TS)).limit(half).collect()][::-1]
    chosen = [*head, *tail]
    rows = df.where(F.col(TS).isin(*chosen)).groupBy(TS).pivot(SYMBOL).agg(F.first("v")).orderBy(TS).collect() if chosen else []
    symbols = list(rows[0].__fields__[1:]) if rows else []
    return report.factor_table(str(factor), symbols, [(r[0], r[1:]) for r in rows], len(head) if tail else None)
