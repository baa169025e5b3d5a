"""The panels that the registered queries run on, and the SQL that builds the same grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.functions.base import SYMBOL, TS
from panelith.plans.panel import Factor, Panel

def _kept(rows: DataFrame) -> DataFrame:
    """The aggregated rows, kept: a grid reads them three times. They are counted at once, so that plans know their size."""
    rows = rows.persist()
    rows.count()
    return rows


_exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")  # noqa: E731  the same whatever the order


def events_hourly(spark: SparkSession, sf: str) -> Panel:
    """Hour x event type: x the total value, y the number of events, d = x - 100. Has holes."""
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias(TS), F.col("event_type").alias(SYMBOL)).agg(_exact("value").alias("x"), F.count("*").cast("double").alias("y"))
    return Panel.from_frame(_kept(rows.withColumn("d", F.col("x") - 100.0)))


def _shipped(spark: SparkSession, sf: str, symbol: str, unit: str = "month") -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.date_trunc(unit, "l_shipdate").alias(TS))
    if symbol != "l_suppkey":
        items = items.join(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", symbol), F.col("l_partkey") == F.col("p_partkey"))
    return items.groupBy(TS, F.col(symbol).cast("string").alias(SYMBOL)).agg((_exact("l_extendedprice") / _exact("l_quantity")).alias("price"), _exact("l_quantity").alias("volume"))


def brand_monthly(spark: SparkSession, sf: str) -> Panel:
    """Month x brand: mean price and volume shipped."""
    return Panel.from_frame(_kept(_shipped(spark, sf, "p_brand")))


def type_monthly(spark: SparkSession, sf: str) -> Panel:
    return Panel.from_frame(_kept(_shipped(spark, sf, "p_type")))


def supplier_daily(spark: SparkSession, sf: str) -> Panel:
    return Panel.from_frame(_kept(_shipped(spark, sf, "l_suppkey", "day")))


def orders_monthly(spark: SparkSession, sf: str) -> Panel:
    """Month x priority: total price and number of orders."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.date_trunc("month", "o_orderdate").alias(TS), F.col("o_orderpriority").alias(SYMBOL)).agg(_exact("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"))
    return Panel.from_frame(_kept(rows))


#: Added before rounding, so that exact halves, which the engines reach a last bit apart, are no ties.
NUDGE = 1.7e-8


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps as text and doubles rounded, so that two engines print the same."""
    out = []
    for c, kind in df.dtypes:
        e = F.col(c)
        if kind.startswith("timestamp"):
            e = F.date_format(e, "yyyy-MM-dd HH:mm:ss")
        elif kind == "double":
            e = F.round(e + NUDGE, digits) + 0.0
        elif kind == "int":
            e = e.cast("long")
        out.append(e.alias(c))
    return df.select(*out)


def answer(factor: Factor, digits: int = 6) -> DataFrame:
    return shown(factor.frame("v"), digits)


# The same grids in SQL; i numbers the grid rows of a symbol from 1.
_GRID = """g0 AS (SELECT t.ts, s.symbol, {cols} FROM (SELECT DISTINCT ts FROM raw) t CROSS JOIN (SELECT DISTINCT symbol FROM raw) s LEFT JOIN raw r ON r.ts = t.ts AND r.symbol = s.symbol),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM g0)"""

EVENTS_SQL = "raw AS (SELECT date_trunc('hour', ts) AS ts, event_type AS symbol, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2),\n" + _GRID.format(cols="r.x, r.y, r.x - 100.0 AS d")


def _shipped_sql(symbol: str, unit: str = "month") -> str:
    price = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS volume"
    join = "JOIN part ON l_partkey = p_partkey" if symbol != "l_suppkey" else ""
    return f"raw AS (SELECT date_trunc('{unit}', l_shipdate) AS ts, CAST({symbol} AS VARCHAR) AS symbol, {price} FROM lineitem {join} GROUP BY 1, 2),\n" + _GRID.format(cols="r.price, r.volume")


BRAND_SQL, TYPE_SQL = _shipped_sql("p_brand"), _shipped_sql("p_type")
SUPPLIER_SQL = _shipped_sql("l_suppkey", "day")
ORDERS_SQL = "raw AS (SELECT date_trunc('month', o_orderdate) AS ts, o_orderpriority AS symbol, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),\n" + _GRID.format(cols="r.total, r.n")

SHOW_TS = "strftime({}ts, '%Y-%m-%d %H:%M:%S') AS ts"


def rounded(e: str, digits: int = 6) -> str:
    return f"round({e} + {NUDGE}, {digits}) + 0.0"


def cell_sql(e: str, base: str = EVENTS_SQL, more: str = "", source: str = "n") -> str:
    """One value for each cell, from an expression over the grid's columns."""
    return f"WITH {base}{more}\nSELECT {SHOW_TS.format('')}, symbol, {rounded(e)} AS v FROM {source}"


def cross_sql(e: str, aggregates: str, base: str = EVENTS_SQL, group: str = "ts") -> str:
    """An expression over a cell and its period's aggregates."""
    keys = group.split(", ")
    on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)
    more = f",\na AS (SELECT {group}, {aggregates} FROM n GROUP BY {group})"
    return f"WITH {base}{more}\nSELECT {SHOW_TS.format('n.')}, n.symbol, {rounded(e)} AS v FROM n JOIN a ON {on}"


def window_step(name: str, w: int, e: str, source: str = "n", keep: str = "x, y, d") -> str:
    """A table with column ``name`` added: ``e`` aggregates b over the last w rows of a."""
    kept = ", ".join(f"a.{c.strip()}" for c in ("ts, symbol, i, " + keep).split(","))
    return f"SELECT {kept}, {e} AS {name} FROM {source} a JOIN {source} b ON b.symbol = a.symbol AND b.i BETWEEN a.i - {w - 1} AND a.i GROUP BY {kept}"


def rolling_sql(w: int, e: str, base: str = EVENTS_SQL, keep: str = "x, y, d") -> str:
    return cell_sql("v", base, f",\nt AS ({window_step('v', w, e, keep=keep)})", "t")
