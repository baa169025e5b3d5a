"""Bars from a stream: windowed open, high, low, close, volume and vwap, ready for a panel.

Late events are taken up to the watermark; a window comes out once, when it is closed. The bars land
in files by ``write_bars`` and are read as any other bar source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelith.functions.base import SYMBOL, TS
from panelith.sources.bars import TIMEFRAMES, step


def windowed_bars(ticks: DataFrame, timeframe: str = "1h", late: str = "2 hours") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, vwap) of ticks (symbol, ts, price, size), streaming or not."""
    step(timeframe)
    if timeframe == "1M":
        raise ValueError("a stream has no calendar windows")
    window = F.window(TS, TIMEFRAMES[timeframe])
    rows = ticks.withWatermark(TS, late).groupBy(SYMBOL, window.alias("w")).agg(
        F.min_by("price", TS).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", TS).alias("close"),
        F.sum("size").alias("volume"),
        F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
    )
    return rows.select(SYMBOL, F.col("w.start").alias(TS), "open", "high", "low", "close", "volume", "vwap")


def write_bars(bars: DataFrame, path: str, checkpoint: str, interval: str = "1 minute"):
    """Starts the query that appends closed bars to Parquet files, exactly once per bar."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
