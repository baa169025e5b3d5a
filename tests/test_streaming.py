"""Bars of a stream equal the bars of the same rows at rest."""

from pyspark.sql import functions as F

from panelith.sources.bars import to_panel
from panelith.streaming.bars import windowed_bars


def test_closed_windows_come_out_once(spark, tmp_path):
    rows = [("A", f"2024-01-01 {h:02d}:{m:02d}:00", float(h + m), 1.0 + m) for h in range(6) for m in (5, 20, 50)]
    ticks = spark.createDataFrame(rows, "symbol string, t string, price double, size double").select("symbol", F.to_timestamp("t").alias("ts"), "price", "size")
    source = str(tmp_path / "ticks")
    ticks.coalesce(1).write.parquet(source)
    stream = windowed_bars(spark.readStream.schema(ticks.schema).parquet(source), "1h", "30 minutes")
    out = str(tmp_path / "bars")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r.ts: tuple(r) for r in spark.read.parquet(out).collect()}
    rest = {r.ts: tuple(r) for r in windowed_bars(ticks, "1h").collect()}
    assert len(got) == 5  # the last hour is still open
    assert all(rest[t] == r for t, r in got.items())
    assert len(to_panel(spark.read.parquet(out), ["A"], "1h")) == 5
