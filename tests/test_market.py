"""Bars, calendars, alignment and rebalancing plans."""

import pytest
from pyspark.sql import functions as F

from panelith.operators import rebalance as rb
from panelith.sources import bars as md


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t string, close double, volume double").select("symbol", F.to_timestamp("t").alias("ts"), "close", "volume")


def test_alignment_starts_with_the_last_listing_and_carries_forward(spark):
    rows = [("A", "2024-01-01", 1.0, 5.0), ("A", "2024-01-02", 2.0, 6.0), ("A", "2024-01-04", 4.0, 7.0), ("B", "2024-01-02", 9.0, 1.0), ("B", "2024-01-04", float("nan"), 2.0), ("C", "2024-01-05", None, 1.0)]
    p = md.to_panel(bars(spark, rows), ["A", "B", "Z"], "1d")
    got = [(str(r.ts)[:10], r.symbol, r.close, r.volume) for r in p.records().collect()]
    assert got == [
        ("2024-01-02", "A", 2.0, 6.0), ("2024-01-02", "B", 9.0, 1.0), ("2024-01-03", "A", 2.0, 6.0), ("2024-01-03", "B", 9.0, 1.0),
        ("2024-01-04", "A", 4.0, 7.0), ("2024-01-04", "B", 9.0, 2.0), ("2024-01-05", "A", 4.0, 7.0), ("2024-01-05", "B", 9.0, 2.0),
    ]
    with pytest.raises(ValueError):
        md.to_panel(bars(spark, rows).drop("close"), ["A"], "1d")


def test_renamed_symbols_are_spliced(spark):
    rows = [("MATIC", "2024-08-29", 1.0, 5.0), ("MATIC", "2024-08-31", 2.0, 6.0), ("POL", "2024-09-02", 3.0, 7.0), ("X", "2024-08-30", 8.0, 1.0)]
    got = {(r.symbol, str(r.ts)[:10]): (r.close, r.volume) for r in md.with_renames(bars(spark, rows), ["POL", "X"], "1d").collect()}
    assert got == {("POL", "2024-08-29"): (1.0, 5.0), ("POL", "2024-08-30"): (1.0, 0.0), ("POL", "2024-08-31"): (2.0, 6.0), ("POL", "2024-09-01"): (2.0, 0.0), ("POL", "2024-09-02"): (3.0, 7.0), ("X", "2024-08-30"): (8.0, 1.0)}


def test_calendar_and_timeframes(spark):
    rows = {str(r.ts)[:10]: r for r in md.calendar(spark, ["A"], "1d", "2024-01-29", "2024-02-03").collect()}
    assert (rows["2024-01-31"].dayofmonth_position, rows["2024-02-03"].is_week_end, rows["2024-01-29"].dayofweek) == (4.0, 1.0, 1.0)
    assert len(md.TIMEFRAMES) == 16
    assert md.is_intraday("4h")
    assert not md.is_intraday("1M")
    for bad in ("2d", "1H"):
        with pytest.raises(ValueError):
            md.step(bad)
    assert md.calendar(spark, ["A"], "1M", "2024-01-31", "2024-04-30").count() == 4


def test_klines_are_parsed_strictly(spark):
    rows = [("A", '[1704067200000, "1", "2", "0.5", "1.5", "10", 0, "x"]')]
    r = md.parse_klines(spark.createDataFrame(rows, "symbol string, json string")).first()
    assert (str(r.ts), r.open, r.high, r.low, r.close, r.volume) == ("2024-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5, 10.0)
    with pytest.raises(Exception):
        md.parse_klines(spark.createDataFrame([("A", "[1,")], "symbol string, json string")).collect()
    path_rows = [("A", 1704067200000, "1", "2", "0.5", "1.5", "10")]
    assert spark.createDataFrame(path_rows, "symbol string, open_time long, open string, high string, low string, close string, volume string").count() == 1


def test_first_source_wins(spark):
    a, b = bars(spark, [("A", "2024-01-01", 1.0, 1.0), ("A", "2024-01-02", None, 1.0)]), bars(spark, [("A", "2024-01-01", 9.0, 9.0), ("A", "2024-01-02", 8.0, 9.0), ("B", "2024-01-01", 7.0, 9.0)])
    got = {(r.symbol, str(r.ts)[:10]): (r.close, r.volume) for r in md.merge([a.drop("volume"), b]).collect()}
    assert got == {("A", "2024-01-01"): (1.0, 9.0), ("A", "2024-01-02"): (8.0, 9.0), ("B", "2024-01-01"): (7.0, 9.0)}


def test_plans(spark):
    positions = rb.positions_from(spark.createDataFrame([("B-USDT-SWAP", "-3", "200"), ("C-USDT-SWAP", "1", "50"), ("D-USDT-SWAP", "1", "0.001"), ("E-USD-SWAP", "1", "5"), ("F-USDT-SWAP", "2", "100.5"), ("G-USDT-SWAP", "0", "9")], "instId string, pos string, notionalUsd string"))
    assert {(r.symbol, r.current_usd) for r in positions.collect()} == {("B", -200.0), ("C", 50.0), ("F", 100.5)}
    weights = spark.createDataFrame([("A", 0.3), ("B", 0.2), ("F", 0.1)], "symbol string, weight double")
    specs = spark.createDataFrame([(f"{s}-USDT-SWAP", "live", 0.1, 0.0, 1.0, 1.0, 1000.0, 10.0) for s in "ABC"], "inst_id string, state string, ct_val double, ct_mult double, lot_sz double, min_sz double, max_mkt_sz double, price double")
    legs = {r.symbol: r for r in rb.plan(weights, positions, 1000.0, specs).collect()}
    assert {s: r.action for s, r in legs.items()} == {"A": "open", "B": "flip", "C": "close", "F": "skip"}
    assert (legs["A"].side, legs["A"].contracts, legs["A"].order_usd) == ("buy", 300.0, 300.0)
    assert (legs["B"].contracts, legs["B"].reduce_only) == (400.0, False)
    assert (legs["C"].side, legs["C"].reduce_only) == ("sell", True)
    assert legs["F"].note == "change too small"
    plain = rb.plan(weights, positions, 1000.0)
    e = rb.exposure(plain, 1000.0).first()
    assert (e.gross_target, e.n_open, e.n_skip) == (600.0, 1, 1)
    assert rb.exposure(plain, 0.0).first().target_leverage is None
    assert "open" in rb.preview(plain)


def test_specifications_and_acknowledgements(spark):
    raw = [("A", "live", "0.1", "", "0.010", "1", "x"), ("B", "live", "0", "1", "1", "1", "1"), ("C", "halt", "2", "3", "1E-4", "0", ""), ("", "live", "1", "1", "1", "1", "1"), ("D", "live", "1", "1", "10", "1", "1")]
    rows = {r.inst_id: r for r in rb.specs_from(spark.createDataFrame(raw, "instId string, state string, ctVal string, ctMult string, lotSz string, minSz string, maxMktSz string")).collect()}
    assert set(rows) == {"A", "C", "D"}
    assert (rows["A"].size_decimals, rows["A"].ct_mult, rows["A"].max_mkt_sz) == (2, 1.0, 0.0)
    assert (rows["C"].size_decimals, rows["C"].ct_mult, rows["D"].size_decimals) == (4, 3.0, 0)
    sizes = spark.createDataFrame([(1.5, 2), (3.0, 0), (0.0001, 4)], "s double, d int").select(rb.format_size(F.col("s"), F.col("d")).cast("string").alias("t"))
    assert [r.t for r in sizes.collect()] == ["1.50", "3", "0.0001"]
    assert rb.account_problems("2", "net_mode") == []
    assert len(rb.account_problems("1", "long_short_mode")) == 2
    a = rb.acknowledgements(spark.createDataFrame([("0",), ("1",), (None,)], "code string")).first()
    assert (a.orders, a.ok, a.failed) == (3, 1, 2)
