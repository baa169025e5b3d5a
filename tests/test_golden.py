"""Published results for the sample panel and the sample returns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith.operators.analysis import analyze, global_ranks, kendall_tau_b
from panelith.operators.backtest import Backtester, drawdown_periods, performance_metrics, simulate
from panelith.plans.panel import Panel

from .panels import sample

near = lambda v: pytest.approx(v, rel=1e-9, abs=1e-12)


def test_information_coefficients(spark):
    p = sample(spark)
    a = analyze([p.factor("close").rank()], p.factor("close"), [1, 3])
    rows = {r.horizon: r for r in a.ic("spearman").collect()}
    one = rows[1]
    assert (one.ic_mean, one.ic_std, one.ir, one.t_stat, one.n) == (near(0.3423487588982433), near(0.64422010951464), near(0.5314158217696298), near(1.5942474653088892), 9)
    assert (rows[3].ic_mean, rows[3].ic_std, rows[3].n) == (near(0.20012540018566538), near(0.5469517103061993), 7)
    pearson = {r.horizon: r for r in a.ic("pearson").collect()}[1]
    assert (pearson.ic_mean, pearson.ic_std, pearson.n) == (near(0.3897929115331005), near(0.5951329959366564), 8)
    first = lambda m: a.ic_series(m).where("horizon = 1").orderBy("ts").first().ic
    assert (first("spearman"), first("pearson")) == (near(0.5), near(0.8297384836634898))


def test_stats(spark):
    p = sample(spark)
    rows = {r.factor: r for r in analyze([p.factor("close").rank(), p.factor("close"), p.factor("volume")], p.factor("close")).stats().collect()}
    assert (rows["rank(close)"].coverage, rows["rank(close)"].turnover) == (near(40 / 48), near(0.05357142857142857))
    assert (rows["close"].coverage, rows["close"].turnover, rows["close"].autocorr) == (near(47 / 48), near(0.14267676767676768), near(0.7318832571724686))
    assert (rows["volume"].turnover, rows["volume"].autocorr) == (near(0.04924242424242424), near(0.8853257775503282))


RETURNS = [0.01, -0.02, 0.03, -0.005, 0.012, -0.008, 0.02, -0.015, 0.005, 0.011]


def returns(spark):
    rows = [("s", f"2024-01-{i + 1:02d}", r) for i, r in enumerate(RETURNS)]
    return spark.createDataFrame(rows, "strategy string, d string, ret double").select("strategy", F.to_timestamp("d").alias("ts"), "ret")


def test_metrics(spark):
    m = performance_metrics(returns(spark), 0.03).first()
    expected = {
        "total_return": 0.039569571740008636, "annual_return": 3.825090418262354, "annual_volatility": 0.3016731122699977, "sharpe_ratio": 12.580141430919918,
        "sortino_ratio": 29.288476353314685, "calmar_ratio": 191.25452091311752, "max_drawdown": -0.02, "linearity": 0.6116645984673364,
        "var_95": -0.01775, "cvar": -0.02, "psr": 0.6184857352323951,
    }
    assert {k: m[k] for k in expected} == {k: near(v) for k, v in expected.items()}
    assert drawdown_periods(returns(spark)).count() == 4
    assert performance_metrics(returns(spark).limit(1)).count() == 0


def test_kendall():
    rng = random.Random(7)
    for n in (2, 7, 40, 200):
        x, y = (np.array([rng.randint(0, n // 3 + 1) for _ in range(n)], float) for _ in range(2))
        s = [(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]), x[i] != x[j], y[i] != y[j]) for i in range(n) for j in range(i)]
        dx, dy = sum(a[1] for a in s), sum(a[2] for a in s)
        want = sum(a[0] for a in s) / np.sqrt(dx) / np.sqrt(dy) if dx and dy else float("nan")
        assert kendall_tau_b(x, y) == pytest.approx(want, abs=1e-12, nan_ok=True)
    assert np.isnan(kendall_tau_b(np.array([1.0, 1.0]), np.array([1.0, 2.0])))


def test_correlations(spark):
    p = sample(spark)
    a = analyze([p.factor("close"), p.factor("extra"), p.factor("volume")], p.factor("close"))
    signals = [f.signal() for f in a.factors]
    df = p.compute(a=signals[0], b=signals[1], c=signals[2]).toPandas().dropna()
    for method in ("pearson", "spearman", "kendall"):
        got = {(r.factor_a, r.factor_b): r for r in a.correlation(method).collect()}
        want = df[["a", "b", "c"]].astype(float).rank().corr() if method == "spearman" else df[["a", "b", "c"]].astype(float).corr() if method == "pearson" else None
        assert len(got) == 9
        for i, x in enumerate(("close", "extra", "volume")):
            for j, y in enumerate(("close", "extra", "volume")):
                w = kendall_tau_b(df["abc"[i]].to_numpy(float), df["abc"[j]].to_numpy(float)) if method == "kendall" else want.iloc[i, j]
                assert (got[x, y]["corr"], got[x, y].n_obs) == (pytest.approx(w, abs=1e-9), len(df))


def test_global_ranks(spark):
    v = [random.Random(3).randint(0, 50) / 7 for _ in range(500)]
    rows = global_ranks(spark.createDataFrame([(x, -x, x) for x in v], "x double, y double, v double"), ["x", "y"], buckets=8).toPandas()
    assert np.allclose(rows.x, rows.v.rank())
    assert np.allclose(rows.y, (-rows.v).rank())


def pair(spark, hole=None, flat=False):
    price = [(f"2024-01-0{d}", s, {"AAA": 10.0, "BBB": 18.0 + 2 * d, "CCC": 30.0}[s] if (d, s) != hole else None) for d in range(1, 5) for s in ("AAA", "BBB", "CCC")]
    weight = {"AAA": -0.5, "BBB": 0.5, "CCC": 0.0}
    cells = [(t, s, v, 0.0 if flat else weight[s]) for t, s, v in price]
    return Panel.from_frame(spark.createDataFrame(cells, "d string, symbol string, p double, w double").select(F.to_timestamp("d").alias("ts"), "symbol", "p", "w"))


def test_backtest(spark):
    p = pair(spark)
    b = Backtester(p.factor("p"), p.factor("w"), buy=0.0, sell=0.0)
    equity = [(str(r.ts)[:10], r.value) for r in b.equity().orderBy("ts").collect()]
    day3 = 1000 + 500 / 22 * 24 - 500
    assert equity[:3] == [("2024-01-01", 1000.0), ("2024-01-02", 1000.0), ("2024-01-03", near(day3))]
    assert b.trades().where("symbol = 'CCC'").count() == 0
    costly = Backtester(p.factor("p"), p.factor("w"), full_rebalance=True)
    last = costly.equity().orderBy("ts").collect()[-1].value
    assert last < b.equity().orderBy("ts").collect()[-1].value
    assert costly.trades().count() > b.trades().count()
    assert [r.value for r in b.benchmark_equity().orderBy("ts").collect()] == [near(1000.0), near(1000 / 3 * (2 + 24 / 22)), near(1000 / 3 * (2 + 26 / 22))]
    assert b.summary().startswith("Backtester(strategy='w', period=2024-01-01 to 2024-01-04)\n  total_return:   ")
    assert b.drawdown_report().startswith("Drawdown Periods")
    assert b.metrics().count() == 1
    still = pair(spark, flat=True)
    assert Backtester(still.factor("p"), still.factor("w")).trades().count() == 0


def test_backtest_skips_periods_with_holes(spark):
    p = pair(spark, hole=(3, "BBB"))
    b = Backtester(p.factor("p"), p.factor("w"))
    assert [str(r.ts)[:10] for r in b.equity().where("not seed").orderBy("ts").collect()] == ["2024-01-02", "2024-01-04"]


def test_simulation_liquidates_without_targets():
    import pandas as pd

    days = list(pd.date_range("2024-01-01", periods=4))
    prices = [{"A": 10.0, "B": 10.0}] * 4
    equity, trades = simulate(days, prices, [{"A": 0.5, "B": -0.5}, None, {"A": 0.5, "B": -0.5}, None], 1000.0, 0.0, 0.0, False, True)
    assert len(equity) == 4
    assert [t[2] for t in trades] == [500.0, -500.0, -500.0, 500.0, 500.0, -500.0]


def test_reports(spark):
    p = sample(spark)
    close = p.factor("close")
    a = analyze([close.rank().signal().rename("signal(rank(close))"), close.rank()], close, [1, 3])
    assert a.summary().split("\n") == [
        "FactorAnalyzer(factors=2, horizons=[1, 3])",
        "",
        "IC Analysis (Spearman):",
        "  Factor                      1D          3D",
        "  ------------------------------------------",
        "  signal(rank(close)      0.3423      0.2001",
        "  rank(close)             0.3423      0.2001",
        "",
        "IR (IC Mean / IC Std):",
        "  signal(rank(close)       0.531       0.366",
        "  rank(close)              0.531       0.366",
        "",
        "Factor Statistics:",
        "  Factor                Coverage    Turnover    Autocorr",
        "  ------------------------------------------------------",
        "  signal(rank(close)      83.33%      0.0536         N/A",
        "  rank(close)             83.33%      0.0536         N/A",
        "",
        "Correlation Matrix:",
        "                       signal(rank(close))  rank(close)",
        "  signal(rank(close))               1.0000       1.0000",
        "  rank(close)                       1.0000       1.0000",
    ]
    assert str(p) == "Panel(48 rows, 3 cols, 4 symbols, 12 periods, 2024-01-01 to 2024-01-12)"
    assert p.describe().endswith("NaN: {close: 1, extra: 0, volume: 1}")
    assert str(close) == "Factor('close', 12 periods × 4 symbols, 2024-01-01 to 2024-01-12)"
    one = p.slice_time("2024-01-01", "2024-01-01").factor("extra")
    assert f"  {'extra':<18}{'100.00%':>12}{'nan':>12}{'N/A':>12}" in analyze([one], one, [1]).summary()
