"""Operator semantics where they are easily got wrong, on the sample panel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith import api
from panelith.functions.elementwise import norm_cdf, norm_ppf
from panelith.plans.panel import Factor, Panel, align
from panelith.sources.panel_csv import read_panel, show, to_csv_string, write_panel

from .panels import DAYS, sample, values


@pytest.fixture(scope="module")
def p(spark):
    panel = sample(spark)
    panel.frame = panel.frame.cache()
    return panel


def test_grid_is_dense_and_the_last_of_equal_keys_wins(spark):
    g = Panel.from_records(spark, ["v"], [("t1", "A", 1.0), ("t2", "B", 2.0), ("t1", "A", 3.0)])
    assert values(g.factor("v")) == {("t1", "A"): 3.0, ("t1", "B"): None, ("t2", "A"): None, ("t2", "B"): 2.0}
    assert len(g) == 4
    for bad in ([], [("t", "A")]):
        with pytest.raises(ValueError):
            Panel.from_records(spark, ["v"], bad)


def test_missing_values_compare_unequal(p):
    v = values(p.factor("close").ne_val(12))
    assert v[DAYS[3], "AAA"] == 1.0
    assert v[DAYS[2], "AAA"] == 0.0
    for op in ("lt", "le", "gt", "ge", "eq_val"):
        assert values(getattr(p.factor("close"), op)(12))[DAYS[3], "AAA"] == 0.0


def test_three_rules_of_division_by_zero(p):
    close = p.factor("close")
    at = (DAYS[1], "DDD")
    assert values(p.factor("extra") / close)[at] is None
    assert set(values(close / 0).values()) == {None}
    assert values(1 / close)[at] is None
    tiny = p.factor("extra") * 1e-12
    assert values(close / tiny)[DAYS[0], "AAA"] is None  # a factor close to zero
    assert values(1 / tiny)[DAYS[0], "AAA"] == pytest.approx(1e12)  # but not below a number


def test_powers_of_missing_values(p):
    close = p.factor("close")
    assert values(close**0)[DAYS[3], "AAA"] == 1.0
    assert values(1**close)[DAYS[3], "AAA"] == 1.0
    assert values(close**0.5)[DAYS[0], "DDD"] is None
    assert values(close.signed_power(0.5))[DAYS[7], "DDD"] == pytest.approx(-math.sqrt(8))


def test_rank(p):
    v = values(p.factor("close").rank())
    assert [v[DAYS[0], s] for s in ("AAA", "BBB", "CCC", "DDD")] == [0.5, 0.75, 0.75, 0.25]
    assert {v[DAYS[5], s] for s in ("AAA", "BBB")} == {None}  # all equal
    assert v[DAYS[3], "BBB"] is None  # a symbol is missing
    one = p.slice_symbols(["AAA"])
    assert set(values(one.factor("close").rank()).values()) == {None}


def test_signal_sums_to_zero(p):
    df = p.factor("volume").signal().frame("v").groupBy("ts").agg(F.sum("v").alias("s"), F.sum(F.abs("v")).alias("a")).where("a is not null")
    for r in df.collect():
        assert r.s == pytest.approx(0, abs=1e-12)
        assert r.a == pytest.approx(1)
    flags = {r.ts: r.is_signal for r in p.factor("volume").signal().is_signal().collect()}
    assert not flags[DAYS[1]]
    assert flags[DAYS[0]]


def test_scale_turns_the_short_side_positive(p):
    v = values(p.factor("close").scale(1, long_scale=2, short_scale=3))
    assert v[DAYS[0], "DDD"] == pytest.approx(3.0)
    assert v[DAYS[0], "AAA"] == pytest.approx(10 / 50 * 2)


def test_spread_gives_missing_cells_the_long_side(p):
    v = values(p.factor("close").spread(0.3))
    assert v[DAYS[3], "AAA"] == 0.5
    assert v[DAYS[3], "DDD"] == -0.5
    for bad in (0, 1):
        with pytest.raises(ValueError):
            p.factor("close").spread(bad)


def test_quantile_is_monotone(p):
    v = values(p.factor("volume").quantile())
    row = [v[DAYS[2], s] for s in ("AAA", "BBB", "CCC", "DDD")]
    assert row == sorted(row)
    assert row[1] == pytest.approx(0)
    with pytest.raises(ValueError):
        p.factor("volume").quantile("normal")


def test_normal_distribution(spark):
    from statistics import NormalDist

    n = NormalDist()
    ps = [1e-6, 0.001, 0.02, 0.024, 0.03, 0.3, 0.5, 0.7, 0.98, 0.999999]
    xs = [-40.0, -8.0, -7.2, -3.0, -0.5, 0.0, 1.0, 6.0, 7.5, 38.0]
    df = spark.createDataFrame(list(zip(ps, xs)), "p double, x double").select("p", "x", norm_ppf(F.col("p")).alias("q"), norm_cdf(F.col("x")).alias("c"))
    for r in df.collect():
        assert r.q == pytest.approx(n.inv_cdf(r.p), rel=1e-8, abs=1e-8)
        assert r.c == pytest.approx(n.cdf(r.x), rel=1e-9, abs=1e-15)


def test_groups(p):
    g = p.factor("close").group_map({"AAA": 1, "BBB": 1, "CCC": 2})
    close = p.factor("close")
    mean = values(close.group_mean(g))
    assert mean[DAYS[3], "AAA"] == 17.0  # members without a value get it too
    assert mean[DAYS[3], "DDD"] is None  # no group
    assert values(close.group_scale(g))[DAYS[3], "AAA"] == 0.5
    assert values((close * 0).group_normalize(g))[DAYS[3], "AAA"] == 0.0
    assert values(close.group_rank(g))[DAYS[5], "AAA"] == 0.75  # ties at their average
    with pytest.raises(ValueError):
        close.group_named("UNKNOWN")
    assert p.factor("close").group_named("SECTOR_L1_L2").name == "group(SECTOR_L1_L2)"


def test_neutralisation_residuals_are_orthogonal(p):
    close, volume, extra = (p.factor(c) for c in ("close", "volume", "extra"))
    df = p.compute(r=close.regression_neut(volume), v=volume).where("r is not null").groupBy("ts").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("v")).alias("x"))
    assert all(abs(r.s) < 1e-8 and abs(r.x) < 1e-6 for r in df.collect())
    two = {k: v for k, v in values(close.regression_neut(volume, extra)).items() if v is not None}
    rows = p.frame.where(F.col("ts") == DAYS[0]).orderBy("symbol").collect()
    x = np.array([[1, r.volume, r.extra] for r in rows])
    y = np.array([r.close for r in rows])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert [two[DAYS[0], r.symbol] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)
    assert set(values(close.regression_neut()).values()) == {None}


def test_rolling_windows_need_full_frames(p):
    close = p.factor("close")
    v = values(close.ts_mean(3))
    assert v[DAYS[1], "AAA"] is None
    assert v[DAYS[2], "AAA"] == 11.0
    assert v[DAYS[5], "AAA"] is None
    assert v[DAYS[6], "AAA"] == 15.0
    for bad in (0, -1):
        with pytest.raises(ValueError):
            close.ts_mean(bad)


def test_rolling_ties(p):
    volume = p.factor("volume")
    flat = (volume * 0 + 3).ts_rank(3)
    assert values(flat)[DAYS[4], "AAA"] is None
    extra = p.factor("extra")  # AAA: 1 2 3 4 5 1 2 ...
    assert values(extra.ts_rank(6))[DAYS[5], "AAA"] == pytest.approx(2 / 6)  # the current of equals ranks highest
    assert values(extra.ts_arg_min(6))[DAYS[5], "AAA"] == 5  # the earliest of equals
    assert values(extra.ts_arg_max(5))[DAYS[5], "AAA"] == 1


def test_decay_directions(p):
    extra = p.factor("extra")
    assert values(extra.ts_decay_linear(3))[DAYS[2], "AAA"] == pytest.approx((1 * 3 + 2 * 2 + 3 * 1) / 6)  # the oldest weighs most
    assert values(extra.ts_decay_exp_window(3, 0.5))[DAYS[2], "AAA"] == pytest.approx((1 * 0.25 + 2 * 0.5 + 3) / 1.75)  # the newest does
    gone = p.factor("close") / 0
    assert values(gone.ts_decay_exp_window(3, 0.5, False))[DAYS[2], "AAA"] == 0.0
    assert values(gone.ts_decay_exp_window(3, 0.5, True))[DAYS[2], "AAA"] is None
    assert values(gone.ts_decay_linear(3))[DAYS[2], "AAA"] is None
    for call in (lambda: extra.ts_decay_exp_window(3, 1.0), lambda: extra.ts_backfill(3, 0), lambda: extra.ts_vr(3, 0), lambda: extra.ts_autocorr(3, 0), lambda: extra.log(1)):
        with pytest.raises(ValueError):
            call()


def test_skewness_starts_late(p):
    v = values(p.factor("extra").ts_skewness(4))
    assert v[DAYS[5], "AAA"] is None
    assert v[DAYS[6], "AAA"] is not None


def test_regressions_on_one_and_two_factors(p):
    close, volume, extra = (p.factor(c) for c in ("close", "volume", "extra"))
    rows = p.frame.where("symbol = 'CCC'").orderBy("ts").collect()
    for xs, names in (([extra], ["extra"]), ([extra, volume], ["extra", "volume"])):
        for kind in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 100, 101):
            got = values(close.ts_regression(xs, 6, 1, kind))
            for i in (7, 9, 11):
                frame = [(rows[j].close, *(rows[j - 1][n] for n in names)) for j in range(i - 5, i + 1)]
                frame = np.array([f for f in frame if None not in f], float)
                x, y = np.column_stack([np.ones(len(frame)), frame[:, 1:]]), frame[:, 0]
                c, inv = np.linalg.lstsq(x, y, rcond=None)[0], np.linalg.inv(x.T @ x)
                fit = x @ c
                sse, sst = ((y - fit) ** 2).sum(), ((y - y.mean()) ** 2).sum()
                mse = sse / (len(y) - x.shape[1])
                want = {0: y[-1] - fit[-1], 1: c[0], 2: c[1], 3: fit[-1], 4: sse, 5: sst, 6: 1 - sse / sst, 7: mse, 8: math.sqrt(mse * inv[2, 2]) if len(c) > 2 else None, 9: math.sqrt(mse * inv[0, 0]), 100: c[1], 101: c[2] if len(c) > 2 else None}[kind]
                assert got[DAYS[i], "CCC"] == (pytest.approx(want, rel=1e-6, abs=1e-7) if want is not None else None), (kind, i)


def test_grids_meet_in_their_intersection(p):
    a, b = p.slice_symbols(["AAA", "BBB"]).factor("volume"), p.slice_time(DAYS[2], DAYS[4]).slice_symbols(["BBB", "CCC"]).factor("extra")
    v = values(a + b)
    assert set(v) == {(d, "BBB") for d in DAYS[2:5]}
    assert v[DAYS[2], "BBB"] == 184.0
    assert values(p.slice_symbols(["AAA"]).factor("close") + p.slice_symbols(["BBB"]).factor("close")) == {}
    x, y = align(a, b)
    assert x.panel is y.panel
    cond = p.slice_time(DAYS[2], DAYS[3]).factor("extra") > 0
    picked = values(p.factor("volume").where_cond(cond, p.factor("extra")))
    assert picked[DAYS[2], "AAA"] == 120.0
    assert picked[DAYS[5], "AAA"] == 1.0  # no condition there: the other
    assert len(values(p.factor("volume").where_cond(cond, 0))) == 8


def test_names(p):
    close, volume = p.factor("close"), p.factor("volume")
    assert (close + volume).name == "(close+volume)"
    assert (2 - close).name == "(2-close)"
    assert (-close).name == "(close*-1)"
    assert (close**0.5).name == "(close**0.5)"
    assert close.normalize(True).name == "normalize(close,use_std=True,limit=0)"
    assert close.ts_decay_linear(5, True).name == "ts_decay_linear(close,5,dense=True)"
    assert close.ts_regression([volume], 5, 0, 6).name == "ts_regression(close,volume,5,lag=0,rettype=6)"
    assert close.ts_delay(20).rank().rename("alpha").name == "alpha"


def test_function_forms(p):
    assert len(api.__all__) >= 74 + 2
    close, volume = p.factor("close"), p.factor("volume")
    assert api.rank(close).key == close.rank().key
    assert api.ts_corr(close, volume, 5).key == close.ts_corr(volume, 5).key
    assert api.where_(close > 1, close, volume).key == close.where_cond(close > 1, volume).key
    assert api.ts_regression_multi(close, [volume], 5).name == "ts_regression(close,volume,5,lag=0,rettype=0)"
    assert sum(n.startswith("ts_") for n in api.__all__) == 33


def test_equal_nodes_compile_once_and_windows_share_exchanges(p):
    close = p.factor("close")
    df = p.compute(a=close.ts_mean(3) - close.ts_delay(2), b=close.ts_mean(3).rank(), c=close.ts_std_dev(3).zscore())
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning(symbol") <= 1
    assert plan.count("Exchange hashpartitioning(ts") == 1


def test_csv_round_trip(spark, p, tmp_path):
    path = str(tmp_path / "panel")
    write_panel(p, path)
    again = read_panel(spark, path)
    assert again.columns == p.columns
    for c in p.columns:
        assert values(again.factor(c)) == values(p.factor(c))
    (tmp_path / "x.csv").write_text("timestamp,symbol, v\n2024-01-01,A,1\n\n2024-01-01,B,oops\n2024-01-01,A,2\n")
    small = read_panel(spark, str(tmp_path / "x.csv"))
    assert values(small.factor("v")) == {("2024-01-01", "A"): 2.0, ("2024-01-01", "B"): None}
    text = to_csv_string(small)
    assert text == "timestamp,symbol,v\n2024-01-01,A,2\n2024-01-01,B,\n"
    assert "..." in show(p.factor("close"), 4)
    (tmp_path / "y.csv").write_text("time,symbol,v\n1,A,1\n")
    with pytest.raises(ValueError):
        read_panel(spark, str(tmp_path / "y.csv"))


def test_access(p):
    close = p.factor("close")
    assert close.get(DAYS[0], "BBB") == 20.0
    assert close.get("2030-01-01", "BBB") is None
    assert close.row(DAYS[0]).count() == 4
    assert close.series("AAA").count() == 12
    assert [tuple(r) for r in close.weights(DAYS[3]).collect()] == [("BBB", 17.0), ("CCC", 26.0), ("DDD", 2.0)]
    assert [tuple(r) for r in close.weights().collect()] == [("AAA", 21.0), ("BBB", 9.0), ("CCC", 40.0), ("DDD", 12.0)]
    info = close.info().first()
    assert (info.n_valid, info.n_missing, info.max) == (47, 1, 40.0)
    assert p.info().first().missing_volume == 1
    with pytest.raises(KeyError):
        p.factor("none")
    with pytest.raises(KeyError):
        p.select(["none"])
    with pytest.raises(ValueError):
        p.select(["ts"])


def test_factors_from_records_and_matrices(spark):
    nan = float("nan")
    f = Factor.from_records(spark, [("2024-01-01", "B", 9.0), ("2024-01-01", "B", 2.0), ("2024-01-02", "A", 3.0)], "made")
    assert f.name == "made"
    assert sorted((r.ts, r.symbol, r.value) for r in f.frame().collect() if r.value is not None) == [("2024-01-01", "B", 2.0), ("2024-01-02", "A", 3.0)]
    assert f.frame().count() == 4
    m = Factor.from_matrix(spark, ["t1", "t2"], ["A", "B"], [[1.0, nan], [None, 4.0]])
    assert {(r.ts, r.symbol): r.value for r in m.frame().collect()} == {("t1", "A"): 1.0, ("t1", "B"): None, ("t2", "A"): None, ("t2", "B"): 4.0}
    for bad in ((["t1"], ["A"], [[1.0], [2.0]]), (["t1"], ["A", "B"], [[1.0]])):
        with pytest.raises(ValueError, match="matrix"):
            Factor.from_matrix(spark, *bad)


def test_surplus_and_unknown_parameters_fail(spark):
    f = Factor.from_matrix(spark, ["t1"], ["A"], [[1.0]])
    for call in (lambda: f.ts_mean(5, 7), lambda: f.ts_mean(w=5, v=2), lambda: f.ts_mean(5, w=5), lambda: f.rank(1), lambda: f.ts_corr(f, 5, 6)):
        with pytest.raises(TypeError):
            call()


def test_rolling_fits_equal_single_solves():
    from panelith.operators.linear import ROLLING_LIMIT, rolling_fits, solve

    rng = np.random.default_rng(3)
    y, x = rng.normal(size=60), rng.normal(size=(60, 3))
    y[rng.random(60) < 0.2] = np.nan
    x[rng.random((60, 3)) < 0.1] = np.nan
    x[20:40, 1] = 2 * x[20:40, 0]  # singular windows
    w = 10
    for rettype in (*range(10), 100, 101, 102, 103):
        got = rolling_fits(y, x, w, rettype)
        for i in range(60):
            rows = np.column_stack([y, x])[max(0, i - w + 1) : i + 1]
            rows = rows[~np.isnan(rows).any(1)]
            fit = solve(np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0], ROLLING_LIMIT) if i >= w - 1 and len(rows) >= 5 else None
            if fit is None or rettype == 103:
                assert np.isnan(got[i])
                continue
            coef, gram = fit
            fitted = coef[0] + rows[:, 1:] @ coef[1:]
            sse, sst, free = ((rows[:, 0] - fitted) ** 2).sum(), ((rows[:, 0] - rows[:, 0].mean()) ** 2).sum(), len(rows) - 4
            error = lambda k: np.sqrt(sse / free * np.linalg.inv(gram)[k, k]) if free else np.nan  # noqa: B023, E731
            want = {0: rows[-1, 0] - fitted[-1], 1: coef[0], 2: coef[1], 3: fitted[-1], 4: sse, 5: sst, 6: 1 - sse / sst, 7: sse / free if free else np.nan, 8: error(2), 9: error(0), 100: coef[1], 101: coef[2], 102: coef[3]}[rettype]
            assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-9, nan_ok=True)


def test_powers_beyond_doubles_are_missing(spark):
    f = Factor.from_matrix(spark, ["t1", "t2"], ["A", "B"], [[1e200, 10.0], [-1e200, 0.0]])
    assert values(f**2) == {("t1", "A"): None, ("t1", "B"): 100.0, ("t2", "A"): None, ("t2", "B"): 0.0}
    assert values(f ** Factor.from_matrix(spark, ["t1", "t2"], ["A", "B"], [[3.0, 3.0], [3.0, -1.0]])) == {("t1", "A"): None, ("t1", "B"): 1000.0, ("t2", "A"): None, ("t2", "B"): None}
    assert values(10**f)[("t1", "A")] is None


@pytest.mark.parametrize("more", [False, True])
def test_rolling_fits_end_at_the_condition_limit(spark, more):
    rows = [(f"t{i}", s, float(at + i), float(i * i % 5), float(i * i % 7)) for s, at in (("A", 400), ("B", 600)) for i in range(8)]
    g = Panel.from_records(spark, ["x", "z", "y"], rows)
    for s, over in (("A", False), ("B", True)):
        design = np.array([(1.0, x, z)[: 2 + more] for _, k, x, z, _ in rows if k == s])
        assert (np.linalg.cond(design.T @ design) > 1e10) == over
    for rettype in (0, 1, 2, 3, 4, 5, 6, 7, 9, 100):
        got = values(g.factor("y").ts_regression([g.factor("x"), g.factor("z")][: 1 + more], 8, 0, rettype))
        assert got["t7", "A"] is not None and got["t7", "B"] is None, rettype


def test_sources_are_known_by_name(spark):
    from panelith.sources.bars import SOURCES, parse_source

    assert [parse_source(s) for s in SOURCES] == list(SOURCES)
    with pytest.raises(ValueError, match="unknown source"):
        parse_source("other")
