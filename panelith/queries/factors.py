"""Registered queries for the factor operators, each with an independent SQL formulation."""

from __future__ import annotations

from panelith.functions import elementwise as el

from . import base as b

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None, build, panel=b.events_hourly, digits: int = 6):
    QUERIES[name] = lambda spark, sf: b.answer(build(panel(spark, sf)), digits)
    if sql is not None:
        ORACLE_SQL[name] = sql


x = lambda p: p.factor("x")
d = lambda p: p.factor("d")
y = lambda p: p.factor("y")

# Element-wise, one value
add("abs", b.cell_sql("abs(d)"), lambda p: d(p).abs())
add("sign", b.cell_sql("CASE WHEN d > 0 THEN 1.0 WHEN d < 0 THEN -1.0 WHEN d = 0 THEN 0.0 END"), lambda p: d(p).sign())
add("inverse", b.cell_sql("CASE WHEN x <> 0 THEN 1 / x END"), lambda p: x(p).inverse())
add("ln", b.cell_sql("CASE WHEN d > 0 THEN ln(d) END"), lambda p: d(p).ln())
add("log_base", b.cell_sql("CASE WHEN d > 0 THEN ln(d) / ln(3.0) END"), lambda p: d(p).log(3.0))
add("sqrt", b.cell_sql("CASE WHEN d >= 0 THEN sqrt(d) END"), lambda p: d(p).sqrt())
add("s_log_1p", b.cell_sql("sign(d) * ln(1 + abs(d))"), lambda p: d(p).s_log_1p())
add("reverse", b.cell_sql("-d"), lambda p: -d(p))

# Element-wise, two values
add("add", b.cell_sql("x + y"), lambda p: x(p) + y(p))
add("subtract", b.cell_sql("x - y"), lambda p: x(p) - y(p))
add("multiply", b.cell_sql("d * y"), lambda p: d(p) * y(p))
add("divide", b.cell_sql("CASE WHEN abs(y - 3) > 1e-10 THEN x / (y - 3) END"), lambda p: x(p) / (y(p) - 3))
add("divide_scalar", b.cell_sql("d / 7.0"), lambda p: d(p) / 7)
add("scalar_subtract", b.cell_sql("5.0 - d"), lambda p: 5 - d(p))
add("scalar_divide", b.cell_sql("CASE WHEN y <> 3 THEN 5.0 / (y - 3) END"), lambda p: 5 / (y(p) - 3))
add("power", b.cell_sql("CASE WHEN y = 0 OR x = 1 THEN 1.0 ELSE power(x / 100, y / 4) END"), lambda p: (x(p) / 100) ** (y(p) / 4))
add("power_zero", b.cell_sql("1.0"), lambda p: x(p) ** 0)
add("scalar_power", b.cell_sql("power(1.1, y)"), lambda p: 1.1 ** y(p))
add("signed_power", b.cell_sql("sign(d) * sqrt(abs(d))"), lambda p: d(p).signed_power(0.5))
add("maximum", b.cell_sql("CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN x > y * 50 THEN x ELSE y * 50 END END"), lambda p: x(p).maximum(y(p) * 50))
add("minimum", b.cell_sql("CASE WHEN x < 120 THEN x WHEN x >= 120 THEN 120.0 END"), lambda p: x(p).minimum(120))
for _name, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq_val", "=")):
    add(_name, b.cell_sql(f"CASE WHEN y {_sign} 4 THEN 1.0 ELSE 0.0 END"), lambda p, _name=_name: getattr(y(p), _name)(4))
add("ne_val", b.cell_sql("CASE WHEN y = 4 THEN 0.0 ELSE 1.0 END"), lambda p: y(p).ne_val(4))
add("where_factor", b.cell_sql("CASE WHEN d > 0 THEN x ELSE y END"), lambda p: x(p).where_cond(d(p) > 0, y(p)))
add("where_scalar", b.cell_sql("CASE WHEN d > 0 THEN x ELSE -1.0 END"), lambda p: x(p).where_cond(d(p) > 0, -1))

# Cross-section
_all = "count(*) AS m, count(x) AS k, "
add("rank", b.cross_sql("CASE WHEN k = m AND lo < hi THEN (SELECT count(*) FROM n o WHERE o.ts = n.ts AND o.x < n.x) / CAST(m AS DOUBLE) + 1.0 / m END", _all + "min(x) AS lo, max(x) AS hi"), lambda p: x(p).rank())
add("cs_mean", b.cross_sql("CASE WHEN k = m THEN mean END", _all + "avg(x) AS mean"), lambda p: x(p).cs_mean())
add("cs_median", b.cross_sql("CASE WHEN k = m THEN mid END", _all + "median(x) AS mid"), lambda p: x(p).cs_median())
add("normalize", b.cross_sql("x - mean", "avg(x) AS mean"), lambda p: x(p).normalize())
add("normalize_limited", b.cross_sql("CASE WHEN sd > 0 THEN CASE WHEN (x - mean) / sd > 0.8 THEN 0.8 WHEN (x - mean) / sd < -0.8 THEN -0.8 ELSE (x - mean) / sd END END", "avg(x) AS mean, stddev_samp(x) AS sd"), lambda p: x(p).normalize(True, 0.8))
add("zscore", b.cross_sql("CASE WHEN sd > 0 THEN (x - mean) / sd END", "avg(x) AS mean, stddev_samp(x) AS sd"), lambda p: x(p).zscore())
add("scale", b.cross_sql("CASE WHEN total = 0 THEN d ELSE d / total * 2 END", "sum(abs(d)) AS total"), lambda p: d(p).scale(2))
add("scale_long_short", b.cross_sql("CASE WHEN d > 0 THEN d / longs * 3 WHEN d < 0 THEN -d / shorts * 0.5 ELSE d END", "sum(CASE WHEN d > 0 THEN d END) AS longs, sum(CASE WHEN d < 0 THEN -d END) AS shorts"), lambda p: d(p).scale(1, 3, 0.5))
_place = "(SELECT count(*) FROM n o WHERE o.ts = n.ts AND (o.x < n.x OR o.x = n.x AND o.symbol <= n.symbol))"
_press = f"(1.0 / k + least(greatest({_place} / CAST(k AS DOUBLE), 1e-6), 1 - 1e-6) * (1.0 - 2.0 / k))"
add("quantile_uniform", b.cross_sql(f"CASE WHEN x IS NOT NULL AND k >= 2 THEN {_press} END", "count(x) AS k"), lambda p: x(p).quantile("uniform"))
add("quantile_cauchy", b.cross_sql(f"CASE WHEN x IS NOT NULL AND k >= 2 THEN 2 * tan(pi() * (least({_press}, 1 - 1e-6) - 0.5)) END", "count(x) AS k"), lambda p: x(p).quantile("cauchy", 2), digits=4)
ORACLE_SQL["quantile_cauchy"] = ORACLE_SQL["quantile_cauchy"].replace(", 6) + 0.0 AS v", ", 4) + 0.0 AS v")


def _poly_sql(coefficients, q: str) -> str:
    e = repr(coefficients[0])
    for c in coefficients[1:]:
        e = f"({e} * {q} + {c!r})"
    return e


def _ppf_sql(p: str) -> str:
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    tail = lambda q: f"{_poly_sql(el.PPF_C, q)} / {_poly_sql((*el.PPF_D, 1.0), q)}"
    square = f"({mid} * {mid})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -({tail(high)}) ELSE {_poly_sql(el.PPF_A, square)} * {mid} / {_poly_sql((*el.PPF_B, 1.0), square)} END"


add("quantile_gaussian", b.cell_sql(_ppf_sql("p"), more=f",\na AS (SELECT ts, count(x) AS k FROM n GROUP BY ts),\nq AS (SELECT n.ts, n.symbol, CASE WHEN x IS NOT NULL AND k >= 2 THEN least(greatest({_press}, 1e-6), 1 - 1e-6) END AS p FROM n JOIN a ON n.ts = a.ts)", source="q").replace("round(CASE WHEN p", "round(CASE WHEN p IS NULL THEN NULL WHEN p"), lambda p: x(p).quantile())
_seat = "(SELECT count(*) FROM n o WHERE o.ts = n.ts AND (o.x < n.x OR (o.x = n.x OR o.x IS NULL AND n.x IS NULL) AND o.symbol <= n.symbol OR n.x IS NULL AND o.x IS NOT NULL))"
add("spread", b.cross_sql(f"CASE WHEN k < 2 THEN 0.0 WHEN {_seat} <= greatest(1, floor(m * 0.4)) THEN -0.5 WHEN {_seat} > m - greatest(1, floor(m * 0.4)) THEN 0.5 ELSE 0.0 END", "count(*) AS m, count(x) AS k"), lambda p: x(p).spread(0.4))
_signal = ",\na AS (SELECT ts, count(*) AS m, count(x) AS k, avg(x) AS mean FROM n GROUP BY ts),\nc AS (SELECT n.ts, n.symbol, CASE WHEN k = m THEN x - mean END AS e FROM n JOIN a ON n.ts = a.ts),\ns AS (SELECT ts, sum(abs(e)) AS total FROM c GROUP BY ts),\nz AS (SELECT c.ts, c.symbol, CASE WHEN total >= 1e-10 THEN e / total END AS v FROM c JOIN s ON c.ts = s.ts)"
add("signal", b.cell_sql("v", more=_signal, source="z"), lambda p: x(p).signal())
QUERIES["is_signal"] = lambda spark, sf: b.shown(x(b.events_hourly(spark, sf)).signal().is_signal())
ORACLE_SQL["is_signal"] = f"WITH {b.EVENTS_SQL}{_signal}\nSELECT {b.SHOW_TS.format('')}, coalesce(abs(sum(CASE WHEN v > 0 THEN v ELSE 0 END) - 0.5) <= 0.010005 AND abs(sum(CASE WHEN v < 0 THEN v ELSE 0 END) + 0.5) <= 0.010005 AND count(v) > 0, false) AS is_signal FROM z GROUP BY z.ts"

# Neutralisation, on a month x brand grid
_pair = "count(*) FILTER (price IS NOT NULL AND volume IS NOT NULL) AS k, "
add("vector_neut", b.cross_sql("CASE WHEN price IS NULL OR volume IS NULL OR k < 2 OR yy < 1e-10 OR sd < greatest(1e-10, 1e-4 * abs(mean)) THEN price ELSE price - xy / yy * volume END", _pair + "sum(price * volume) AS xy, sum(volume * volume) FILTER (price IS NOT NULL) AS yy, stddev_pop(volume) FILTER (price IS NOT NULL) AS sd, avg(volume) FILTER (price IS NOT NULL) AS mean", b.BRAND_SQL), lambda p: p.factor("price").vector_neut(p.factor("volume")), b.brand_monthly)
add("regression_neut", b.cross_sql("CASE WHEN k >= 2 AND sxx > 0 THEN price - (icept + slope * volume) END", _pair + "regr_slope(price, volume) AS slope, regr_intercept(price, volume) AS icept, regr_sxx(price, volume) AS sxx", b.BRAND_SQL), lambda p: p.factor("price").regression_neut(p.factor("volume")), b.brand_monthly)
_two = """,
c AS (SELECT ts, count(*) AS k, avg(price) AS my, avg(volume) AS m1, avg(ln(price)) AS m2 FROM n WHERE price IS NOT NULL AND volume IS NOT NULL GROUP BY ts),
s AS (SELECT n.ts, sum((volume - m1) * (volume - m1)) AS a, sum((volume - m1) * (ln(price) - m2)) AS b, sum((ln(price) - m2) * (ln(price) - m2)) AS c, sum((volume - m1) * (price - my)) AS p, sum((ln(price) - m2) * (price - my)) AS q FROM n JOIN c ON n.ts = c.ts WHERE price IS NOT NULL AND volume IS NOT NULL GROUP BY n.ts),
z AS (SELECT n.ts, n.symbol, CASE WHEN volume IS NOT NULL AND k >= 4 THEN price - my - (p * c - q * b) / (a * c - b * b) * (volume - m1) - (a * q - b * p) / (a * c - b * b) * (ln(price) - m2) END AS v FROM n LEFT JOIN c ON n.ts = c.ts LEFT JOIN s ON n.ts = s.ts)"""
add("regression_neut_two", b.cell_sql("v", b.BRAND_SQL, _two, "z").replace(", 6) + 0.0", ", 3) + 0.0"), lambda p: p.factor("price").regression_neut(p.factor("volume"), p.factor("price").ln()), b.brand_monthly, digits=3)

# Groups: brands by number
_groups = {f"Brand#{i}": i % 5 for i in range(1, 26)}
_gsql = b.BRAND_SQL.replace("n AS (SELECT *, row_number()", "n AS (SELECT *, CAST(substr(symbol, 7) AS INTEGER) % 5 AS g, row_number()")


def group(name: str, e: str, aggregates: str, build):
    add(name, b.cross_sql(e, aggregates, _gsql, "ts, g"), lambda p: build(p.factor("price"), p.factor("price").group_map(_groups)), b.brand_monthly)


add("group_map", b.cell_sql("g", _gsql), lambda p: p.factor("price").group_map(_groups), b.brand_monthly)
group("group_neutralize", "price - mean", "avg(price) AS mean", lambda f, g: f.group_neutralize(g))
group("group_mean", "mean", "avg(price) AS mean", lambda f, g: f.group_mean(g))
group("group_median", "mid", "median(price) AS mid", lambda f, g: f.group_median(g))
group("group_rank", "CASE WHEN price IS NOT NULL THEN ((SELECT count(*) FROM n o WHERE o.ts = n.ts AND o.g = n.g AND o.price < n.price) + ((SELECT count(*) FROM n o WHERE o.ts = n.ts AND o.g = n.g AND o.price = n.price) + 1) / 2.0) / k END", "count(price) AS k", lambda f, g: f.group_rank(g))
group("group_scale", "CASE WHEN hi - lo > 1e-10 THEN (price - lo) / (hi - lo) ELSE 0.5 END", "min(price) AS lo, max(price) AS hi", lambda f, g: f.group_scale(g))
group("group_zscore", "CASE WHEN sd > 1e-10 THEN (price - mean) / sd END", "avg(price) AS mean, stddev_samp(price) AS sd", lambda f, g: f.group_zscore(g))
group("group_normalize", "CASE WHEN coalesce(total, 0) > 1e-10 THEN price / total * 2 ELSE 0.0 END", "sum(abs(price)) AS total", lambda f, g: f.group_normalize(g, 2))

# Time series
_full = lambda w, e: f"CASE WHEN count(b.x) = {w} THEN {e} END"
add("ts_delay", b.cell_sql("v", more=",\nt AS (SELECT a.ts, a.symbol, p.x AS v FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 4)", source="t"), lambda p: x(p).ts_delay(4))
add("ts_delta", b.cell_sql("v", more=",\nt AS (SELECT a.ts, a.symbol, a.x - p.x AS v FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 2)", source="t"), lambda p: x(p).ts_delta(2))
add("ts_step", b.cell_sql("i + 4"), lambda p: x(p).ts_step(5))
for _name, _e in (("sum", "sum(b.x)"), ("mean", "avg(b.x)"), ("median", "median(b.x)"), ("std_dev", "stddev_samp(b.x)"), ("min", "min(b.x)"), ("max", "max(b.x)")):
    add(f"ts_{_name}", b.rolling_sql(5, _full(5, _e)), lambda p, _name=_name: getattr(x(p), f"ts_{_name}")(5))
add("ts_product", b.rolling_sql(3, _full(3, "product(b.x / 100)")), lambda p: (x(p) / 100).ts_product(3))
_extreme = ",\nh AS (SELECT a.ts, a.symbol, a.i, {0}(o.x) AS top, count(o.x) AS k FROM n a JOIN n o ON o.symbol = a.symbol AND o.i BETWEEN a.i - 4 AND a.i GROUP BY a.ts, a.symbol, a.i),\nt AS (SELECT h.ts, h.symbol, CASE WHEN k = 5 THEN h.i - min(o.i) END AS v FROM h LEFT JOIN n o ON o.symbol = h.symbol AND o.i BETWEEN h.i - 4 AND h.i AND o.x = top GROUP BY h.ts, h.symbol, h.i, k)"
add("ts_arg_max", b.cell_sql("v", more=_extreme.format("max"), source="t"), lambda p: x(p).ts_arg_max(5))
add("ts_arg_min", b.cell_sql("v", more=_extreme.format("min"), source="t"), lambda p: x(p).ts_arg_min(5))
add("ts_count_nans", b.rolling_sql(4, "CASE WHEN count(b.x) >= 1 THEN count(*) - count(b.x) END"), lambda p: x(p).ts_count_nans(4))
add("ts_av_diff", b.rolling_sql(5, _full(5, "a.x - avg(b.x)")), lambda p: x(p).ts_av_diff(5))
add("ts_rank", b.rolling_sql(5, _full(5, "CASE WHEN min(b.x) < max(b.x) THEN sum(CASE WHEN b.x <= a.x THEN 1 ELSE 0 END) / 5.0 END")), lambda p: x(p).ts_rank(5))
add("ts_scale", b.rolling_sql(5, _full(5, "CASE WHEN max(b.x) - min(b.x) > 1e-10 THEN (a.x - min(b.x)) / (max(b.x) - min(b.x)) + 1 END")), lambda p: x(p).ts_scale(5, 1))
add("ts_zscore", b.rolling_sql(5, _full(5, "CASE WHEN stddev_samp(b.x) > 1e-10 THEN (a.x - avg(b.x)) / stddev_samp(b.x) END")), lambda p: x(p).ts_zscore(5))
_tsq = b.window_step("r", 5, _full(5, "CASE WHEN min(b.x) < max(b.x) THEN sum(CASE WHEN b.x <= a.x THEN 1 ELSE 0 END) / 5.0 END"))
add("ts_quantile", b.cell_sql(_ppf_sql("p"), more=f",\nt AS ({_tsq}),\nq AS (SELECT ts, symbol, CASE WHEN r IS NOT NULL THEN least(greatest(r, 1e-6), 1 - 1e-6) END AS p FROM t)", source="q").replace("round(CASE WHEN p", "round(CASE WHEN p IS NULL THEN NULL WHEN p"), lambda p: x(p).ts_quantile(5))
add("ts_kurtosis", b.cell_sql("v", more=f",\nm AS ({b.window_step('mean', 6, 'avg(b.x)')}),\nt AS (SELECT a.ts, a.symbol, CASE WHEN count(o.x) = 6 AND min(o.x) < max(o.x) THEN avg(power(o.x - mean, 4)) / power(avg(power(o.x - mean, 2)), 2) - 3 END AS v FROM m a JOIN n o ON o.symbol = a.symbol AND o.i BETWEEN a.i - 5 AND a.i GROUP BY a.ts, a.symbol, a.i, mean)", source="t"), lambda p: x(p).ts_kurtosis(6))
add("ts_skewness", b.cell_sql("v", more=f",\nm AS ({b.window_step('e', 4, 'CASE WHEN count(b.x) = 4 THEN a.x - avg(b.x) END')}),\nt AS (SELECT a.ts, a.symbol, CASE WHEN count(o.e) = 4 AND power(sum(o.e * o.e), 1.5) * 6 > 1e-10 THEN 4 * sum(o.e * o.e * o.e) / (power(sum(o.e * o.e), 1.5) * 6) END AS v FROM m a JOIN m o ON o.symbol = a.symbol AND o.i BETWEEN a.i - 3 AND a.i GROUP BY a.ts, a.symbol, a.i)", source="t"), lambda p: x(p).ts_skewness(4))
add("ts_backfill", b.rolling_sql(6, "coalesce(a.x, list(b.x ORDER BY b.i DESC) FILTER (b.x IS NOT NULL)[2])"), lambda p: x(p).ts_backfill(6, 2))
add("ts_decay_exp", b.rolling_sql(5, "CASE WHEN count(b.x) > 0 THEN sum(b.x * power(0.6, a.i - b.i)) / sum(CASE WHEN b.x IS NOT NULL THEN power(0.6, a.i - b.i) END) END"), lambda p: x(p).ts_decay_exp_window(5, 0.6))
add("ts_decay_exp_zero", b.rolling_sql(5, "sum(coalesce(b.x, 0) * power(0.6, a.i - b.i)) / sum(power(0.6, a.i - b.i))"), lambda p: x(p).ts_decay_exp_window(5, 0.6, False))
add("ts_decay_linear", b.rolling_sql(5, "CASE WHEN count(b.x) > 0 THEN sum(coalesce(b.x, 0) * (a.i - b.i + 1)) / sum(a.i - b.i + 1) END"), lambda p: x(p).ts_decay_linear(5))
add("ts_decay_linear_dense", b.rolling_sql(5, "CASE WHEN count(b.x) > 0 THEN list_sum(list_transform(list(b.x ORDER BY b.i DESC) FILTER (b.x IS NOT NULL), lambda v, k: v * k)) / (count(b.x) * (count(b.x) + 1) / 2.0) END"), lambda p: x(p).ts_decay_linear(5, True))
_both = "count(*) FILTER (b.x IS NOT NULL AND b.y IS NOT NULL) = 6"
add("ts_covariance", b.rolling_sql(6, f"CASE WHEN {_both} THEN covar_samp(b.x, b.y) END"), lambda p: x(p).ts_covariance(y(p), 6))
add("ts_corr", b.rolling_sql(6, f"CASE WHEN {_both} AND min(b.x) < max(b.x) AND min(b.y) < max(b.y) THEN corr(b.x, b.y) END"), lambda p: x(p).ts_corr(y(p), 6))
_lagged = "l AS (SELECT a.*, p.x AS z FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - {})"
add("ts_autocorr", b.cell_sql("v", more=f",\n{_lagged.format(2)},\nt AS ({b.window_step('v', 6, 'CASE WHEN count(b.x + b.z) = 6 AND min(b.x) < max(b.x) AND min(b.z) < max(b.z) THEN corr(b.x, b.z) END', 'l')})", source="t"), lambda p: x(p).ts_autocorr(6, 2))
add("ts_cv", b.rolling_sql(5, _full(5, "stddev_samp(b.x) / (abs(avg(b.x)) + 1e-10)")), lambda p: x(p).ts_cv(5))
add("ts_jumpiness", b.cell_sql("v", more=f",\n{_lagged.format(1)},\nt AS ({b.window_step('v', 4, 'CASE WHEN count(b.x) = 4 AND count(b.x - b.z) = 4 AND max(b.x) - min(b.x) > 0 THEN sum(abs(b.x - b.z)) / (max(b.x) - min(b.x) + 1e-10) END', 'l')})", source="t"), lambda p: x(p).ts_jumpiness(4))
add("ts_vr", b.cell_sql("v", more=f",\n{_lagged.format(1)},\nl2 AS (SELECT a.*, p.x AS z2 FROM l a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 2),\nt AS ({b.window_step('v', 5, 'CASE WHEN count(b.x - b.z) = 5 AND count(b.x - b.z2) = 5 THEN var_samp(b.x - b.z2) / (2 * var_samp(b.x - b.z) + 1e-10) END', 'l2')})", source="t"), lambda p: x(p).ts_vr(5, 2))
add("ts_reversal_count", b.cell_sql("v", more=""",
m AS (SELECT a.symbol, a.i, sign(a.x - p.x) AS s FROM n a JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 1 WHERE a.x IS NOT NULL AND p.x IS NOT NULL),
k AS (SELECT a.ts, a.symbol, a.i, count(o.x) AS valid FROM n a JOIN n o ON o.symbol = a.symbol AND o.i BETWEEN a.i - 6 AND a.i GROUP BY a.ts, a.symbol, a.i),
j AS (SELECT k.ts, k.symbol, k.i, valid, m.s, lag(m.s) OVER (PARTITION BY k.symbol, k.i ORDER BY m.i) AS before FROM k LEFT JOIN m ON m.symbol = k.symbol AND m.i BETWEEN k.i - 5 AND k.i),
t AS (SELECT ts, symbol, CASE WHEN valid >= 3 AND count(s) >= 2 THEN sum(CASE WHEN s <> before THEN 1 ELSE 0 END) / (count(s) - 1.0) END AS v FROM j GROUP BY ts, symbol, i, valid)""", source="t"), lambda p: x(p).ts_reversal_count(7))
_regress = "CASE WHEN a.i >= 8 AND count(b.x + b.z) >= 3 AND regr_sxx(b.x, b.z) > 0 THEN {} END"


def regress(name: str, e: str, rettype: int):
    keep = "x, y, d, z"
    sql = b.cell_sql("v", more=f",\n{_lagged.format(1).replace('p.x AS z', 'p.y AS z')},\nt AS ({b.window_step('v', 8, _regress.format(e), 'l', keep)})", source="t")
    add(name, sql, lambda p: x(p).ts_regression(y(p), 8, 1, rettype))


_last = "arg_max({}, b.i) FILTER (b.x IS NOT NULL AND b.z IS NOT NULL)"
_fit = f"(regr_intercept(b.x, b.z) + regr_slope(b.x, b.z) * {_last.format('b.z')})"
_sse = "(regr_syy(b.x, b.z) - regr_sxy(b.x, b.z) * regr_sxy(b.x, b.z) / regr_sxx(b.x, b.z))"
regress("ts_regression_residual", f"{_last.format('b.x')} - {_fit}", 0)
regress("ts_regression_intercept", "regr_intercept(b.x, b.z)", 1)
regress("ts_regression_slope", "regr_slope(b.x, b.z)", 2)
regress("ts_regression_fitted", _fit, 3)
regress("ts_regression_sse", _sse, 4)
regress("ts_regression_sst", "regr_syy(b.x, b.z)", 5)
regress("ts_regression_r2", f"CASE WHEN regr_syy(b.x, b.z) > 0 THEN 1 - {_sse} / regr_syy(b.x, b.z) END", 6)
regress("ts_regression_mse", f"CASE WHEN regr_count(b.x, b.z) > 2 THEN {_sse} / (regr_count(b.x, b.z) - 2) END", 7)
for _name in ("sse", "sst", "mse"):
    ORACLE_SQL[f"ts_regression_{_name}"] = ORACLE_SQL[f"ts_regression_{_name}"].replace(", 6) + 0.0 AS v", ", 3) + 0.0 AS v")
    QUERIES[f"ts_regression_{_name}"] = lambda spark, sf, _k={"sse": 4, "sst": 5, "mse": 7}[_name]: (lambda p: b.answer(x(p).ts_regression(y(p), 8, 1, _k), 3))(b.events_hourly(spark, sf))
_n, _s, _ss = "count(b.x)", "sum(b.i - 1) FILTER (b.x IS NOT NULL)", "sum((b.i - 1) * (b.i - 1)) FILTER (b.x IS NOT NULL)"
_high = f"(({_n} + {_ss}) / 2.0 + sqrt(power(({_n} - {_ss}) / 2.0, 2) + power({_s}, 2)))"
_cond = f"power({_high}, 2) / ({_n} * {_ss} - {_s} * {_s})"
add("ts_trend_strength", b.rolling_sql(6, f"CASE WHEN a.i >= 6 AND {_n} >= 3 AND min(b.x) < max(b.x) AND {_cond} <= 1e10 THEN regr_r2(b.x, b.i - 1) END"), lambda p: x(p).ts_trend_strength(6))


# Grids that differ meet on what they share
def _shared(spark, sf):
    p = b.brand_monthly(spark, sf)
    left, right = p.slice_symbols(["Brand#1", "Brand#2", "Brand#3"]), b.brand_monthly(spark, sf).slice_symbols(["Brand#2", "Brand#3", "Brand#4"])
    return b.answer(left.factor("price") - right.factor("price").ts_delay(1))


QUERIES["align"] = _shared
ORACLE_SQL["align"] = b.cell_sql("v", b.BRAND_SQL, ",\nt AS (SELECT a.ts, a.symbol, a.price - p.price AS v FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 1 WHERE a.symbol IN ('Brand#2', 'Brand#3'))", "t")

# The flagship: three-month momentum, ranked, neutralised against the rank of low volume, as a signal
_momentum = """,
m AS (SELECT a.ts, a.symbol, a.price / p.price - 1 AS mom, -a.volume AS low FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 3),
c AS (SELECT ts, count(*) AS m, count(mom) AS km, count(low) AS kl FROM m GROUP BY ts),
r AS (SELECT m.ts, m.symbol, CASE WHEN km = c.m AND c.m > 1 THEN (SELECT 1.0 + count(*) FROM m o WHERE o.ts = m.ts AND o.mom < m.mom) / c.m END AS f, CASE WHEN kl = c.m AND c.m > 1 THEN (SELECT 1.0 + count(*) FROM m o WHERE o.ts = m.ts AND o.low < m.low) / c.m END AS g FROM m JOIN c ON m.ts = c.ts),
k AS (SELECT ts, sum(f * g) / sum(g * g) FILTER (f IS NOT NULL) AS coef FROM r GROUP BY ts),
z AS (SELECT r.ts, r.symbol, CASE WHEN f IS NOT NULL AND g IS NOT NULL THEN f - coef * g ELSE f END AS e FROM r JOIN k ON r.ts = k.ts),
q AS (SELECT ts, avg(e) AS mean, count(e) AS ke, count(*) AS ka FROM z GROUP BY ts),
u AS (SELECT z.ts, z.symbol, CASE WHEN ke = ka THEN e - mean END AS e FROM z JOIN q ON z.ts = q.ts),
s AS (SELECT ts, sum(abs(e)) AS total FROM u GROUP BY ts),
t AS (SELECT u.ts, u.symbol, CASE WHEN total >= 1e-10 THEN e / total END AS v FROM u JOIN s ON u.ts = s.ts)"""


def momentum(p):
    price, volume = p.factor("price"), p.factor("volume")
    return (price / price.ts_delay(3) - 1).rank().vector_neut((-volume).rank()).signal()


add("momentum_signal", b.cell_sql("v", b.TYPE_SQL, _momentum, "t"), momentum, b.type_monthly)
