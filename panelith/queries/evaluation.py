"""Registered queries for panels, evaluation, backtests, market data and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelith.functions.base import SYMBOL, TS
from panelith.operators import backtest as bt
from panelith.operators import rebalance as rb
from panelith.operators.analysis import Analyzer
from panelith.sources import bars as md

from . import base as b

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


_R = b.rounded

# Panels


@query(f"WITH {b.EVENTS_SQL}\nSELECT count(*) AS n_rows, 3 AS n_columns, count(DISTINCT symbol) AS n_symbols, count(DISTINCT ts) AS n_periods, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) - count(d) AS missing_d, count(*) - count(x) AS missing_x, count(*) - count(y) AS missing_y FROM n")
def panel_info(spark, sf):
    return b.shown(b.events_hourly(spark, sf).info())


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('x')} AS x, {_R('y')} AS y, {_R('d')} AS d FROM n")
def panel_records(spark, sf):
    return b.shown(b.events_hourly(spark, sf).records())


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('x')} AS x FROM n WHERE symbol IN ('click', 'error') AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def panel_slices(spark, sf):
    start, end = (F.to_timestamp(F.lit(t)) for t in ("2024-01-03 00:00:00", "2024-01-09 12:00:00"))
    p = b.events_hourly(spark, sf)
    return b.shown(p.select(["x"]).slice_time(start, end).slice_symbols(["click", "error"]).records())


@query(f"WITH {b.EVENTS_SQL}\nSELECT count(x) AS n_valid, count(*) - count(x) AS n_missing, {_R('avg(x)')} AS mean, {_R('stddev_samp(x)')} AS std, {_R('min(x)')} AS min, {_R('max(x)')} AS max FROM n")
def factor_info(spark, sf):
    return b.shown(b.events_hourly(spark, sf).factor("x").info())


@query(f"WITH {b.BRAND_SQL}\nSELECT symbol, {_R('price')} AS weight FROM n WHERE ts = (SELECT max(ts) FROM n) AND price IS NOT NULL")
def factor_weights(spark, sf):
    return b.shown(b.brand_monthly(spark, sf).factor("price").weights())


@query(f"WITH {b.ORDERS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('total')} AS total, {_R('n')} AS n FROM n")
def orders_panel(spark, sf):
    return b.shown(b.orders_monthly(spark, sf).frame)


# Evaluation: three factors, two horizons, on the month x brand grid

_FORWARD = """,
f AS (SELECT a.ts, a.symbol, a.i, a.price, a.volume, a.price / p.price - 1 AS mom, b1.price / a.price - 1 AS r1, b3.price / a.price - 1 AS r3 FROM n a
  LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 2 LEFT JOIN n b1 ON b1.symbol = a.symbol AND b1.i = a.i + 1 LEFT JOIN n b3 ON b3.symbol = a.symbol AND b3.i = a.i + 3),
u AS (SELECT ts, symbol, unnest(['price', 'volume', 'mom']) AS factor, unnest([price, volume, mom]) AS f, r1, r3 FROM f),
v AS (SELECT ts, symbol, factor, 1 AS horizon, f, r1 AS r FROM u UNION ALL SELECT ts, symbol, factor, 3, f, r3 FROM u)"""
_RANKED = """,
w AS (SELECT ts, symbol, factor, horizon, CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY ts, factor, horizon ORDER BY f NULLS LAST) + (count(*) OVER (PARTITION BY ts, factor, horizon, f) - 1) / 2.0 END AS f,
  CASE WHEN r IS NOT NULL THEN rank() OVER (PARTITION BY ts, factor, horizon ORDER BY r NULLS LAST) + (count(*) OVER (PARTITION BY ts, factor, horizon, r) - 1) / 2.0 END AS r FROM v)"""
_SERIES = """,
c AS (SELECT *, f - avg(f) OVER (PARTITION BY ts, factor, horizon) AS fd, r - avg(r) OVER (PARTITION BY ts, factor, horizon) AS rd FROM {0}),
s AS (SELECT factor, horizon, ts, CASE WHEN count(f + r) >= 3 AND stddev_samp(f) > 1e-10 AND stddev_samp(r) > 1e-10 THEN sum(fd * rd) / sqrt(sum(fd * fd) * sum(rd * rd)) END AS ic FROM c GROUP BY factor, horizon, ts)"""
_STATS = "SELECT factor, horizon, {0} AS ic_mean, {1} AS ic_std, {2} AS ir, {3} AS t_stat, count(ic) AS n FROM s GROUP BY factor, horizon".format(_R("avg(ic)"), _R("stddev_pop(ic)"), _R("avg(ic) / stddev_pop(ic)"), _R("avg(ic) / stddev_pop(ic) * sqrt(count(ic))"))


def _analyzer(spark, sf) -> Analyzer:
    p = b.brand_monthly(spark, sf)
    price, volume = p.factor("price"), p.factor("volume")
    return Analyzer([price, volume, (price / price.ts_delay(2) - 1).rename("mom")], price, [1, 3])


@query(f"WITH {b.BRAND_SQL}{_FORWARD}{_RANKED}{_SERIES.format('w')}\n{_STATS}")
def ic_spearman(spark, sf):
    return b.shown(_analyzer(spark, sf).ic("spearman"))


@query(f"WITH {b.BRAND_SQL}{_FORWARD}{_SERIES.format('v')}\n{_STATS}")
def ic_pearson(spark, sf):
    return b.shown(_analyzer(spark, sf).ic("pearson"))


@query(f"WITH {b.BRAND_SQL}{_FORWARD}{_RANKED}{_SERIES.format('w')}\nSELECT factor, horizon, {b.SHOW_TS.format('')}, {_R('ic')} AS ic FROM s WHERE ic IS NOT NULL")
def ic_series(spark, sf):
    return b.shown(_analyzer(spark, sf).ic_series().drop("at"))


@query(b.cell_sql("v", b.BRAND_SQL, ",\nt AS (SELECT a.ts, a.symbol, q.price / a.price - 1 AS v FROM n a LEFT JOIN n q ON q.symbol = a.symbol AND q.i = a.i + 2)", "t"))
def forward_returns(spark, sf):
    return b.answer(_analyzer(spark, sf).forward_returns(2))


_SIGNALS = """,
z0 AS (SELECT ts, unnest(['price', 'volume', 'mom']) AS factor, unnest([price, volume, mom]) AS f, symbol FROM f),
z1 AS (SELECT *, CASE WHEN count(f) OVER (PARTITION BY ts, factor) = count(*) OVER (PARTITION BY ts, factor) THEN f - avg(f) OVER (PARTITION BY ts, factor) END AS e FROM z0),
z2 AS (SELECT ts, symbol, factor, e / sum(abs(e)) OVER (PARTITION BY ts, factor) AS v FROM z1),
z3 AS (SELECT ts, symbol, max(v) FILTER (factor = 'price') AS a, max(v) FILTER (factor = 'volume') AS b, max(v) FILTER (factor = 'mom') AS c FROM z2 GROUP BY ts, symbol),
z4 AS (SELECT * FROM z3 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)"""
_RANK_ALL = ",\nz5 AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS c FROM z4)"


def _matrix(source: str, one) -> str:
    names = {"a": "price", "b": "volume", "c": "mom"}
    return "\nUNION ALL ".join(f"SELECT '{names[i]}' AS factor_a, '{names[j]}' AS factor_b, {_R(one(i, j))} AS corr, count(*) AS n_obs FROM {source}" for i in names for j in names)


@query(f"WITH {b.BRAND_SQL}{_FORWARD}{_SIGNALS}\n" + _matrix("z4", lambda i, j: f"corr({i}, {j})"))
def correlation_pearson(spark, sf):
    return b.shown(_analyzer(spark, sf).correlation("pearson"))


@query(f"WITH {b.BRAND_SQL}{_FORWARD}{_SIGNALS}{_RANK_ALL}\n" + _matrix("z5", lambda i, j: f"corr({i}, {j})"))
def correlation_spearman(spark, sf):
    return b.shown(_analyzer(spark, sf).correlation("spearman"))


_TAU = "(SELECT sum(sign(p.{0} - q.{0}) * sign(p.{1} - q.{1})) / sqrt(sum(CASE WHEN p.{0} <> q.{0} THEN 1 ELSE 0 END)) / sqrt(sum(CASE WHEN p.{1} <> q.{1} THEN 1 ELSE 0 END)) FROM z4 p JOIN z4 q ON (p.ts, p.symbol) < (q.ts, q.symbol))"


@query(f"WITH {b.BRAND_SQL}{_FORWARD}{_SIGNALS}\n" + _matrix("z4", lambda i, j: _TAU.format(i, j)))
def correlation_kendall(spark, sf):
    return b.shown(_analyzer(spark, sf).correlation("kendall"))


_COVER = """,
k AS (SELECT symbol, i, x, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY ts, x) - 1) / 2.0) / count(x) OVER (PARTITION BY ts) END AS r FROM n),
m AS (SELECT a.symbol, avg(abs(a.r - p.r)) AS m FROM k a JOIN k p ON p.symbol = a.symbol AND p.i = a.i - 1 GROUP BY a.symbol),
o AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY i) AS j FROM n WHERE x IS NOT NULL),
h AS (SELECT a.symbol, corr(a.x, p.x) AS r FROM o a JOIN o p ON p.symbol = a.symbol AND p.j = a.j + 1 GROUP BY a.symbol HAVING count(*) >= 10)"""


@query(f"WITH {b.EVENTS_SQL}{_COVER}\nSELECT 'x' AS factor, (SELECT {_R('count(x) / CAST(count(*) AS DOUBLE)')} FROM n) AS coverage, (SELECT {_R('2 * avg(m)')} FROM m) AS turnover, (SELECT {_R('avg(r)')} FROM h) AS autocorr")
def factor_stats(spark, sf):
    x = b.events_hourly(spark, sf).factor("x")
    return b.shown(Analyzer([x], x).stats())


# Backtests: the signal of a price reversal on whole months

_WEIGHTS = """,
w0 AS (SELECT a.ts, a.symbol, a.i, a.price, a.price / p.price - 1 AS gain, p.price / a.price - 1 AS back FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 1),
w1 AS (SELECT *, CASE WHEN count(back) OVER (PARTITION BY ts) = count(*) OVER (PARTITION BY ts) THEN back - avg(back) OVER (PARTITION BY ts) END AS e FROM w0),
w2 AS (SELECT *, e / sum(abs(e)) OVER (PARTITION BY ts) AS w FROM w1),
d AS (SELECT a.ts, sum(a.gain * q.w) AS g, count(o.w) AS k FROM w2 a LEFT JOIN w2 o ON o.symbol = a.symbol AND o.i = a.i - 1 LEFT JOIN w2 q ON q.symbol = a.symbol AND q.i = a.i - 2 GROUP BY a.ts),
e AS (SELECT ts, row_number() OVER (ORDER BY ts) AS j, 1000 * exp(sum(ln(1 + coalesce(g, 0))) OVER (ORDER BY ts)) AS value FROM d WHERE k > 0)"""


def _reversal(spark, sf):
    p = b.type_monthly(spark, sf)
    price = p.factor("price")
    return price, (price.ts_delay(1) / price - 1).signal()


@query(f"WITH {b.TYPE_SQL}{_WEIGHTS}\nSELECT {b.SHOW_TS.format('')}, {_R('value', 4)} AS value FROM e")
def backtest_closed_form(spark, sf):
    return b.shown(bt.zero_cost_equity(*_reversal(spark, sf)), 4)


@query(f"WITH {b.TYPE_SQL}{_WEIGHTS}\nSELECT 'reversal' AS strategy, {b.SHOW_TS.format('')}, {_R('value', 4)} AS value FROM e")
def backtest_equity(spark, sf):
    price, weight = _reversal(spark, sf)
    run = bt.Backtester(price, {"reversal": weight}, buy=0.0, sell=0.0)
    return b.shown(run.equity().where("not seed").drop("seed"), 4)


_RETURNS = f"""WITH {b.TYPE_SQL}{_WEIGHTS},
r AS (SELECT a.ts, a.j - 1 AS j, a.value / p.value - 1 AS ret, a.value / 1000 AS equity FROM e a JOIN e p ON p.j = a.j - 1),
y AS (SELECT *, equity / max(equity) OVER (ORDER BY j) - 1 AS dd FROM r)"""


def _returns(spark, sf):
    price, weight = _reversal(spark, sf)
    equity = bt.zero_cost_equity(price, weight).withColumn(bt.STRATEGY, F.lit("reversal"))
    return bt.returns_of(equity)


@query(f"""{_RETURNS},
q AS (SELECT *, quantile_cont(ret, 0.05) OVER () AS q FROM y),
t AS (SELECT count(*) AS n, arg_max(equity, j) - 1 AS tot, date_diff('day', min(ts), max(ts)) AS days, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS down, avg(ret) AS mean, min(dd) AS mdd, corr(j, equity) AS lin, max(q) AS v, avg(ret) FILTER (ret <= q) AS cv FROM q),
a AS (SELECT *, power(1 + tot, 365.0 / days) - 1 AS ann FROM t)
SELECT 'reversal' AS strategy, {_R('tot', 5)} AS total_return, {_R('ann', 5)} AS annual_return, {_R('sd * sqrt(365)', 5)} AS annual_volatility, {_R('(ann - 0.03) / (sd * sqrt(365))', 5)} AS sharpe_ratio, {_R('(ann - 0.03) / (down * sqrt(365))', 5)} AS sortino_ratio, {_R('ann / -mdd', 5)} AS calmar_ratio, {_R('mdd', 5)} AS max_drawdown, {_R('lin * lin', 5)} AS linearity, {_R('v', 5)} AS var_95, {_R('cv', 5)} AS cvar FROM a""")
def backtest_metrics(spark, sf):
    return b.shown(bt.performance_metrics(_returns(spark, sf), 0.03).drop("psr"), 5)


@query(f"""{_RETURNS},
m AS (SELECT *, dd < -1e-6 AS under, coalesce(lag(dd) OVER (ORDER BY j) < -1e-6, false) AS before FROM y),
s AS (SELECT *, sum(CASE WHEN under AND NOT before THEN 1 ELSE 0 END) OVER (ORDER BY j) AS spell, lead(ts) OVER (ORDER BY j) AS next FROM m)
SELECT 'reversal' AS strategy, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(coalesce(arg_max_null(next, j), max(ts)), '%Y-%m-%d %H:%M:%S') AS "end", {_R('min(dd)')} AS depth, date_diff('day', min(ts), coalesce(arg_max_null(next, j), max(ts))) AS duration_days FROM s WHERE under GROUP BY spell""")
def drawdown_periods(spark, sf):
    return b.shown(bt.drawdown_periods(_returns(spark, sf)))


@query(f"{_RETURNS}\nSELECT 'reversal' AS strategy, {b.SHOW_TS.format('')}, {_R('ret')} AS ret FROM r")
def backtest_returns(spark, sf):
    return b.shown(_returns(spark, sf))


# Market data: bars made of the events


def _bars(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias(SYMBOL), F.date_trunc("hour", "ts").alias(TS), F.col("ts").alias("at"), F.col("value").cast("double").alias("v"), "event_id")
    return e.groupBy(SYMBOL, TS).agg(F.min_by("v", "event_id").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))


_BARS = "k AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"


@query(f"WITH {_BARS}\nSELECT symbol, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS ts, {_R('sum((high + low + close) / 3 * volume) / sum(volume)')} AS vwap FROM k GROUP BY symbol, date_trunc('day', ts)")
def vwap_daily(spark, sf):
    return b.shown(md.vwap(_bars(spark, sf), "1d"))


@query(f"WITH {_BARS}\nSELECT a.symbol, {b.SHOW_TS.format('a.')}, {_R('sum((p.high + p.low + p.close) / 3 * p.volume) / sum(p.volume)')} AS vwap FROM k a JOIN k p ON p.symbol = a.symbol AND date_trunc('day', p.ts) = date_trunc('day', a.ts) AND p.ts <= a.ts GROUP BY a.symbol, a.ts")
def vwap_intraday(spark, sf):
    return b.shown(md.vwap(_bars(spark, sf), "1h"))


@query(f"""WITH {_BARS},
s AS (SELECT max(t) AS lo, (SELECT max(ts) FROM k) AS hi FROM (SELECT min(ts) AS t FROM k GROUP BY symbol)),
g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s, (SELECT DISTINCT symbol FROM k WHERE symbol <> 'view'))
SELECT {b.SHOW_TS.format('g.')}, g.symbol, {_R('last_value(close IGNORE NULLS) OVER w')} AS close, {_R('last_value(volume IGNORE NULLS) OVER w')} AS volume FROM g LEFT JOIN k ON k.symbol = g.symbol AND k.ts = g.ts WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts)""")
def aligned_bars(spark, sf):
    symbols = ["click", "error", "purchase", "signup"]
    return b.shown(md.to_panel(_bars(spark, sf).select(SYMBOL, TS, "close", "volume"), symbols, "1h").frame)


@query("""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(year(ts) AS DOUBLE) AS year, CAST(month(ts) AS DOUBLE) AS month, CAST(day(ts) AS DOUBLE) AS day, CAST(isodow(ts) AS DOUBLE) AS dayofweek, CAST(1 + floor((day(ts) - 1) / 10) AS DOUBLE) AS dayofmonth_position, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END AS is_week_end
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-28', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)) AS ts), (SELECT DISTINCT event_type AS symbol FROM events)""")
def calendar(spark, sf):
    symbols = [r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().collect()]
    return b.shown(md.calendar(spark, symbols, "1d", "2024-01-28", "2024-03-02"))


@query(f"WITH {_BARS}\nSELECT s.symbol, {b.SHOW_TS.format('t.')}, {_R('c.close')} AS click_close, {_R('v.close')} AS view_close FROM (SELECT DISTINCT ts FROM k WHERE symbol IN ('click', 'view')) t, (SELECT unnest(['error', 'signup']) AS symbol) s LEFT JOIN k c ON c.symbol = 'click' AND c.ts = t.ts LEFT JOIN k v ON v.symbol = 'view' AND v.ts = t.ts")
def benchmark_closes(spark, sf):
    return b.shown(md.benchmark(_bars(spark, sf), ["error", "signup"], ("click", "view")))


@query(f"""WITH {_BARS},
o AS (SELECT CASE WHEN symbol = 'view' THEN 'click' ELSE symbol END AS symbol, ts, close, volume FROM k WHERE ts < TIMESTAMP '2024-01-15' AND symbol <> 'click'),
m AS (SELECT symbol, ts, close, volume FROM o UNION ALL SELECT symbol, ts, close, volume FROM k WHERE ts >= TIMESTAMP '2024-01-15' AND symbol <> 'view'),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM m WHERE symbol = 'click'), (SELECT max(ts) FROM m WHERE symbol = 'click'), INTERVAL 1 HOUR)) AS ts)
SELECT symbol, {b.SHOW_TS.format('')}, {_R('close')} AS close, {_R('volume')} AS volume FROM m WHERE symbol <> 'click'
UNION ALL SELECT 'click', {b.SHOW_TS.format('g.')}, {_R('last_value(close IGNORE NULLS) OVER (ORDER BY g.ts)')}, {_R('coalesce(volume, 0)')} FROM g LEFT JOIN m ON m.symbol = 'click' AND m.ts = g.ts""")
def renamed_symbol(spark, sf):
    k = _bars(spark, sf).select(SYMBOL, TS, "close", "volume")
    cut = F.to_timestamp(F.lit("2024-01-15"))
    return b.shown(md.splice_rename(k.where((F.col(TS) < cut) & (F.col(SYMBOL) != "click")), k.where((F.col(TS) >= cut) & (F.col(SYMBOL) != "view")), "view", "click", "1h"))


@query(f"""WITH {_BARS}
SELECT coalesce(a.symbol, v.symbol) AS symbol, strftime(coalesce(a.ts, v.ts), '%Y-%m-%d %H:%M:%S') AS ts, {_R('coalesce(a.close, v.close)')} AS close, {_R('v.volume')} AS volume FROM (SELECT * FROM k WHERE symbol <> 'view') a FULL JOIN (SELECT * FROM k WHERE symbol <> 'click') v ON a.symbol = v.symbol AND a.ts = v.ts""")
def merged_sources(spark, sf):
    k = _bars(spark, sf)
    return b.shown(md.merge([k.where(F.col(SYMBOL) != "view").select(SYMBOL, TS, "close"), k.where(F.col(SYMBOL) != "click").select(SYMBOL, TS, "close", "volume")]))


# Rebalancing: customers' balances against weights by segment


def _legs(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), F.col("c_acctbal").cast("double").alias("bal"), "c_nationkey", "c_custkey")
    weights = c.where("c_nationkey < 18").select("symbol", F.when(F.col("c_nationkey") < 3, 0.0).otherwise((F.col("c_nationkey") - 8) / 100).alias("weight"))
    positions = c.where("c_nationkey > 4").select("symbol", F.round(F.col("bal"), 2).alias("current_usd"))
    specs = c.where("c_custkey % 7 <> 0").select(
        F.concat("symbol", F.lit("-USDT-SWAP")).alias("inst_id"), F.when(F.col("c_custkey") % 11 == 0, "suspend").otherwise("live").alias("state"), F.lit(0.1).alias("ct_val"), F.lit(0.0).alias("ct_mult"),
        F.lit(0.5).alias("lot_sz"), F.lit(2.0).alias("min_sz"), F.lit(900.0).alias("max_mkt_sz"), (F.col("c_custkey") % 13 + 20).cast("double").alias("price"),
    )
    return rb.plan(weights, positions, 50_000.0, specs)


_PLAN = """c AS (SELECT 'C' || c_custkey AS symbol, CAST(c_acctbal AS DOUBLE) AS bal, c_nationkey AS nk, c_custkey AS ck FROM customer),
w AS (SELECT symbol, CASE WHEN nk < 3 THEN 0.0 ELSE (nk - 8) / 100.0 END AS weight FROM c WHERE nk < 18),
p AS (SELECT symbol, round(bal, 2) AS cur FROM c WHERE nk > 4),
l AS (SELECT coalesce(w.symbol, p.symbol) AS symbol, coalesce(weight, 0) AS weight, CAST(coalesce(weight, 0) AS DOUBLE) * 50000 AS tgt, coalesce(cur, 0) AS cur FROM w FULL JOIN p ON w.symbol = p.symbol),
a AS (SELECT l.*, CASE WHEN abs(tgt - cur) < 1 THEN 'skip' WHEN tgt = 0 THEN 'close' WHEN cur = 0 THEN 'open' WHEN (cur > 0) <> (tgt > 0) THEN 'flip' WHEN abs(tgt) > abs(cur) THEN 'add' ELSE 'reduce' END AS action, CASE WHEN ck % 7 <> 0 THEN CAST(ck % 13 + 20 AS DOUBLE) END AS price, ck % 11 = 0 AS halted FROM l JOIN c ON c.symbol = l.symbol),
z AS (SELECT *, floor(abs(tgt - cur) / (price * 0.1) / 0.5 + 1e-9) * 0.5 AS size FROM a),
y AS (SELECT *, CASE WHEN action = 'skip' THEN 'change too small' WHEN price IS NULL THEN 'no specification or price' WHEN halted THEN 'not tradable' WHEN size < 2 THEN 'below the least order size' WHEN size > 900 THEN 'above the largest market order' END AS note FROM z)"""


@query(f"""WITH {_PLAN}
SELECT symbol, symbol || '-USDT-SWAP' AS inst_id, {_R('weight')} AS weight, {_R('tgt')} AS target_usd, {_R('cur')} AS current_usd, action, CASE WHEN note IS NULL THEN CASE WHEN tgt > cur THEN 'buy' ELSE 'sell' END END AS side, CASE WHEN note IS NULL THEN {_R('size')} END AS contracts, note IS NULL AND action IN ('close', 'reduce') AS reduce_only, {_R("CASE WHEN note IS NULL THEN size * price * 0.1 ELSE 0.0 END")} AS order_usd, note FROM y""")
def rebalance_plan(spark, sf):
    return b.shown(_legs(spark, sf))


@query(f"""WITH {_PLAN}
SELECT {_R('sum(abs(cur))', 3)} AS gross_current, {_R('sum(abs(tgt))', 3)} AS gross_target, {_R('sum(abs(cur)) / 50000', 3)} AS current_leverage, {_R('sum(abs(tgt)) / 50000', 3)} AS target_leverage, {", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in ("skip", "open", "add", "reduce", "close", "flip"))} FROM y""")
def rebalance_exposure(spark, sf):
    return b.shown(rb.exposure(_legs(spark, sf), 50_000.0), 3)
