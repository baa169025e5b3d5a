"""Registered queries for sources and sinks, access, fits on two regressors, backtests with costs, and parsing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from panelith.functions.base import SYMBOL, TS
from panelith.operators import backtest as bt
from panelith.operators import rebalance as rb
from panelith.plans.panel import Panel
from panelith.sources import bars as md
from panelith.sources import panel_csv

from . import base as b
from .evaluation import _BARS, _WEIGHTS, _bars, _reversal

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_R = b.rounded


def query(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _folder(spark) -> str:
    """A new folder that all executors share; a local session has one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelith-")
    return f"{base.rstrip('/')}/csv-{uuid.uuid4().hex}"


# Sources and sinks


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('x')} AS x, {_R('y')} AS y, {_R('d')} AS d FROM n")
def panel_csv_round_trip(spark, sf):
    path = _folder(spark)
    panel_csv.write_panel(b.events_hourly(spark, sf), path)
    return b.shown(panel_csv.read_panel(spark, path, "timestamp").records())


@query(f"WITH {b.BRAND_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('price')} AS factor FROM n")
def factor_csv(spark, sf):
    path = _folder(spark)
    panel_csv.write_factor(b.brand_monthly(spark, sf).factor("price"), path)
    return b.shown(spark.read.csv(path, header=True, schema=f"{TS} timestamp, {SYMBOL} string, factor double"))


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('x')} AS x FROM n")
def panel_from_records(spark, sf):
    rows = b.events_hourly(spark, sf).select(["x"]).records().where("x is not null").collect()  # one panel's records, as a caller has them
    panel = Panel.from_records(spark, ["x"], [(r[TS], r[SYMBOL], -1.0) for r in rows[:50]] + [tuple(r) for r in rows])
    return b.shown(panel.frame.select(F.col(TS).cast("timestamp").alias(TS), SYMBOL, "x"))


@query(f"WITH {_BARS}\nSELECT symbol, {b.SHOW_TS.format('')}, {_R('open')} AS open, {_R('high')} AS high, {_R('low')} AS low, {_R('close')} AS close, {_R('volume')} AS volume FROM k")
def parsed_klines(spark, sf):
    text = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    line = F.concat(F.lit("["), F.concat_ws(",", F.unix_millis(F.col(TS).cast("timestamp")).cast("string"), *map(text, md.OHLCV), F.lit("0")), F.lit("]"))
    return b.shown(md.parse_klines(_bars(spark, sf).select(SYMBOL, line.alias("json"))))


@query("SELECT DISTINCT event_type AS symbol FROM events")
def parsed_symbols(spark, sf):
    names = F.array_join(F.transform(F.collect_set("event_type"), lambda s: F.concat(F.lit('{"status":"TRADING","symbol":"'), s, F.lit('"}'))), ",")
    lists = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("event_id") % 3).alias("k")).agg(F.concat(F.lit('{"symbols":['), names, F.lit("]}")).alias("json"))
    return md.parse_symbols(lists)


@query(f"""WITH {_BARS},
s AS (SELECT max(t) AS lo, (SELECT max(ts) FROM k WHERE symbol IN ('click', 'error')) AS hi FROM (SELECT min(ts) AS t FROM k WHERE symbol IN ('click', 'error') GROUP BY symbol)),
v AS (SELECT a.symbol, a.ts, sum((p.high + p.low + p.close) / 3 * p.volume) / sum(p.volume) AS vwap FROM k a JOIN k p ON p.symbol = a.symbol AND date_trunc('day', p.ts) = date_trunc('day', a.ts) AND p.ts <= a.ts WHERE a.ts <= date_trunc('day', (SELECT hi FROM s)) GROUP BY a.symbol, a.ts),
g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s, (SELECT unnest(['click', 'error']) AS symbol))
SELECT {b.SHOW_TS.format('g.')}, g.symbol, {", ".join(f"{_R(f'last_value({c} IGNORE NULLS) OVER w')} AS {c}" for c in ("open", "high", "low", "close", "volume", "vwap"))}
FROM g LEFT JOIN k ON k.symbol = g.symbol AND k.ts = g.ts LEFT JOIN v ON v.symbol = g.symbol AND v.ts = g.ts WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts)""")
def fetched_sources(spark, sf):
    return b.shown(md.fetch(_bars(spark, sf), ["click", "error"], "1h", ["ohlcv", "vwap"]).frame)


# Access


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('x')} AS value FROM n WHERE ts = TIMESTAMP '2024-01-05 07:00:00'")
def factor_row(spark, sf):
    return b.shown(b.events_hourly(spark, sf).factor("x").row(F.to_timestamp(F.lit("2024-01-05 07:00:00"))))


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, symbol, {_R('x')} AS value FROM n WHERE symbol = 'error'")
def factor_series(spark, sf):
    return b.shown(b.events_hourly(spark, sf).factor("x").series("error"))


@query(f"WITH {b.BRAND_SQL}\nSELECT symbol, {_R('price')} AS value FROM n WHERE ts = (SELECT min(ts) FROM n) AND symbol IN ('Brand#1', 'Brand#3')")
def factor_get(spark, sf):
    price = b.brand_monthly(spark, sf).factor("price")
    first = price.panel.timestamps().first()[TS]
    return b.shown(spark.createDataFrame([(s, price.get(first, s)) for s in ("Brand#1", "Brand#3")], "symbol string, value double"))


@query(f"WITH {b.EVENTS_SQL}\nSELECT 'ts' AS axis, strftime(ts, '%Y-%m-%d %H:%M:%S') AS key FROM n GROUP BY ts UNION ALL SELECT 'symbol', symbol FROM n GROUP BY symbol")
def panel_axes(spark, sf):
    p = b.events_hourly(spark, sf)
    return p.timestamps().select(F.lit("ts").alias("axis"), F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("key")).unionByName(p.symbols().select(F.lit("symbol").alias("axis"), F.col(SYMBOL).alias("key")))


@query(f"WITH {b.EVENTS_SQL}\nSELECT {b.SHOW_TS.format('')}, CASE symbol WHEN 'click' THEN 'ETH' WHEN 'error' THEN 'SOL' WHEN 'purchase' THEN 'ARB' WHEN 'signup' THEN 'OP' ELSE symbol END AS symbol, CASE WHEN symbol IN ('click', 'error') THEN 1.0 WHEN symbol IN ('purchase', 'signup') THEN 2.0 END AS v FROM n")
def group_named(spark, sf):
    names = {"click": "ETH", "error": "SOL", "purchase": "ARB", "signup": "OP"}
    lookup = F.create_map(*[F.lit(v) for p in names.items() for v in p])
    frame = b.events_hourly(spark, sf).frame.withColumn(SYMBOL, F.coalesce(F.try_element_at(lookup, F.col(SYMBOL)), F.col(SYMBOL)))
    return b.answer(Panel(frame, ["x", "y", "d"]).factor("x").group_named("SECTOR_L1_L2"))


# Rolling fits: the kinds that need a lag of 0, a second regressor, or are standard errors


def _two(e: str) -> str:
    """A figure of the fit of d on u = x / 100 delayed by one and y delayed by one, over 9 rows, from centred sums."""
    return b.cell_sql("v", more=f""",
l AS (SELECT a.ts, a.symbol, a.i, a.d, CASE WHEN a.d IS NOT NULL AND p.x IS NOT NULL AND p.y IS NOT NULL THEN p.x / 100 END AS u, p.y AS z FROM n a LEFT JOIN n p ON p.symbol = a.symbol AND p.i = a.i - 1),
m AS (SELECT a.ts, a.symbol, a.i, count(b.u) AS n, avg(b.d) FILTER (b.u IS NOT NULL) AS md, avg(b.u) AS mu, avg(b.z) FILTER (b.u IS NOT NULL) AS mz FROM l a LEFT JOIN l b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 8 AND a.i AND b.u IS NOT NULL GROUP BY ALL),
s AS (SELECT m.*, sum((b.u - mu) * (b.u - mu)) AS suu, sum((b.z - mz) * (b.z - mz)) AS szz, sum((b.u - mu) * (b.z - mz)) AS suz, sum((b.u - mu) * (b.d - md)) AS sud, sum((b.z - mz) * (b.d - md)) AS szd, sum((b.d - md) * (b.d - md)) AS sdd,
  arg_max(b.d, b.i) AS ld, arg_max(b.u, b.i) AS lu, arg_max(b.z, b.i) AS lz FROM m LEFT JOIN l b ON b.symbol = m.symbol AND b.i BETWEEN m.i - 8 AND m.i AND b.u IS NOT NULL GROUP BY ALL),
f AS (SELECT *, suu * szz - suz * suz AS det, (szz * sud - suz * szd) / nullif(suu * szz - suz * suz, 0) AS bu, (suu * szd - suz * sud) / nullif(suu * szz - suz * suz, 0) AS bz FROM s),
t AS (SELECT ts, symbol, CASE WHEN i >= 9 AND n >= 4 AND det > 1e-9 * suu * szz THEN {e} END AS v FROM (SELECT *, md - bu * mu - bz * mz AS c, greatest(0, sdd - bu * sud - bz * szd) AS sse FROM f))""", source="t")


def two(name: str, rettype: int, e: str, digits: int = 5):
    def run(spark, sf):
        p = b.events_hourly(spark, sf)
        return b.answer(p.factor("d").ts_regression([p.factor("x") / 100, p.factor("y")], 9, 1, rettype), digits)

    QUERIES[f"ts_regression_two_{name}"] = run
    ORACLE_SQL[f"ts_regression_two_{name}"] = _two(e).replace(b.rounded("v"), b.rounded("v", digits))


two("residual", 0, "ld - (c + bu * lu + bz * lz)", 4)
two("intercept", 1, "c", 4)
two("slope", 2, "bu", 4)
two("fitted", 3, "c + bu * lu + bz * lz", 4)
two("sse", 4, "sse", 2)
two("sst", 5, "sdd", 2)
two("r2", 6, "CASE WHEN sdd > 0 THEN 1 - sse / sdd END", 4)
two("mse", 7, "CASE WHEN n > 3 THEN sse / (n - 3) END", 2)
two("second_error", 8, "CASE WHEN n > 3 AND sse > 1e-9 THEN sqrt(sse / (n - 3) * suu / det) END", 4)
two("intercept_error", 9, "CASE WHEN n > 3 AND sse > 1e-9 THEN sqrt(sse / (n - 3) * (1.0 / n + (mu * mu * szz - 2 * mu * mz * suz + mz * mz * suu) / det)) END", 4)
two("first_slope", 100, "bu", 4)
two("second_slope", 101, "bz", 4)
two("no_such_slope", 102, "CAST(NULL AS DOUBLE)", 4)


def one(name: str, rettype: int, e: str):
    """Without a lag, on the one regressor x."""
    both = "FILTER (b.x IS NOT NULL AND b.y IS NOT NULL)"
    n = f"count(*) {both}"
    sql = b.rolling_sql(8, f"CASE WHEN a.i >= 8 AND {n} >= 3 AND regr_sxx(b.y, b.x) > 0 THEN {e} END").replace(b.rounded("v"), b.rounded("v", 4))
    QUERIES[f"ts_regression_{name}"] = lambda spark, sf: (lambda p: b.answer(p.factor("y").ts_regression(p.factor("x"), 8, 0, rettype), 4))(b.events_hourly(spark, sf))
    ORACLE_SQL[f"ts_regression_{name}"] = sql


_n, _sse = "regr_count(b.y, b.x)", "(regr_syy(b.y, b.x) - power(regr_sxy(b.y, b.x), 2) / regr_sxx(b.y, b.x))"
one("intercept_error", 9, f"CASE WHEN {_n} > 2 AND {_sse} > 1e-9 THEN sqrt({_sse} / ({_n} - 2) * (sum(b.x * b.x) FILTER (b.y IS NOT NULL)) / ({_n} * regr_sxx(b.y, b.x))) END")
one("first_slope", 100, "regr_slope(b.y, b.x)")
one("second_error", 8, "CAST(NULL AS DOUBLE)")


# Backtests with costs, on whole months: a recursion over dates that carries the value and the holdings


def _costs(full: bool, select: str) -> str:
    spent = "list_sum(list_transform(s.held, lambda x: abs(x))) + list_sum(list_transform(s.goal, lambda x: abs(x)))" if full else "list_sum(list_transform(list_zip(s.goal, s.held), lambda x: abs(x[1] - x[2])))"
    step = f"""SELECT s.strategy, q.i, q.ts, q.w, s.value - 0.0003 * ({spent}) + list_sum(list_transform(list_zip(s.goal, q.r), lambda x: x[1] * (x[2] - 1))) AS value,
    list_transform(list_zip(s.goal, q.r), lambda x: x[1] * x[2]) AS held FROM s JOIN q ON q.strategy = s.strategy AND q.i = s.i + 1"""
    return f"""WITH RECURSIVE {b.TYPE_SQL}{_WEIGHTS},
h AS (SELECT unnest(['reversal', 'momentum']) AS strategy, unnest([1.0::DOUBLE, -1.0::DOUBLE]) AS side),
q AS (SELECT h.strategy, a.i, a.ts, list(h.side * p.w ORDER BY a.symbol) AS w, list(a.price / p.price ORDER BY a.symbol) AS r, list(a.symbol ORDER BY a.symbol) AS symbols
  FROM h, w2 a JOIN w2 p ON p.symbol = a.symbol AND p.i = a.i - 1 GROUP BY h.strategy, a.i, a.ts HAVING count(p.w) = count(*)),
s AS (SELECT strategy, i, ts, 1000.0::DOUBLE AS value, list_transform(w, lambda x: 0.0::DOUBLE) AS held, list_transform(w, lambda x: x * 1000.0::DOUBLE) AS goal FROM q WHERE i = (SELECT min(i) FROM q)
  UNION ALL SELECT strategy, i, ts, value, held, list_transform(w, lambda x: x * value) FROM ({step})),
t AS (SELECT s.strategy, s.ts, s.value, unnest(q.symbols) AS symbol, unnest(s.goal) AS goal, unnest(s.held) AS held FROM s JOIN q ON q.strategy = s.strategy AND q.i = s.i),
v AS (SELECT strategy, ts - INTERVAL 1 DAY AS ts, 1000.0::DOUBLE AS value, true AS seed FROM s WHERE i = (SELECT min(i) FROM s) UNION ALL SELECT strategy, ts, value, false FROM s)
{select}"""


def _run(spark, sf, **how) -> bt.Backtester:
    price, weight = _reversal(spark, sf)
    return bt.Backtester(price, {"reversal": weight, "momentum": -weight}, **how)


@query(_costs(True, f"SELECT strategy, {b.SHOW_TS.format('')}, {_R('value', 4)} AS value, seed FROM v"))
def backtest_with_costs(spark, sf):
    return b.shown(_run(spark, sf, full_rebalance=True).equity(), 4)


@query(_costs(False, f"SELECT strategy, {b.SHOW_TS.format('')}, {_R('value', 4)} AS value, seed FROM v"))
def backtest_incremental(spark, sf):
    return b.shown(_run(spark, sf).equity(), 4)


@query(_costs(False, f"SELECT strategy, {b.SHOW_TS.format('')}, symbol, {_R('goal - held', 3)} AS trade_value, {_R('abs(goal - held) * 0.0003', 4)} AS cost FROM t WHERE abs(goal - held) > 1e-10"))
def backtest_trades(spark, sf):
    trades = _run(spark, sf).trades()
    return b.shown(trades.select(bt.STRATEGY, TS, SYMBOL, (F.round(F.col("trade_value") + b.NUDGE, 3) + 0.0).alias("trade_value"), "cost"), 4)


@query(_costs(False, f"SELECT strategy, {b.SHOW_TS.format('')}, {_R('value / max(value) OVER (PARTITION BY strategy ORDER BY ts) - 1')} AS drawdown FROM v"))
def backtest_drawdown(spark, sf):
    return b.shown(_run(spark, sf).drawdown())


@query(_costs(False, f"SELECT strategy, {b.SHOW_TS.format('')}, {_R('sum(abs(goal - held)) / any_value(value)')} AS turnover FROM t GROUP BY strategy, ts"))
def backtest_turnover(spark, sf):
    return b.shown(_run(spark, sf).turnover())


@query(_costs(False, f"""SELECT strategy, strftime(n.ts, '%Y-%m-%d %H:%M:%S') AS ts, {_R('sum(n.price / o.price) * 1000.0 / count(*)', 4)} AS value
FROM (SELECT strategy, min(ts) AS first FROM s GROUP BY strategy) f JOIN n ON n.ts >= f.first JOIN n o ON o.symbol = n.symbol AND o.ts = f.first GROUP BY strategy, n.ts"""))
def backtest_benchmark(spark, sf):
    return b.shown(_run(spark, sf).benchmark_equity(), 4)


@query(f"""WITH {b.EVENTS_SQL},
m AS (SELECT ts, count(x) = count(*) AS whole FROM n GROUP BY ts)
SELECT 'x' AS strategy, {b.SHOW_TS.format('')} FROM m WHERE NOT whole AND ts > (SELECT min(ts) FROM m WHERE whole)""")
def backtest_skipped_dates(spark, sf):
    x = b.events_hourly(spark, sf).factor("x")
    return b.shown(bt.Backtester(x, {"x": x}).skipped_dates())


# Positions, specifications, sizes and acknowledgements as an exchange words them, made of the customers


def _accounts(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    return c.select(name.alias("name"), F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"), F.round(F.col("c_acctbal").cast("double"), 2).alias("bal"))


@query(f"SELECT 'C' || c_custkey AS symbol, {_R('(CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE -1 END) * abs(round(CAST(c_acctbal AS DOUBLE), 2))')} AS current_usd FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND abs(round(CAST(c_acctbal AS DOUBLE), 2)) >= 0.01")
def positions_parsed(spark, sf):
    side = F.when(F.col("ck") % 3 == 1, "2.5").when(F.col("ck") % 3 == 2, "-1").otherwise("0")
    market = F.when(F.col("ck") % 5 == 0, "-USD-SWAP").otherwise("-USDT-SWAP")
    return b.shown(rb.positions_from(_accounts(spark, sf).select(F.concat("name", market).alias("instId"), side.alias("pos"), F.col("bal").cast("decimal(18,2)").cast("string").alias("notionalUsd"))))


_LOTS = "CASE c_custkey % 5 WHEN 0 THEN '0.1' WHEN 1 THEN '1' WHEN 2 THEN '0.010' WHEN 3 THEN '' ELSE '5' END"


@query("""SELECT 'C' || c_custkey AS inst_id, 'live' AS state, 0.01::DOUBLE AS ct_val, CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS DOUBLE) ELSE 1.0 END AS ct_mult,
  CASE c_custkey % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 WHEN 2 THEN 0.01 ELSE 5.0 END AS lot_sz, 0.5::DOUBLE AS min_sz, 0.0::DOUBLE AS max_mkt_sz, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS size_decimals
FROM customer WHERE c_custkey % 5 <> 3 AND c_custkey % 7 <> 0""")
def specs_parsed(spark, sf):
    lots = F.element_at(F.array(*map(F.lit, ("0.1", "1", "0.010", "", "5"))), (F.col("ck") % 5 + 1).cast("int"))
    raw = _accounts(spark, sf).select(F.col("name").alias("instId"), F.lit("live").alias("state"), F.when(F.col("ck") % 7 == 0, "none").otherwise("0.01").alias("ctVal"), F.col("nk").cast("string").alias("ctMult"), lots.alias("lotSz"), F.lit("0.5").alias("minSz"), F.lit("").alias("maxMktSz"))
    return b.shown(rb.specs_from(raw))


@query("SELECT 'C' || c_custkey AS symbol, printf('%.' || (c_custkey % 4) || 'f', (c_custkey % 1000) / 8.0 + 0.0001) AS size FROM customer")
def sizes_as_text(spark, sf):
    return _accounts(spark, sf).select(F.col("name").alias("symbol"), rb.format_size((F.col("ck") % 1000) / 8.0 + 0.0001, (F.col("ck") % 4).cast("int")).alias("size"))


@query("SELECT count(*) AS orders, count(*) FILTER (c_nationkey = 0) AS ok, count(*) FILTER (c_nationkey <> 0) AS failed FROM customer")
def order_acknowledgements(spark, sf):
    return rb.acknowledgements(_accounts(spark, sf).select(F.col("nk").cast("string").alias("code")))
