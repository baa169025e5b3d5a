"""Portfolio backtests with transaction costs, and performance metrics.

Holdings depend on the value of the day before, so a backtest is a fold over dates. Strategies run
side by side: one Arrow group for each, its dates already collapsed to one row each. Without costs the
fold has a closed form, ``zero_cost_equity``, which is a plain window product.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith import report
from panelith.functions.base import SYMBOL, TS
from panelith.functions.elementwise import norm_cdf
from panelith.plans.panel import Factor

STRATEGY, YEAR = "strategy", 365.0
DUST = 1e-10


def _periods(factors: dict[str, Factor], name: str) -> DataFrame:
    """(strategy, ts, map of symbol to value) of each period; the map is NULL where a symbol lacks its value.

    Factors of one grid are computed together, in one plan.
    """
    grids: dict[int, list[str]] = {}
    for n, f in factors.items():
        grids.setdefault(id(f.panel), []).append(n)
    parts = []
    for names in grids.values():
        df = factors[names[0]].panel.compute(**{f"c{i}": factors[n] for i, n in enumerate(names)})
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias(STRATEGY), F.col(f"c{i}").alias("x")) for i, n in enumerate(names)]))
        rows = df.select(TS, SYMBOL, cells.alias("c")).select("c.*", TS, SYMBOL)
        whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct(SYMBOL, "x"))))
        parts.append(rows.groupBy(STRATEGY, TS).agg(F.when(F.count("x") == F.count(F.lit(1)), whole).alias(name)))
    return reduce(DataFrame.unionByName, parts)


def weights(values: dict[str, float], as_is: bool) -> dict[str, float]:
    """Target weights: the values themselves, or demeaned and divided by their total of absolute values."""
    if as_is:
        return values
    mean = sum(values.values()) / len(values)
    total = sum(abs(v - mean) for v in values.values())
    return {s: (v - mean) / total if total >= 1e-10 else 0.0 for s, v in values.items()}


def is_signal(values: dict[str, float]) -> bool:
    near = lambda a, to: abs(a - to) <= 1e-2 + 1e-5 * abs(to)
    longs, shorts = sum(v for v in values.values() if v > 0), sum(v for v in values.values() if v < 0)
    return near(longs, 0.5) and near(shorts, -0.5) and near(longs + shorts, 0.0)


def simulate(dates, prices, factors, capital: float, buy: float, sell: float, full: bool, market: bool):
    """(equity rows, trade rows) of one strategy over its dates in order; None marks a period without values."""
    start = next((i for i in range(1, len(dates)) if factors[i - 1] and prices[i]), None)
    if len(dates) < 2 or start is None:
        return [], []
    cash, positions, value = capital, {}, capital
    equity, trades = [(dates[start] - pd.Timedelta(days=1), capital, True)], []

    def trade(symbol, quantity, price, date):
        nonlocal cash
        amount = quantity * price
        fee = abs(amount) * (buy if quantity > 0 else sell)
        cash -= amount + fee
        left = positions.get(symbol, 0.0) + quantity
        if abs(left) < DUST:
            positions.pop(symbol, None)
        else:
            positions[symbol] = left
        trades.append((date, symbol, amount, fee))

    for i in range(start, len(dates)):
        now = prices[i]
        if not now:
            continue
        held = {s: q * now[s] for s, q in positions.items() if s in now}
        value = cash + sum(held.values())
        equity.append((dates[i], value, False))
        before = factors[i - 1]  # of the common date before, whether or not that was traded
        target = {s: w * value for s, w in weights(before, not market or is_signal(before)).items()} if before else {}
        if full:
            for s, q in list(positions.items()):
                if s in now:
                    trade(s, -q, now[s], dates[i])
            held = {s: q * now[s] for s, q in positions.items() if s in now}
        for s in sorted(target.keys() | held.keys()):
            if s in now:
                change = target.get(s, 0.0) - held.get(s, 0.0)
                if abs(change) > DUST:
                    trade(s, change / now[s], now[s], dates[i])
    return equity, trades


class Backtester:
    """A price and one or more named strategies; results are DataFrames with a strategy column."""

    def __init__(self, price: Factor, strategies: Factor | dict[str, Factor], buy: float = 0.0003, sell: float = 0.0003, capital: float = 1000.0, full_rebalance: bool = False, neutralization: str = "market"):
        if neutralization.lower() not in ("market", "none"):
            raise ValueError(f"neutralization must be market or none: {neutralization}")
        self.price = price
        self.strategies = {strategies.name: strategies} if isinstance(strategies, Factor) else dict(strategies)
        self.buy, self.sell, self.capital, self.full = buy, sell, capital, full_rebalance
        self.market = neutralization.lower() == "market"

    def _days(self) -> DataFrame:
        prices = _periods({"price": self.price}, "prices").drop(STRATEGY)
        return _periods(self.strategies, "factors").join(prices, TS)  # the dates common to both grids

    def _fold(self, kind: str) -> DataFrame:
        capital, buy, sell, full, market = self.capital, self.buy, self.sell, self.full, self.market

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(TS)
            as_dict = lambda c: [dict(v) if v is not None else None for v in c]
            equity, trades = simulate(list(pdf[TS]), as_dict(pdf.prices), as_dict(pdf.factors), capital, buy, sell, full, market)
            name = pdf[STRATEGY].iloc[0]
            if kind == "equity":
                return pd.DataFrame([(name, *r) for r in equity], columns=[STRATEGY, TS, "value", "seed"])
            return pd.DataFrame([(name, *r) for r in trades], columns=[STRATEGY, TS, SYMBOL, "trade_value", "cost"])

        schema = f"{STRATEGY} string, {TS} timestamp, value double, seed boolean" if kind == "equity" else f"{STRATEGY} string, {TS} timestamp, {SYMBOL} string, trade_value double, cost double"
        days = self._days().withColumn(TS, F.col(TS).cast("timestamp"))
        return days.groupBy(STRATEGY).applyInPandas(run, schema)

    def equity(self) -> DataFrame:
        """(strategy, ts, value, seed): the value before each day's trades, after a seed point a day earlier."""
        return self._fold("equity")

    def trades(self) -> DataFrame:
        return self._fold("trades")

    def skipped_dates(self) -> DataFrame:
        """Strategy dates without all values, after the first with."""
        rows = _periods(self.strategies, "v").withColumn("seen", F.count("v").over(_upto()))
        return rows.where("v is null and seen > 0").select(STRATEGY, TS)

    def returns(self) -> DataFrame:
        return returns_of(self.equity())

    def drawdown(self) -> DataFrame:
        peak = F.max("value").over(_upto())
        return self.equity().select(STRATEGY, TS, (F.col("value") / peak - 1).alias("drawdown"))

    def turnover(self) -> DataFrame:
        """Traded value over the portfolio's, on days with trades."""
        daily = self.trades().groupBy(STRATEGY, TS).agg(F.sum(F.abs("trade_value")).alias("traded"))
        return daily.join(self.equity().where("not seed"), [STRATEGY, TS]).select(STRATEGY, TS, (F.col("traded") / F.col("value")).alias("turnover"))

    def benchmark_equity(self) -> DataFrame:
        """(strategy, ts, value): equal parts bought on the strategy's first day and held."""
        first = self.equity().where("not seed").groupBy(STRATEGY).agg(F.min(TS).alias("first"))
        cells = self.price.frame("p").withColumn(TS, F.col(TS).cast("timestamp"))
        whole = cells.groupBy(TS).agg((F.count("p") == F.count(F.lit(1))).alias("ok")).where("ok").select(TS)
        cells = cells.join(whole, TS)
        bought = first.join(cells, F.col("first") == F.col(TS)).select(STRATEGY, "first", F.col(SYMBOL).alias("s"), (F.lit(self.capital) / F.count("*").over(Window.partitionBy(STRATEGY)) / F.col("p")).alias("quantity"))
        held = cells.join(F.broadcast(bought), (F.col(SYMBOL) == F.col("s")) & (F.col(TS) >= F.col("first")))  # one row for each strategy and symbol
        return held.groupBy(STRATEGY, TS).agg(F.sum(F.col("quantity") * F.col("p")).alias("value"))

    def metrics(self, risk_free: float = 0.03) -> DataFrame:
        return performance_metrics(self.returns(), risk_free)

    def drawdown_periods(self) -> DataFrame:
        return drawdown_periods(self.returns())

    def summary(self, risk_free: float = 0.03) -> str:
        """One report for each strategy that has metrics."""
        traded = {r[STRATEGY]: r.t for r in self.turnover().groupBy(STRATEGY).agg((F.avg("turnover") * YEAR).alias("t")).collect()}
        span = {r[STRATEGY]: r for r in self.equity().groupBy(STRATEGY).agg(F.min(TS).alias("first"), F.max(TS).alias("last")).collect()}
        rows = self.metrics(risk_free).orderBy(STRATEGY).collect()
        texts = [report.backtest(m[STRATEGY], span[m[STRATEGY]]["first"], span[m[STRATEGY]]["last"], m, traded.get(m[STRATEGY], 0.0)) for m in rows]
        return "\n".join(texts) or "Backtester(no metrics available)"

    def drawdown_report(self, top: int = 5, strategy: str | None = None) -> str:
        rows = self.drawdown_periods()
        if strategy is not None:
            rows = rows.where(F.col(STRATEGY) == strategy)
        return report.drawdowns(rows.orderBy("depth", "start").collect(), top)


def backtest(price: Factor, strategy: Factor, **how) -> Backtester:
    return Backtester(price, strategy, **how)


def _by() -> Window:
    return Window.partitionBy(STRATEGY).orderBy(TS)


def _upto() -> Window:
    return _by().rowsBetween(Window.unboundedPreceding, 0)


def returns_of(equity: DataFrame) -> DataFrame:
    """(strategy, ts, ret) from (strategy, ts, value)."""
    return equity.select(STRATEGY, TS, (F.col("value") / F.lag("value").over(_by()) - 1).alias("ret")).where("ret is not null")


def zero_cost_equity(price: Factor, weight: Factor, capital: float = 1000.0) -> DataFrame:
    """(ts, value) without costs, every period whole: the product of the periods' weighted price changes.

    The weights of a period are traded at the next one's prices.
    """
    panel = price.panel
    if weight.panel is not panel:
        raise ValueError("price and weights have to share a grid")
    gain = (price / price.ts_delay(1) - 1) * weight.ts_delay(2)
    daily = panel.compute(g=gain, w=weight.ts_delay(1)).groupBy(TS).agg(F.sum("g").alias("g"), F.count("w").alias("w")).where("w > 0")
    grown = F.product(1 + F.coalesce("g", F.lit(0.0))).over(Window.orderBy(TS).rowsBetween(Window.unboundedPreceding, 0))  # one row for each period
    return daily.select(TS, (grown * float(capital)).alias("value"))


def drawdown_periods(returns: DataFrame) -> DataFrame:
    """(strategy, start, end, depth, duration_days): spells below the peak; the day of recovery ends one."""
    rows = returns.withColumn("equity", F.product(1 + F.col("ret")).over(_upto()))
    rows = rows.withColumn("dd", F.col("equity") / F.max("equity").over(_upto()) - 1).withColumn("under", F.col("dd") < -1e-6)
    rows = rows.withColumn("enter", F.when(F.col("under") & ~F.coalesce(F.lag("under").over(_by()), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("spell", F.sum("enter").over(_upto())).withColumn("next", F.lead(TS).over(_by()))
    got = rows.where("under").groupBy(STRATEGY, "spell").agg(F.min(TS).alias("start"), F.max(TS).alias("last"), F.max_by("next", TS).alias("next"), F.min("dd").alias("depth"))
    end = F.coalesce("next", "last")
    return got.select(STRATEGY, "start", end.alias("end"), "depth", F.datediff(end, "start").alias("duration_days"))


def psr(mean: Column, sd: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """Probability that the true Sharpe ratio is above 0; ``kurt`` is not the excess."""
    ratio = F.when(sd > 0, mean * YEAR / (sd * YEAR**0.5)).otherwise(0.0)
    inside = 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio
    return F.when(inside >= 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm_cdf(F.try_divide(ratio, F.sqrt(inside)) * F.sqrt(n / YEAR)))))


def performance_metrics(returns: DataFrame, risk_free: float = 0.03) -> DataFrame:
    """One row of eleven metrics for each strategy with two returns or more (strategy, ts, ret)."""
    whole = Window.partitionBy(STRATEGY)
    rows = returns.withColumn("equity", F.product(1 + F.col("ret")).over(_upto()))
    rows = rows.withColumn("dd", F.col("equity") / F.max("equity").over(_upto()) - 1).withColumn("at", F.row_number().over(_by()).cast("double")).withColumn("q", F.percentile("ret", 0.05).over(whole))
    r, down = F.col("ret"), F.when(F.col("ret") < 0, F.col("ret"))
    got = rows.groupBy(STRATEGY).agg(
        F.count("*").alias("n"),
        (F.max_by("equity", TS) - 1).alias("total_return"),
        F.datediff(F.max(TS), F.min(TS)).alias("days"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sd"),
        F.stddev_samp(down).alias("down_sd"),
        F.min("dd").alias("max_drawdown"),
        F.when(F.min("equity") < F.max("equity"), F.pow(F.try_divide(F.covar_pop("at", "equity"), F.stddev_pop("at") * F.stddev_pop("equity")), 2)).alias("linearity"),
        F.first("q").alias("var_95"),
        F.avg(F.when(r <= F.col("q"), r)).alias("cvar"),
        F.when(F.min(r) < F.max(r), F.skewness(r)).alias("skew"),
        F.when(F.min(r) < F.max(r), F.kurtosis(r) + 3).alias("kurt"),
    ).where("n >= 2")
    got = got.withColumn("annual_return", F.when(F.col("days") > 0, F.pow(1 + F.col("total_return"), YEAR / F.col("days")) - 1).otherwise(0.0))
    vol, down_vol = F.col("sd") * YEAR**0.5, F.col("down_sd") * YEAR**0.5
    excess = F.col("annual_return") - float(risk_free)
    over = lambda e, v: F.coalesce(F.when(v > 0, F.try_divide(e, v)), F.lit(0.0))
    return got.select(
        STRATEGY,
        "total_return",
        "annual_return",
        vol.alias("annual_volatility"),
        over(excess, vol).alias("sharpe_ratio"),
        over(excess, down_vol).alias("sortino_ratio"),
        over(F.col("annual_return"), -F.col("max_drawdown")).alias("calmar_ratio"),
        "max_drawdown",
        "linearity",
        "var_95",
        F.coalesce("cvar", F.lit(0.0)).alias("cvar"),
        psr(F.col("mean"), F.col("sd"), F.col("skew"), F.col("kurt"), F.col("n")).alias("psr"),
    )
