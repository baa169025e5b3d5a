"""Rebalancing plans: target weights against current positions. Plans only; nothing is ever ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least change worth a trade, least position worth counting, in USD (fixed values).
LEAST_TRADE, LEAST_POSITION = 1.0, 0.01


def decide(current: Column, target: Column) -> Column:
    change = target - current
    return (
        F.when(F.abs(change) < LEAST_TRADE, "skip")
        .when(target == 0, "close")
        .when(current == 0, "open")
        .when((current > 0) != (target > 0), "flip")
        .when(F.abs(target) > F.abs(current), "add")
        .otherwise("reduce")
    )


def contracts(notional: Column, price: Column, ct_val: Column, ct_mult: Column, lot: Column) -> Column:
    """Whole lots that the notional buys, rounded down."""
    per = price * ct_val * F.when(ct_mult > 0, ct_mult).otherwise(1.0)
    return F.floor(F.try_divide(F.try_divide(notional, per), lot) + 1e-9) * lot


def positions_from(raw: DataFrame, suffix: str = "-USDT-SWAP") -> DataFrame:
    """(symbol, current_usd) from (instId, pos, notionalUsd as text): dust and other markets left out, signed by pos."""
    pos, usd = F.col("pos").cast("double"), F.col("notionalUsd").cast("double")
    rows = raw.where((pos != 0) & (F.abs(usd) >= LEAST_POSITION) & F.col("instId").endswith(suffix))
    return rows.select(F.substring_index("instId", "-", 1).alias("symbol"), (F.signum(pos) * F.abs(usd)).alias("current_usd"))


def plan(weights: DataFrame, positions: DataFrame, budget: float, specs: DataFrame | None = None, suffix: str = "-USDT-SWAP") -> DataFrame:
    """One leg for each symbol of (symbol, weight) or (symbol, current_usd).

    With ``specs`` (inst_id, state, ct_val, ct_mult, lot_sz, min_sz, max_mkt_sz, price) legs that trade
    get a side, a number of contracts and the notional it comes to, or a note why they get none.
    """
    if budget < 0:
        raise ValueError("the budget may not be negative")
    legs = weights.join(positions, "symbol", "full").select(
        "symbol",
        F.concat("symbol", F.lit(suffix)).alias("inst_id"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        (F.coalesce("weight", F.lit(0.0)) * float(budget)).alias("target_usd"),
        F.coalesce("current_usd", F.lit(0.0)).alias("current_usd"),
    )
    legs = legs.withColumn("action", decide(F.col("current_usd"), F.col("target_usd")))
    if specs is None:
        return legs
    change = F.col("target_usd") - F.col("current_usd")
    size = contracts(F.abs(change), F.col("price"), F.col("ct_val"), F.col("ct_mult"), F.col("lot_sz"))
    note = (
        F.when(F.col("action") == "skip", "change too small")
        .when(F.col("price").isNull(), "no specification or price")
        .when(F.col("state") != "live", "not tradable")
        .when(~(F.col("price") > 0) | ~(F.col("ct_val") > 0) | ~(F.col("lot_sz") > 0), "bad specification or price")
        .when(size < F.col("min_sz"), "below the least order size")
        .when((F.col("max_mkt_sz") > 0) & (size > F.col("max_mkt_sz")), "above the largest market order")
    )
    out = legs.join(specs, "inst_id", "left").withColumn("note", note)
    trade = F.col("note").isNull()
    mult = F.when(F.col("ct_mult") > 0, F.col("ct_mult")).otherwise(1.0)
    return out.select(
        "symbol", "inst_id", "weight", "target_usd", "current_usd", "action",
        F.when(trade, F.when(change > 0, "buy").otherwise("sell")).alias("side"),
        F.when(trade, size).alias("contracts"),
        F.coalesce(trade & F.col("action").isin("close", "reduce"), F.lit(False)).alias("reduce_only"),
        F.when(trade, size * F.col("price") * F.col("ct_val") * mult).otherwise(0.0).alias("order_usd"),
        "note",
    )


def exposure(legs: DataFrame, budget: float) -> DataFrame:
    """One row: gross current and target value, their leverage on the budget, and legs by action."""
    total = lambda c: F.coalesce(F.sum(F.abs(c)), F.lit(0.0))
    actions = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("skip", "open", "add", "reduce", "close", "flip")]
    lever = lambda c: F.try_divide(total(c), F.lit(float(budget)))
    return legs.agg(total("current_usd").alias("gross_current"), total("target_usd").alias("gross_target"), lever("current_usd").alias("current_leverage"), lever("target_usd").alias("target_leverage"), *actions)


def preview(legs: DataFrame, limit: int = 50) -> str:
    return "\n".join(f"{r.symbol:<10} {r.action:<7} {r.current_usd:>14.2f} -> {r.target_usd:>14.2f}" for r in legs.orderBy("symbol").limit(limit).collect())


def size_decimals(lot: Column) -> Column:
    """Decimals of an order size, from the lot size as text: those written, or those a power of ten needs."""
    fraction = F.regexp_extract(lot, r"^[^.]*\.([0-9]*)$", 1)
    written = F.length(F.regexp_replace(fraction, "0+$", ""))
    value = lot.try_cast("double")
    power = F.when((value > 0) & (value < 1), -F.floor(F.log10(value))).otherwise(0)
    return F.when(lot.rlike(r"^[^.]*\.[0-9]*$"), F.least(written, F.lit(12))).otherwise(F.coalesce(power, F.lit(0))).cast("int")


def format_size(size: Column, decimals: Column) -> Column:
    """The size with exactly ``decimals`` decimals, as text."""
    rounded = F.format_string("%.12f", F.round(size * F.pow(F.lit(10.0), decimals)) / F.pow(F.lit(10.0), decimals))
    return F.when(decimals == 0, F.substring_index(rounded, ".", 1)).otherwise(rounded.substr(F.lit(1), F.length(F.substring_index(rounded, ".", 1)) + 1 + decimals))


def specs_from(raw: DataFrame) -> DataFrame:
    """Contract specifications from (instId, state, ctVal, ctMult, lotSz, minSz, maxMktSz: text); bad ones are left out.

    A multiplier that is missing or not positive counts as 1.
    """
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    rows = raw.select(
        F.col("instId").alias("inst_id"), "state", number("ctVal").alias("ct_val"), F.when(number("ctMult") > 0, number("ctMult")).otherwise(1.0).alias("ct_mult"),
        number("lotSz").alias("lot_sz"), number("minSz").alias("min_sz"), number("maxMktSz").alias("max_mkt_sz"), size_decimals(F.col("lotSz")).alias("size_decimals"),
    )
    return rows.where((F.col("inst_id") != "") & (F.col("ct_val") > 0) & (F.col("lot_sz") > 0))


def account_problems(level: str, position_mode: str) -> list[str]:
    """Why an account cannot trade swaps: it needs level 2 or 3 and net positions."""
    problems = []
    if level not in ("2", "3"):
        problems.append(f"account level must be 2 or 3, it is {level!r}")
    if position_mode != "net_mode":
        problems.append(f"position mode must be net_mode, it is {position_mode!r}")
    return problems


def acknowledgements(acks: DataFrame) -> DataFrame:
    """One row: orders, and how many of them (code: text) were taken, which code 0 says."""
    good = F.col("code") == "0"
    return acks.agg(F.count("*").alias("orders"), F.count_if(good).alias("ok"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))
