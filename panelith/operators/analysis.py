"""Factor evaluation: forward returns, information coefficients, correlation, coverage, turnover, autocorrelation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith import report
from panelith.functions.base import EPSILON, SYMBOL, TS, cross, series
from panelith.functions.cross import average_rank
from panelith.plans.panel import BY_SYMBOL, Factor, align

DEFAULT_HORIZONS = (1, 7, 30)
METHODS = ("spearman", "pearson")
CORRELATIONS = ("pearson", "spearman", "kendall")


def forward_return(p: Column, h: int) -> Column:
    """Price h rows ahead over the price, less 1. From a price of 0 it is infinite, and kept."""
    q = F.lead(p, h).over(series())
    infinite = F.when(q > 0, float("inf")).when(q < 0, float("-inf"))
    return F.when(p == 0, infinite).otherwise(F.try_divide(q, p) - 1)


def global_ranks(df: DataFrame, columns: list[str], buckets: int = 128) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its average rank among all rows, from 1.

    Exact, and without one sorted task: rows fall in value ranges; the rows before a range are counted
    first, ranks are taken within it. The ranges come from approximate quantiles, one pass for all columns.
    """
    points = [i / buckets for i in range(1, buckets)]
    cuts = df.select(*[F.percentile_approx(c, points, 1000).alias(c) for c in columns]).first()

    def place(c: str):
        edges, value = F.array(*[F.lit(float(e)) for e in sorted(set(cuts[c] or []))]).cast("array<double>"), F.col(c)
        return F.size(F.filter(edges, lambda e: e < value))

    base = df.withColumns({f"_in_{c}": place(c) for c in columns})
    out = base
    for c in columns:
        at = f"_in_{c}"
        sizes = base.groupBy(at).agg(F.count("*").alias("_size"))
        before = F.sum("_size").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
        offsets = sizes.select(F.col(at).alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))  # one row for each range
        out = out.join(F.broadcast(offsets), F.col(at) == F.col("_r"))
        ties = F.count("*").over(Window.partitionBy(at, c))
        rank = F.rank().over(Window.partitionBy(at).orderBy(c))
        out = out.withColumn(c, F.col("_before") + rank + (ties - 1) / 2).drop(at, "_r", "_before")
    return out


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b with ties, in n log n steps: discordant pairs are inversions, counted while merging."""
    n = len(x)
    if n < 2 or len(y) != n or np.isnan(x).any() or np.isnan(y).any():
        return float("nan")
    pairs = n * (n - 1) / 2
    tied = lambda counts: float((counts * (counts - 1) / 2).sum())
    _, xi, xn = np.unique(x, return_inverse=True, return_counts=True)
    _, yi, yn = np.unique(y, return_inverse=True, return_counts=True)
    both = np.unique(xi.astype(np.int64) * len(yn) + yi, return_counts=True)[1]
    free_x, free_y = pairs - tied(xn), pairs - tied(yn)
    if free_x <= 0 or free_y <= 0:
        return float("nan")
    seq, discordant, width = yi[np.lexsort((yi, xi))], 0, 1
    while width < n:  # merge sort from below; sorted runs of ``width``
        for lo in range(0, n - width, 2 * width):
            left, right = seq[lo : lo + width], seq[lo + width : lo + 2 * width]
            discordant += int((len(left) - np.searchsorted(left, right, "right")).sum())
            seq[lo : lo + 2 * width] = np.sort(seq[lo : lo + 2 * width], kind="stable")
        width *= 2
    tau = (pairs - tied(xn) - tied(yn) + tied(both) - 2 * discordant) / np.sqrt(free_x) / np.sqrt(free_y)
    return float(min(1.0, max(-1.0, tau)))


class Analyzer:
    """Candidate factors against the returns of a price; every result is a small DataFrame."""

    def __init__(self, factors: list[Factor], price: Factor, horizons: list[int] | None = None):
        if not factors:
            raise ValueError("at least one factor is needed")
        self.factors, self.price, self.horizons = list(factors), price, list(horizons or DEFAULT_HORIZONS)

    def forward_returns(self, h: int) -> Factor:
        return self.price._op("forward_return", (h,), BY_SYMBOL, lambda p: forward_return(p, h), f"forward_return({self.price.name},{h})")

    def ic_series(self, method: str = "spearman") -> DataFrame:
        """(factor, horizon, ts, ic): a row for each period whose coefficient exists.

        Means and deviations are each side's own; the product runs over the cells that have both.
        Needs three such cells and a deviation on either side.
        """
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}: {method}")
        returns = [self.forward_returns(h) for h in self.horizons]
        parts, groups = [], {}
        for i, f in enumerate(self.factors):  # one plan for the factors that share a grid
            groups.setdefault(id(f.panel), []).append(i)
        for ids in groups.values():
            factors = [self.factors[i] for i in ids]
            if factors[0].panel is not self.price.panel:
                *factors, = align(*factors, *returns)
                factors, rets = factors[: len(ids)], factors[len(ids) :]
            else:
                rets = returns
            names = {f"f{i}": f for i, f in zip(ids, factors)} | {f"r{h}": r for h, r in zip(self.horizons, rets)}
            df = factors[0].panel.compute(**names)
            if method == "spearman":
                df = df.select(TS, SYMBOL, *[average_rank(F.col(c)).alias(c) for c in names])
            centred = {c: F.col(c) - F.avg(c).over(cross()) for c in names}
            df = df.select(TS, *[e.alias(c) for c, e in centred.items()])
            title = lambda i: F.lit(self.factors[i].name)
            fs = F.array(*[F.struct(F.lit(i).alias("at"), title(i).alias("name"), F.col(f"f{i}").alias("f")) for i in ids])
            rs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("r")) for h in self.horizons])
            parts.append(df.select(TS, F.explode(fs).alias("a"), rs.alias("rs")).select(TS, "a.*", F.explode("rs").alias("b")).select(TS, "at", "name", "f", "b.*"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        f, r = F.col("f"), F.col("r")
        sums = rows.groupBy("at", "name", "h", TS).agg(F.sum(f * r).alias("fr"), F.sum(f * f).alias("ff"), F.sum(r * r).alias("rr"), F.count(f).alias("nf"), F.count(r).alias("nr"), F.count(f * r).alias("n"))
        sd = lambda s, n: F.sqrt(F.try_divide(F.col(s), F.col(n) - 1))
        usable = (F.col("n") >= 3) & (sd("ff", "nf") > EPSILON) & (sd("rr", "nr") > EPSILON) & ~F.isnan("ff") & ~F.isnan("rr")
        ic = F.try_divide(F.col("fr"), F.sqrt(F.col("ff") * F.col("rr")))
        return sums.where(usable).select("at", F.col("name").alias("factor"), F.col("h").alias("horizon"), TS, ic.alias("ic")).where(F.col("ic").isNotNull() & ~F.isnan("ic"))

    def ic(self, method: str = "spearman") -> DataFrame:
        """(factor, horizon, ic_mean, ic_std, ir, t_stat, n) of every factor and horizon; the deviation is the population's."""
        got = self.ic_series(method).groupBy("at", "horizon").agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.count("*").alias("n"))
        every = self.price.panel.frame.sparkSession.createDataFrame([(i, f.name, h) for i, f in enumerate(self.factors) for h in self.horizons], "at int, factor string, horizon int")
        ir = F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(F.when(F.col("n") > 0, 0.0))
        return every.join(got, ["at", "horizon"], "left").select("factor", "horizon", "ic_mean", "ic_std", ir.alias("ir"), (ir * F.sqrt("n")).alias("t_stat"), F.coalesce("n", F.lit(0)).alias("n"))

    def correlation(self, method: str = "pearson") -> DataFrame:
        """(factor_a, factor_b, corr, n_obs) of the factors' signals, over the cells that all have."""
        if method not in CORRELATIONS:
            raise ValueError(f"method must be one of {CORRELATIONS}: {method}")
        spark = self.price.panel.frame.sparkSession
        schema = "factor_a string, factor_b string, corr double, n_obs long"
        if len(self.factors) < 2:
            return spark.createDataFrame([], schema)
        signals = [f.signal() for f in self.factors]
        if any(s.panel is not signals[0].panel for s in signals):
            signals = list(align(*signals))
        names = [f"s{i}" for i in range(len(signals))]
        df = signals[0].panel.compute(**dict(zip(names, signals))).select(*names).dropna()
        if method == "spearman":
            df = global_ranks(df.persist(), names)
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        if method == "kendall":
            values = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(names[i]).alias("x"), F.col(names[j]).alias("y")) for i, j in pairs if i < j])

            def tau(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"i": pdf.i[:1], "j": pdf.j[:1], "corr": [kendall_tau_b(pdf.x.to_numpy(), pdf.y.to_numpy())], "n_obs": [len(pdf)]})

            got = df.select(F.explode(values).alias("v")).select("v.*").groupBy("i", "j").applyInPandas(tau, "i int, j int, corr double, n_obs long")
            n = got.select("n_obs").limit(1)
            same = n.select(F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("i"), "n_obs").select("i", F.col("i").alias("j"), F.lit(1.0).alias("corr"), "n_obs")
            got = got.unionByName(same)
        else:
            varied = lambda c: F.min(c) < F.max(c)
            one = lambda a, b: F.when(varied(a) & varied(b), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
            row = df.agg(*[one(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs], F.count("*").alias("n_obs"))
            cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("corr")) for i, j in pairs])
            got = row.select(F.explode(cells).alias("c"), "n_obs").select("c.*", "n_obs")
        both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
        titles = F.array(*[F.lit(f.name) for f in self.factors])
        out = got.where("n_obs >= 2").select(F.explode(both).alias("p"), F.nanvl("corr", F.lit(None).cast("double")).alias("corr"), "n_obs")
        return out.select(F.element_at(titles, F.col("p.i") + 1).alias("factor_a"), F.element_at(titles, F.col("p.j") + 1).alias("factor_b"), "corr", F.col("n_obs").cast("long").alias("n_obs"))

    def stats(self) -> DataFrame:
        """(factor, coverage, turnover, autocorr) of every factor.

        Turnover is twice the mean over symbols of the mean change of the period rank; the
        autocorrelation leaves missing values out and needs more than ten others of a symbol.
        """
        parts = []
        for i, f in enumerate(self.factors):
            df = f.frame("x")
            ranked = df.withColumn("rank", average_rank(F.col("x")) / F.count("x").over(cross())).withColumn("move", F.abs(F.col("rank") - F.lag("rank").over(series())))
            turnover = ranked.groupBy(SYMBOL).agg(F.avg("move").alias("m"), F.count("x").alias("n"), F.count("*").alias("all")).agg(F.try_divide(F.sum("n"), F.sum("all")).alias("coverage"), F.when(F.count("*") == 0, 0.0).otherwise(2 * F.avg("m")).alias("turnover"))
            pairs = df.where("x is not null").withColumn("next", F.lead("x").over(series()))
            have = F.col("next").isNotNull()
            a, b = F.when(have, F.col("x")), F.col("next")
            r = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
            auto = pairs.groupBy(SYMBOL).agg(r.alias("r"), F.count("*").alias("n")).where("n > 10").agg(F.avg("r").alias("autocorr"))
            parts.append(turnover.crossJoin(auto).select(F.lit(i).alias("at"), F.lit(f.name).alias("factor"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "turnover", "autocorr"))  # one row each
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("at")

    def summary(self) -> str:
        """Coefficients, statistics and, for several factors, correlations as text."""
        names = [f.name for f in self.factors]
        ic = {(r.factor, r.horizon): r for r in self.ic().collect()}
        stats = {r.factor: r for r in self.stats().collect()}
        table = self.correlation_table() if len(names) > 1 else ""
        return report.analysis(names, self.horizons, ic, stats, table)

    def correlation_table(self, method: str = "pearson") -> str:
        cells = {(r.factor_a, r.factor_b): r["corr"] for r in self.correlation(method).collect()}
        return report.matrix([f.name for f in self.factors], lambda a, b: cells[a, b]) if cells else ""

    def __str__(self) -> str:
        return f"FactorAnalyzer(factors={[f.name for f in self.factors]}, horizons={self.horizons})"


def analyze(factors: list[Factor], price: Factor, horizons: list[int] | None = None) -> Analyzer:
    return Analyzer(factors, price, horizons)
