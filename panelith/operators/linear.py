"""Least squares on several regressors: Arrow group functions, one timestamp or symbol at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

from panelith.functions.base import SYMBOL, TS
from panelith.plans.panel import Factor, Panel, align

#: Limits of the condition number of the Gram matrix (fixed values).
ROLLING_LIMIT, CROSS_LIMIT = 1e10, 1e20


def solve(design: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(coefficients, Gram matrix), or None where the Gram matrix is too close to singular."""
    gram = design.T @ design
    values = np.linalg.eigvalsh(gram)
    if values[0] <= 0 or values[-1] / values[0] > limit:
        return None
    try:
        return np.linalg.solve(gram, design.T @ y), gram
    except np.linalg.LinAlgError:
        return None


def _frame(y: Factor, xs: list[Factor]):
    factors = (y, *xs)
    if any(f.panel is not y.panel for f in xs):
        factors = align(*factors)
    names = ["y", *(f"x{i}" for i in range(len(xs)))]
    return factors[0].panel.compute(**dict(zip(names, factors))), names


def _result(df, name: str) -> Factor:
    return Panel(df, ["value"]).factor("value").rename(name)


def neutralize_many(y: Factor, xs: tuple[Factor, ...], name: str) -> Factor:
    """Residuals of each timestamp's fit with intercept; only cells that have everything."""
    df, names = _frame(y, list(xs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[names].to_numpy(float)
        out = np.full(len(pdf), np.nan)
        ok = ~np.isnan(values).any(1)
        if ok.sum() >= 2:
            design = np.column_stack([np.ones(ok.sum()), values[ok, 1:]])
            fit = solve(design, values[ok, 0], CROSS_LIMIT)
            if fit is not None:
                out[ok] = values[ok, 0] - design @ fit[0]
        return pd.DataFrame({TS: pdf[TS], SYMBOL: pdf[SYMBOL], "value": pd.Series(out, index=pdf.index).astype(object).where(~np.isnan(out), None)})

    kind = dict(df.dtypes)[TS]
    return _result(df.groupBy(TS).applyInPandas(run, f"{TS} {kind}, {SYMBOL} string, value double"), name)


def rolling_fits(y: np.ndarray, x: np.ndarray, w: int, rettype: int) -> np.ndarray:
    """The figure ``rettype`` of the fit over each window of ``w`` rows, NaN where there is none.

    Rows that lack a value have weight 0; all windows are solved at once.
    """
    n, m = x.shape
    out = np.full(n, np.nan)
    if n < w:
        return out
    ok = ~np.isnan(y) & ~np.isnan(x).any(1)
    design = np.where(ok[:, None], np.column_stack([np.ones(n), x]), 0.0)
    cut = lambda a: np.lib.stride_tricks.sliding_window_view(a, w, axis=0)
    d, t, held = cut(design).swapaxes(1, 2), cut(np.where(ok, y, 0.0)), cut(ok)
    count = held.sum(1)
    gram = np.einsum("nwi,nwj->nij", d, d)
    values = np.linalg.eigvalsh(gram)
    usable = (count >= m + 2) & (values[:, 0] > 0)
    usable[usable] &= values[usable, -1] / values[usable, 0] <= ROLLING_LIMIT
    d, t, held, count, gram = d[usable], t[usable], held[usable], count[usable], gram[usable]
    if not len(d):
        return out
    coef = np.linalg.solve(gram, np.einsum("nwi,nw->ni", d, t)[..., None])[..., 0]
    fitted = np.einsum("nwi,ni->nw", d, coef)
    sse = (held * (t - fitted) ** 2).sum(1)
    sst = (held * (t - t.sum(1, keepdims=True) / count[:, None]) ** 2).sum(1)
    last = w - 1 - held[:, ::-1].argmax(1)
    free = count - m - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        mse = np.where(free > 0, sse / free, np.nan)
        if rettype in (8, 9):
            at = (2, 0)[rettype - 8]
            got = np.where(mse > 0, np.sqrt(mse * np.linalg.inv(gram)[:, at, at]), np.nan) if at <= m else np.full(len(d), np.nan)
        elif rettype >= 100:
            got = coef[:, rettype - 99] if rettype - 99 <= m else np.full(len(d), np.nan)
        else:
            every = np.arange(len(d))
            kinds = {0: lambda: (t - fitted)[every, last], 1: lambda: coef[:, 0], 2: lambda: coef[:, 1], 3: lambda: fitted[every, last], 4: lambda: sse, 5: lambda: sst, 6: lambda: np.where(sst > 0, 1 - sse / sst, np.nan), 7: lambda: mse}
            got = kinds.get(rettype, lambda: np.full(len(d), np.nan))()
    out[w - 1 :][usable] = got
    return out


def regress_many(y: Factor, xs: list[Factor], w: int, lag: int, rettype: int, name: str, rows: int = 20_000) -> Factor:
    """Rolling fits of one symbol at a time; see the single-regressor form for ``rettype``.

    Here 8 is the standard error of the second slope and 100 + i the slope of regressor i. ``rows``
    windows are solved at once.
    """
    df, names = _frame(y, [x.ts_delay(lag) if lag else x for x in xs])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TS)
        values = pdf[names].to_numpy(float)
        parts = []
        for at in range(0, len(values), rows):
            low = max(0, at - w + 1)
            parts.append(rolling_fits(values[low : at + rows, 0], values[low : at + rows, 1:], w, rettype)[at - low :])
        out = np.concatenate(parts) if parts else np.zeros(0)
        return pd.DataFrame({TS: pdf[TS], SYMBOL: pdf[SYMBOL], "value": pd.Series(out, index=pdf.index).astype(object).where(~np.isnan(out), None)})

    kind = dict(df.dtypes)[TS]
    return _result(df.groupBy(SYMBOL).applyInPandas(run, f"{TS} {kind}, {SYMBOL} string, value double"), name)
