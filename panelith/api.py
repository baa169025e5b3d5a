"""Function forms of the operators: ``rank(x)`` for ``x.rank()`` and so on."""

from __future__ import annotations

from panelith.operators.analysis import analyze
from panelith.operators.backtest import backtest
from panelith.plans.panel import Factor, Panel
from panelith.sources.panel_csv import show, to_csv_string, write_factor

_METHODS = {
    "rank": "rank", "mean": "cs_mean", "median": "cs_median", "normalize": "normalize", "zscore": "zscore", "quantile": "quantile",
    "scale": "scale", "spread": "spread", "signal": "signal", "vector_neut": "vector_neut", "regression_neut": "regression_neut",
    "group": "group_map", "group_by_name": "group_named", "group_neutralize": "group_neutralize", "group_mean": "group_mean",
    "group_median": "group_median", "group_rank": "group_rank", "group_scale": "group_scale", "group_zscore": "group_zscore",
    "group_normalize": "group_normalize", "ln": "ln", "log": "log", "s_log_1p": "s_log_1p", "sign": "sign", "sqrt": "sqrt",
    "inverse": "inverse", "abs": "abs", "reverse": "reverse", "maximum": "maximum", "minimum": "minimum", "power": "power",
    "signed_power": "signed_power", "add": "add", "subtract": "subtract", "multiply": "multiply", "divide": "divide",
}
_METHODS |= {n: n for n in dir(Factor) if n.startswith("ts_")}


def _forward(name: str, method: str):
    def function(x: Factor, *args, **kwargs) -> Factor:
        return getattr(x, method)(*args, **kwargs)

    function.__name__, function.__doc__ = name, getattr(Factor, method).__doc__
    return function


for _name, _method in _METHODS.items():
    globals()[_name] = _forward(_name, _method)


def regression_neut_multi(y: Factor, xs: list[Factor]) -> Factor:
    return y.regression_neut(*xs)


def ts_regression_multi(y: Factor, xs: list[Factor], w: int, lag: int = 0, rettype: int = 0) -> Factor:
    return y.ts_regression(xs, w, lag, rettype)


def where_(cond: Factor, x: Factor, y: Factor | float) -> Factor:
    return x.where_cond(cond, y)


def to_csv(x: Factor, path: str) -> None:
    write_factor(x, path)


def to_records(x: Factor):
    return x.records()


__all__ = [*_METHODS, "regression_neut_multi", "ts_regression_multi", "where_", "show", "to_csv", "to_csv_string", "to_records", "analyze", "backtest", "Factor", "Panel"]
