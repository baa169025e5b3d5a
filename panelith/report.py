"""Small results as text. Layouts are fixed, so that reports can be compared as strings."""

from __future__ import annotations

import datetime


def stamp(t) -> str:
    """A timestamp as text; midnights as dates."""
    if isinstance(t, datetime.datetime):
        return t.strftime("%Y-%m-%d" if t.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")
    return str(t)


def period(first, last) -> str:
    return "empty" if first is None else f"{stamp(first)} to {stamp(last)}"


def number(v: float | None, digits: int, missing: str = "N/A", width: int = 12) -> str:
    return f"{missing if v is None or v != v else format(v, f'.{digits}f'):>{width}}"


def share(v: float, digits: int = 2, width: int = 7) -> str:
    return f"{v * 100:>{width}.{digits}f}%"


def matrix(names: list[str], value) -> str:
    """A square table; ``value(a, b)`` is a cell."""
    if not names:
        return ""
    cells = [["NaN" if value(a, b) is None else f"{value(a, b):.4f}" for b in names] for a in names]
    widths = [max(len(n) + 1, *(len(row[j]) for row in cells)) for j, n in enumerate(names)]
    left = max(map(len, names))
    lines = [" " * left + "".join(f" {n:>{w}}" for n, w in zip(names, widths))]
    lines += [f"{n:<{left}}" + "".join(f" {c:>{w}}" for c, w in zip(row, widths)) for n, row in zip(names, cells)]
    return "\n".join(lines)


def analysis(names: list[str], horizons: list[int], ic: dict, stats: dict, table: str) -> str:
    """``ic``: (factor, horizon) to a row, ``stats``: factor to a row, ``table``: the correlation matrix or nothing."""
    title = lambda n: f"  {n[:18]:<18}"
    lines = [f"FactorAnalyzer(factors={len(names)}, horizons={horizons})", "", "IC Analysis (Spearman):"]
    lines += [f"{'  Factor':<20}" + "".join(f"{f'{h}D':>12}" for h in horizons), "  " + "-" * (18 + 12 * len(horizons))]
    lines += [title(n) + "".join(number(ic[n, h].ic_mean, 4) for h in horizons) for n in names]
    lines += ["", "IR (IC Mean / IC Std):"]
    lines += [title(n) + "".join(number(ic[n, h].ir, 3) for h in horizons) for n in names]
    lines += ["", "Factor Statistics:", f"  {'Factor':<18}{'Coverage':>12}{'Turnover':>12}{'Autocorr':>12}", "  " + "-" * 54]
    lines += [title(n) + f"{f'{stats[n].coverage * 100:.2f}%':>12}" + number(stats[n].turnover, 4, "nan") + number(stats[n].autocorr, 4) for n in names]
    if table:
        lines += ["", "Correlation Matrix:", *(f"  {line}" for line in table.split("\n"))]
    return "\n".join(lines)


def backtest(name: str, first, last, m, turnover: float) -> str:
    rows = [
        ("total_return", share(m.total_return), "annual_return", share(m.annual_return)),
        ("sharpe_ratio", f"{m.sharpe_ratio:>8.2f}", "sortino_ratio", f"{m.sortino_ratio:>8.2f}"),
        ("calmar_ratio", f"{m.calmar_ratio:>8.2f}", "max_drawdown", share(m.max_drawdown)),
        ("linearity", number(m.linearity, 4, "NaN", 8), "psr", share(m.psr, 1) if m.psr is not None else "    NaN%"),
        ("var_95", share(m.var_95), "cvar", share(m.cvar)),
    ]
    lines = [f"Backtester(strategy='{name}', period={period(first, last)})"]
    lines += [f"  {f'{a}:':<16}{x}    {f'{b}:':<16}{y}" for a, x, b, y in rows]
    return "\n".join([*lines, f"  {'turnover:':<16}{share(turnover)}"])


def drawdowns(rows: list, top: int) -> str:
    if not rows:
        return "Drawdown Periods: none detected"
    lines = [f"Drawdown Periods (top {min(top, len(rows))}):"]
    lines += [f"  {i}. {stamp(r.start)} to {stamp(r.end)}    depth={r.depth * 100:.2f}%    duration={r.duration_days}d" for i, r in enumerate(rows[:top], 1)]
    if len(rows) > top:
        lines.append(f"  (showing {top} of {len(rows)} periods)")
    return "\n".join(lines) + "\n"


def panel_line(info, columns: list[str]) -> str:
    return f"Panel({info.n_rows} rows, {len(columns)} cols, {info.n_symbols} symbols, {info.n_periods} periods, {period(info.first, info.last)})"


def panel_info(info, columns: list[str]) -> str:
    missing = ", ".join(f"{c}: {info[f'missing_{c}']}" for c in columns)
    return f"Panel: {info.n_rows} rows, {len(columns)} columns\n  symbols={info.n_symbols}, periods={info.n_periods}, range={period(info.first, info.last)}\n  NaN: {{{missing}}}"


def factor_line(name: str, n_periods: int, n_symbols: int, first, last) -> str:
    return f"Factor('{name}', {n_periods} periods × {n_symbols} symbols, {period(first, last)})"


def factor_table(head: str, symbols: list[str], rows: list[tuple], gap: int | None) -> str:
    """``rows``: (timestamp, values); ``gap``: the number of rows before the ones left out."""
    lines = [head, f"{'timestamp':<19}" + "".join(f"{s:>12}" for s in symbols)]
    for i, (t, cells) in enumerate(rows):
        if i == gap:
            lines.append(f"{'':<19}...")
        lines.append(f"{stamp(t):<19}" + "".join(number(v, 4, "NaN") for v in cells))
    return "\n".join(lines) + "\n"
