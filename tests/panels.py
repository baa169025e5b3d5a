"""Small panels with known results."""

from panelith.plans.panel import Panel

DAYS = [f"2024-01-{d:02d}" for d in range(1, 13)]


def sample(spark) -> Panel:
    """Twelve days, four symbols: a missing close and volume, ties, and days on which all are equal."""
    close = {
        "AAA": [10, 11, 12, None, 14, 15, 16, 17, 18, 19, 20, 21],
        "BBB": list(range(20, 8, -1)),
        "CCC": [20, 22, 24, 26, 28, 15, 30, 32, 34, 36, 38, 40],
        "DDD": [-5, 0, -3, 2, 5, 15, 7, -8, 9, 10, 11, 12],
    }
    volume = {
        "AAA": list(range(100, 220, 10)),
        "BBB": [100, 190, 180, 170, 160, 150, 140, 130, 120, 110, 100, 90],
        "CCC": [300, None, 340, 350, 360, 370, 380, 390, 400, 410, 420, 430],
        "DDD": [400, 420, 430, 440, 450, 460, 470, 480, 490, 500, 510, 520],
    }
    extra = {
        "AAA": [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 1, 2],
        "BBB": [2, 1, 4, 3, 5, 2, 3, 4, 5, 1, 2, 3],
        "CCC": [3, 5, 2, 1, 5, 3, 4, 1, 2, 3, 4, 5],
        "DDD": [4, 3, 1, 2, 5, 4, 5, 2, 3, 4, 5, 1],
    }
    rows = [(d, s, close[s][i], volume[s][i], extra[s][i]) for i, d in enumerate(DAYS) for s in close]
    return Panel.from_records(spark, ["close", "volume", "extra"], rows)


def values(factor) -> dict:
    return {(r.ts, r.symbol): r.v for r in factor.frame("v").collect()}
