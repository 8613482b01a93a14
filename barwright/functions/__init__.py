"""Time-series expressions over bars keyed by (symbol, ts): text that Catalyst and other SQL engines read alike.

Frames count rows. Missing values are NULL, which aggregates skip, and a rolling
value needs ``least`` non-null rows. Division goes through NULLIF, so zero
divisors give NULL. All windows share one partitioning and order, so Spark plans
one exchange and one sort for them.
"""

from __future__ import annotations

BY = "PARTITION BY symbol ORDER BY ts"


def frame(lo: int | None, hi: int = 0) -> str:
    at = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({BY} ROWS BETWEEN {'UNBOUNDED PRECEDING' if lo is None else at(lo)} AND {at(hi)})"


def over(f: str, x: str, lo: int | None, hi: int = 0) -> str:
    return f"{f}({x}) OVER {frame(lo, hi)}"


def roll(f: str, x: str, n: int, least: int, ago: int = 0) -> str:
    """f over the last n rows, or those ending ``ago`` rows before, where at least ``least`` are not null."""
    lo, hi = -(n - 1) - ago, -ago
    return f"CASE WHEN {over('count', x, lo, hi)} >= {least} THEN {over(f, x, lo, hi)} END"


def moments(name: str, x: str, frames: dict[int, int]) -> list[dict[str, str]]:
    """Steps that give {name}{n}_sum, _mean and _std over the last n rows for frames {n: least rows}.

    Differences of running sums, so a row costs the same however long its frame
    is; a variance below a ten-billionth of the mean square counts as zero.
    """
    parts = {"n": f"count({x})", "s": f"sum({x})", "q": f"sum(({x}) * ({x}))"}
    run = {f"{name}_{k}": f"coalesce({f} OVER {frame(None)}, 0)" for k, f in parts.items()}
    span = {f"{name}{n}_{k}": f"{name}_{k} - coalesce({lag(f'{name}_{k}', n)}, 0)" for n in frames for k in parts}
    spread = lambda n: f"{name}{n}_q - {name}{n}_s * {name}{n}_s / {name}{n}_n"
    out = {}
    for n, least in frames.items():
        enough = f"CASE WHEN {name}{n}_n >= {least} THEN"
        out |= {f"{name}{n}_sum": f"{enough} {name}{n}_s END", f"{name}{n}_mean": f"{enough} {name}{n}_s / {name}{n}_n END"}
        out[f"{name}{n}_std"] = f"CASE WHEN {name}{n}_n >= {max(least, 2)} THEN CASE WHEN {spread(n)} <= 1e-10 * {name}{n}_q THEN 0.0 ELSE sqrt(({spread(n)}) / ({name}{n}_n - 1)) END END"
    return [run, span, out]


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({BY})"


def ffill(x: str, rows: int | None = None) -> str:
    """The last non-null value so far, at most ``rows`` rows back."""
    return f"@last({x}){frame(None if rows is None else -rows)}@"


def div(a: str, b: str) -> str:
    return f"({a}) / NULLIF({b}, 0)"


def clip(x: str, lo: float, hi: float) -> str:
    """NULL stays NULL."""
    return f"CASE WHEN ({x}) < {lo} THEN {lo} WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END"


def zero(x: str) -> str:
    return f"coalesce({x}, 0.0)"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
LOG_RETURN = f"ln(NULLIF(close, 0) / NULLIF({lag('close')}, 0))"
HOUR = "(hour(ts) + minute(ts) / 60.0)"
RTH = f"({HOUR} >= 13.5 AND {HOUR} < 20.0)"


def rsi(n: int) -> list[dict[str, str]]:
    """Steps that give rsi{n}, on 0 to 100, from simple means."""
    d = f"close - {lag('close')}"
    return [
        {f"up{n}": f"greatest({d}, 0.0)", f"dn{n}": f"greatest(-({d}), 0.0)"},
        {f"gain{n}": roll("avg", f"CASE WHEN has_prev THEN up{n} END", n, n), f"loss{n}": roll("avg", f"CASE WHEN has_prev THEN dn{n} END", n, n)},
        {f"rsi{n}": f"100.0 - 100.0 / (1.0 + gain{n} / (loss{n} + 1e-9))"},
    ]


HAS_PREV = {"has_prev": f"{lag('close')} IS NOT NULL"}


def atr(n: int = 14, least: int = 14) -> list[dict[str, str]]:
    """Steps that give tr and atr{n}, the simple mean of true ranges."""
    return [{"tr": TRUE_RANGE}, {f"atr{n}": roll("avg", "tr", n, least)}]


def atr_safe(n: int = 14, least: int = 2, floor: float = 0.5) -> list[dict[str, str]]:
    """Steps that give safe{n}: zeros and gaps carry the last value on, 1 before any, never below the floor."""
    return [*atr(n, least), {f"held{n}": f"NULLIF(atr{n}, 0)"}, {f"safe{n}": f"greatest(coalesce({ffill(f'held{n}')}, 1.0), {floor})"}]


def corr(x: str, y: str, n: int, least: int) -> list[dict[str, str]]:
    """Steps that give corr{n} of x and y, pairwise non-null; NULL where a variance is zero."""
    a, b = f"CASE WHEN ({y}) IS NOT NULL THEN {x} END", f"CASE WHEN ({x}) IS NOT NULL THEN {y} END"
    return [
        {"cx": a, "cy": b},
        {f"cn{n}": over("count", "cx", -(n - 1)), f"sx{n}": over("sum", "cx", -(n - 1)), f"sy{n}": over("sum", "cy", -(n - 1)), f"sxy{n}": over("sum", "cx * cy", -(n - 1)), f"sxx{n}": over("sum", "cx * cx", -(n - 1)), f"syy{n}": over("sum", "cy * cy", -(n - 1))},
        {f"vx{n}": f"cn{n} * sxx{n} - sx{n} * sx{n}", f"vy{n}": f"cn{n} * syy{n} - sy{n} * sy{n}"},
        {f"corr{n}": f"CASE WHEN cn{n} >= {least} AND vx{n} > 1e-12 AND vy{n} > 1e-12 THEN (cn{n} * sxy{n} - sx{n} * sy{n}) / sqrt(vx{n} * vy{n}) END"},
    ]
