"""Anchors, setups and context families as plans."""

from __future__ import annotations

from barwright.functions import HOUR, LOG_RETURN, RTH, atr_safe, clip, ffill, flag, frame, lag, moments, over, roll, zero
from barwright.operators.families import VWAP
from barwright.plans import Plan


def within(f: str, x: str, key: str, lo: int | None = None) -> str:
    """f over the rows of one symbol and key up to the current row."""
    start = "UNBOUNDED" if lo is None else str(lo)
    return f"{f}({x}) OVER (PARTITION BY symbol, {key} ORDER BY ts ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"


def before(x: str) -> str:
    """The last non-null x of the rows before this one."""
    return f"@last({x}){frame(None, -1)}@"


# day dn is a regular session and the overnight rows after it; at the next session's first row its extremes are complete,
# and a row sees what was complete before it
ANCHORS = [
    {"rth": RTH},
    {"rs": flag(f"rth AND NOT coalesce({lag('rth')}, false)")},
    {"dn": over("sum", "rs", None)},
    {"rh": within("max", "CASE WHEN rth THEN high END", "dn"), "rl": within("min", "CASE WHEN rth THEN low END", "dn"), "nh": within("max", "CASE WHEN NOT rth THEN high END", "dn"), "nl": within("min", "CASE WHEN NOT rth THEN low END", "dn")},
    {**{f"at_{n}": f"CASE WHEN rs = 1 THEN {lag(c)} END" for n, c in {"pdh": "rh", "pdl": "rl", "onh": "nh", "onl": "nl"}.items()}, "at_pdc": f"CASE WHEN rs = 1 AND dn >= 2 THEN {lag('close')} END", "at_ro": "CASE WHEN rs = 1 THEN open END"},
    {n: before(f"at_{n}") for n in ("pdh", "pdl", "onh", "onl", "pdc", "ro")},
]

SETUPS: dict[str, Plan] = {}

SETUPS["pda"] = Plan(
    [*ANCHORS, *atr_safe(14, 2, 1e-9)],
    {
        **{f"pda_dist_to_{n}_atr": zero(f"({c} - close) / safe14") for n, c in {"pdh": "pdh", "pdl": "pdl", "onh": "onh", "onl": "onl", "rth_open": "ro"}.items()},
        "pda_gap_size_atr": zero("(ro - pdc) / safe14"), "pda_above_pdh": flag("close > pdh"), "pda_below_pdl": flag("close < pdl"), "pda_in_overnight_range": flag("close <= onh AND close >= onl"),
    },
)

# How strongly each kind of level stops prices.
OBSTACLES = {"pd": 1.0, "on": 0.8, "r100": 0.5, "r50": 0.4, "swing": 0.6}


def _nearest(side: str) -> str:
    return "CASE " + " ".join(f"WHEN {side}_{k} = {side}_best THEN {w}" for k, w in OBSTACLES.items()) + " ELSE 0.0 END"


_up = {"pd": "pdh", "on": "onh", "r100": "ceil(close / 100.0) * 100.0", "r50": "ceil(close / 50.0) * 50.0", "swing": "sw_h"}
_down = {"pd": "pdl", "on": "onl", "r100": "floor(close / 100.0) * 100.0", "r50": "floor(close / 50.0) * 50.0", "swing": "sw_l"}
SETUPS["pclear"] = Plan(
    [
        *ANCHORS,
        *atr_safe(14),
        {"sw_h": roll("max", "high", 240, 2, ago=1), "sw_l": roll("min", "low", 240, 2, ago=1)},
        {**{f"u_{k}": f"CASE WHEN {v} > close THEN ({v} - close) / safe14 END" for k, v in _up.items()}, **{f"d_{k}": f"CASE WHEN {v} < close THEN (close - {v}) / safe14 END" for k, v in _down.items()}},
        {f"{s}_best": "least(" + ", ".join(f"{s}_{k}" for k in OBSTACLES) + ")" for s in "ud"},
        {"ca": "least(coalesce(u_best, 10.0), 10.0)", "cb": "least(coalesce(d_best, 10.0), 10.0)"},
    ],
    {
        "pc_clearance_above_atr": "ca", "pc_clearance_below_atr": "cb", "pc_obstacle_above_strength": _nearest("u"), "pc_obstacle_below_strength": _nearest("d"),
        "pc_clearance_asymmetry": clip("(ca - cb) / greatest(ca + cb, 1e-9)", -1.0, 1.0), "pc_clearance_min_atr": "least(ca, cb)",
    },
)

# the newest of the last 12 bars that pierced a level which the close has left again: bars ago, negative for one above
_pierced = lambda x, k: f"{x} > 0.1 * a{k} AND {x} <= 0.6 * a{k}"
_failed = lambda v: "CASE " + " ".join(f"WHEN close < {v} AND {_pierced(f'h{k} - {v}', k)} THEN -{k} WHEN close > {v} AND {_pierced(f'{v} - l{k}', k)} THEN {k}" for k in range(1, 13)) + " END"
_levels = ("pdh", "pdl", "onh", "onl")
SETUPS["sfs"] = Plan(
    [
        *ANCHORS,
        *atr_safe(14),
        {f"{n}{k}": lag(c, k) for n, c in {"h": "high", "l": "low", "a": "safe14"}.items() for k in range(1, 13)},
        {f"f_{v}": _failed(v) for v in _levels},
        {"age": "least(" + ", ".join(f"abs(f_{v})" for v in _levels) + ")"},
        {"act": flag("age IS NOT NULL"), "dir": "CASE " + " ".join(f"WHEN abs(f_{v}) = age THEN sign(f_{v})" for v in _levels) + " ELSE 0 END", "kind": "CASE WHEN abs(f_pdh) = age OR abs(f_pdl) = age THEN 1 WHEN age IS NOT NULL THEN 2 ELSE 0 END"},
    ],
    {"sfs_active": "act", "sfs_strength": clip("0.5 * act + 0.3 * power(0.5, coalesce(age, 13) / 6.0) + CASE WHEN kind = 1 THEN 0.1 ELSE 0.0 END", 0.0, 1.0), "sfs_direction": "dir", "sfs_age_bars": "least(coalesce(age, 13), 12)", "sfs_level_type": "kind"},
)

_mean = lambda x: f"CASE WHEN count(cal) OVER (PARTITION BY symbol, hh, dd) >= 10 THEN avg(CASE WHEN cal = 1 THEN {x} END) OVER (PARTITION BY symbol, hh, dd) ELSE avg(CASE WHEN cal = 1 THEN {x} END) OVER (PARTITION BY symbol) END"
_surprise = {"vol": "rv", "move": "ar", "volume": "mv"}
SETUPS["surprise"] = Plan(
    [
        {"r": f"coalesce({LOG_RETURN}, 0.0)", "hh": "hour(ts)", "dd": "@dow@", "cal": "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 5000 THEN 1 END"},
        {"ar": "abs(r)", "rv": zero(roll("stddev_samp", "r", 60, 10)), "mv": zero(roll("avg", "volume", 60, 10))},
        {f"e_{k}": _mean(x) for k, x in _surprise.items()},
        {f"s_{k}": clip(f"{x} / greatest(e_{k}, 1e-9) - 1.0", -3.0, 3.0) for k, x in _surprise.items()},
    ],
    {**{f"es_{k}_surprise": f"s_{k}" for k in _surprise}, "es_combined_surprise": "(s_vol + s_move + s_volume) / 3.0"},
    digits=9,  # ratios of small whole numbers lie on the edges of six digits
)

SETUPS["seod"] = Plan(
    [
        *VWAP,
        *atr_safe(14),
        {"h": HOUR, "band": clip(zero("(close - vwap) / greatest(sigma, 1e-9)"), -3.0, 3.0), "trend": f"abs(coalesce(close - {lag('close', 30)}, 0.0)) / (safe14 * 30.0)"},
        {"late": "CASE WHEN h >= 19.5 AND h < 20.0 THEN (20.0 - h) * 60.0 ELSE 0.0 END"},
        {"act": flag("late > 0 AND abs(band) >= 1.5 AND trend < 0.4")},
    ],
    {
        "seod_active": "act", "seod_strength": clip(f"0.4 * act + 0.25 * {clip('(abs(band) - 1.5) / 1.5', 0.0, 1.0)} + 0.2 * {clip('(30.0 - late) / 30.0', 0.0, 1.0)} + 0.15 * {clip('1.0 - trend / 0.7', 0.0, 1.0)}", 0.0, 1.0),
        "seod_direction": "CASE WHEN act = 0 THEN 0 WHEN band > 0 THEN -1 ELSE 1 END", "seod_band_position": "band", "seod_mins_until_close": "late",
    },
)

SETUPS["svwap"] = Plan(
    [
        *VWAP,
        *atr_safe(14),
        {"h": HOUR, "dist": zero("(close - vwap) / safe14"), "drift": f"coalesce(vwap - {lag('vwap', 15)}, 0.0) / (safe14 * 15.0)", "c5": lag("close", 5), "v5": lag("vwap", 5), "a5": lag("safe14", 5), "top": over("max", "close", -4), "low5": over("min", "close", -4)},
        {"held": flag("rth AND vwap IS NOT NULL AND abs(c5 - v5) / a5 < 0.15 AND ((drift > 0.02 AND (top - v5) / a5 >= 0.25) OR (drift < -0.02 AND (low5 - v5) / a5 <= -0.25))")},
        {"holds": f"CASE WHEN rth AND vwap IS NOT NULL THEN {within('sum', 'held', 'sid', 55)} ELSE 0 END", "act": flag("h >= 14.5 AND h < 20.0 AND abs(dist) < 0.3 AND abs(drift) > 0.02")},
    ],
    {
        "svwap_active": "act", "svwap_strength": clip(f"0.4 * act + 0.25 * {clip('1.0 - abs(dist) / 0.3', 0.0, 1.0)} + 0.2 * least(abs(drift) / 0.5, 1.0) + 0.15 * least(holds / 3.0, 1.0)", 0.0, 1.0),
        "svwap_direction": "CASE WHEN act = 0 THEN 0 WHEN drift > 0 THEN 1 ELSE -1 END", "svwap_dist_atr": clip("dist", -3.0, 3.0), "svwap_holds_count": "least(holds, 8)",
    },
)

SETUPS["orb"] = Plan(
    [
        *VWAP[:3],
        *atr_safe(14),
        *moments("t", "tr", {1440: 2}),
        {"held1440": "NULLIF(t1440_mean, 0)"},
        {"safe1440": f"greatest(coalesce({ffill('held1440')}, 1.0), 0.5)"},
        {"win": f"rth AND {HOUR} < 14.0", "rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "since": "row_number() OVER (PARTITION BY symbol, sid ORDER BY ts) - 1"},
        {"shut": flag(f"rth AND NOT win AND coalesce({lag('win')}, false)")},
        {"known": f"rth AND {within('sum', 'shut', 'sid')} > 0", "oh": within("max", "CASE WHEN win THEN high END", "sid"), "ol": within("min", "CASE WHEN win THEN low END", "sid")},
        {"size": "CASE WHEN known THEN (oh - ol) / safe1440 ELSE 0.0 END"},
        {"dir": "CASE WHEN known AND size >= 1.0 AND size <= 8.0 AND since >= 30 AND since <= 90 THEN CASE WHEN close > oh THEN 1 WHEN close < ol THEN -1 ELSE 0 END ELSE 0 END"},
        {"first_at": within("min", "CASE WHEN dir <> 0 THEN rn END", "sid")},
        {"age": "coalesce(rn - first_at, 91)", "past": "CASE dir WHEN 1 THEN (close - oh) / safe14 WHEN -1 THEN (ol - close) / safe14 ELSE 0.0 END"},
    ],
    {"orb_active": "abs(dir)", "orb_strength": clip("0.5 * abs(dir) + 0.2 * least(past, 1.0) + 0.2 * power(0.5, age / 20.0) + CASE WHEN size > 1.0 THEN 0.1 ELSE 0.0 END", 0.0, 1.0), "orb_direction": "dir", "orb_breakout_age": "least(age, 90)", "orb_range_atr": clip("size", 0.0, 4.0)},
)

_way = lambda x: f"CASE WHEN {x} > 0.05 THEN 1 WHEN {x} < -0.05 THEN -1 ELSE 0 END"
SETUPS["cac"] = Plan(
    [
        *atr_safe(14),
        {"eh": ffill("es_high"), "el": ffill("es_low"), "ec": ffill("es_close")},
        {"etr": f"greatest(eh - el, abs(eh - {lag('ec')}), abs(el - {lag('ec')}))"},
        {"eatr": f"NULLIF({roll('avg', 'etr', 14, 2)}, 0)"},
        {"esafe": f"greatest(coalesce({ffill('eatr')}, 1.0), 0.5)"},
        {"mp": f"coalesce(close - {lag('close', 30)}, 0.0) / (safe14 * 30.0)", "me": f"coalesce(ec - {lag('ec', 30)}, 0.0) / (esafe * 30.0)"},
        {"wp": _way("mp"), "we": _way("me"), "gap": clip("mp - me", -2.0, 2.0)},
    ],
    {"cac_es_direction_proxy": "we", "cac_nq_es_aligned": flag("wp <> 0 AND wp = we"), "cac_lead_lag_signed": "gap", "cac_divergence_active": flag("abs(gap) > 0.5")},
    cross=True,
)
