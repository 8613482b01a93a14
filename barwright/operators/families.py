"""Feature families as plans: causal columns of bars, by registry key."""

from __future__ import annotations

from barwright.functions import HAS_PREV, HOUR, LOG_RETURN, RTH, atr, atr_safe, clip, corr, div, ffill, flag, frame, lag, moments, over, roll, rsi, zero
from barwright.plans import Plan

RET = {"lr": LOG_RETURN}
RET0 = {"r": f"coalesce({LOG_RETURN}, 0.0)"}
VZ = [{"vm": roll("avg", "volume", 200, 20), "vs": roll("stddev_samp", "volume", 200, 20)}]


def vol_z(bound: float) -> list[dict[str, str]]:
    return [*VZ, {"vz": clip(zero(div("volume - vm", "vs")), -bound, bound)}]


SETUPS = ["sfs", "sfa", "sld", "orb", "svwap", "spb", "scomp", "seod"]

# A setup's hours (UTC, end excluded), and its fitness in low, middle and high volatility.
WINDOWS = {"sfs": (13.5, 20.0), "sfa": (14.5, 19.5), "sld": (13.5, 20.0), "orb": (14.0, 15.0), "svwap": (14.5, 19.5), "spb": (14.0, 19.0), "scomp": (14.0, 19.5), "seod": (19.5, 20.0)}
FITNESS = {"sfs": (0.7, 1.0, 0.9), "sfa": (1.0, 0.9, 0.5), "sld": (0.8, 1.0, 0.7), "orb": (0.3, 0.8, 1.0), "svwap": (0.4, 1.0, 0.7), "spb": (0.6, 1.0, 0.8), "scomp": (1.0, 0.5, 0.2), "seod": (0.9, 0.9, 0.7)}

FAMILIES: dict[str, Plan] = {}

FAMILIES["session"] = Plan(
    [{"h": HOUR, "d": "@dow@"}],
    {
        "time_hour_sin": "sin(2 * pi() * h / 24)", "time_hour_cos": "cos(2 * pi() * h / 24)", "time_dow_sin": "sin(2 * pi() * d / 7)", "time_dow_cos": "cos(2 * pi() * d / 7)",
        "session_is_ny": flag("h >= 13.5 AND h < 20.0"), "session_is_overnight": flag("h >= 22.0 OR h < 8.0"), "session_is_asia": flag("h >= 0.0 AND h < 7.0"), "session_is_london": flag("h >= 7.0 AND h < 13.0"), "session_is_ny_premkt": flag("h >= 12.0 AND h < 13.5"),
        "hours_to_ny_close": "greatest(20.0 - h, 0.0)", "hours_since_ny_open": "greatest(h - 13.5, 0.0)", "ny_session_fraction": "CASE WHEN h >= 13.5 AND h < 20.0 THEN (h - 13.5) / 6.5 ELSE 0.0 END",
    },
)

FAMILIES["sanat"] = Plan(
    [{"h": HOUR, "d": "@dow@"}],
    {
        "sa_mins_from_cash_open": clip("h - 13.5", -6.5, 6.5), "sa_mins_to_cash_close": clip("20.0 - h", -6.5, 6.5),
        "sa_is_opening_hour": flag("h >= 13.5 AND h < 14.5"), "sa_is_closing_hour": flag("h >= 19.0 AND h < 20.0"), "sa_dow_friday_close": flag("d = 4 AND h >= 15.0 AND h < 20.0"),
    },
)

_tof = {f"tof_fit_{s}": f"CASE WHEN h >= {lo} AND h < {hi} THEN 1.0 ELSE 0.3 END" for s, (lo, hi) in WINDOWS.items()}
FAMILIES["tof"] = Plan([{"h": HOUR}], {**_tof, "tof_avg_fit": "(" + " + ".join(_tof.values()) + ") / 8.0"})

_near = {k: f"(@rint(close / {k}.0)@ * {k}.0 - close) / safe14" for k in (100, 50, 25)}
FAMILIES["round"] = Plan(
    [*atr_safe(14, 14, 1e-9), {f"r{k}": e for k, e in _near.items()}],
    {**{f"rnd_dist_to_{k}_atr": f"r{k}" for k in _near}, "rnd_in_round_zone": flag("abs(r100) < 0.1 OR abs(r50) < 0.1 OR abs(r25) < 0.1")},
)

FAMILIES["vreg"] = Plan(
    [
        RET0,
        *moments("r", "r", {60: 10, 240: 20, 1440: 100}),
        *moments("b", "r1440_std", {1440: 100}),
        {"old": lag("r60_std", 60), "v60": "r60_std", "bm": "b1440_mean", "bs": "b1440_std"},
        {"z60": clip(zero(div("v60 - bm", "bs")), -5.0, 5.0), "z240": clip(zero(div("r240_std - bm", "bs")), -5.0, 5.0), "ex": clip(zero(div("v60 - old", "old")), -2.0, 2.0)},
    ],
    {"vr_realized_z_60": "z60", "vr_realized_z_240": "z240", "vr_expanding": "ex", "vr_regime_score": "(tanh(z60 * 0.5) + tanh(ex * 0.5)) / 2.0"},
)

_rv = {5: "vol_realized_5m", 30: "vol_realized_30m", 240: "vol_realized_4h", 1440: "vol_realized_1d"}
FAMILIES["vol"] = Plan(
    [RET, {"sq": "lr * lr"}, *moments("s", "sq", {n: max(1, n // 4) for n in (5, 30, 60, 240, 1440)}), {"rv60": "sqrt(greatest(s60_sum, 0.0)) * sqrt(525600.0 / 60)"}, *moments("v", "rv60", {1440: 360})],
    {**{c: f"sqrt(greatest(s{n}_sum, 0.0)) * sqrt(525600.0 / {n})" for n, c in _rv.items()}, "vol_of_vol": "v1440_std"},
)

FAMILIES["vss"] = Plan(
    [
        RET0,
        {"v": roll("stddev_samp", "r", 30, 10, ago=1)},
        {"m": roll("avg", "v", 240, 50, ago=1), "s": roll("stddev_samp", "v", 240, 50, ago=1)},
        {"z": clip("coalesce((v - m) / greatest(s, 1e-9), 0.0)", -3.0, 3.0)},
        {f"m_{k}": f"CASE WHEN z < -0.5 THEN {a} WHEN z > 0.5 THEN {c} ELSE {b} END" for k, (a, b, c) in FITNESS.items()},
    ],
    {**{f"vss_match_{k}": f"m_{k}" for k in FITNESS}, "vss_avg_match": "(" + " + ".join(f"m_{k}" for k in FITNESS) + ") / 8.0"},
)

FAMILIES["rhythm"] = Plan(
    [*vol_z(5.0), {"av": "abs(vz)", "spike": flag("vz > 1.5")}, {"am": roll("avg", "av", 60, 20), "as_": roll("stddev_samp", "av", 60, 20), "sd": f"coalesce({roll('avg', 'spike', 240, 30)}, 0.0)", "ss": f"coalesce({roll('stddev_samp', 'spike', 240, 30)}, 0.0)"}],
    {"tr_burstiness": clip("coalesce((as_ - am) / (as_ + am + 1e-9), 0.0)", -1.0, 1.0), "tr_vol_z_var_240": clip(f"coalesce({roll('var_samp', 'vz', 240, 30)}, 0.0)", 0.0, 25.0), "tr_inter_arrival_cv": clip("ss / (sd + 1e-9)", 0.0, 5.0)},
)

_ratio = lambda n: clip(f"coalesce(mv{n} / NULLIF(base * {n} * (1.0 + 0.3 * vz{n}), 0), 1.0)", 0.0, 5.0)
FAMILIES["absorp"] = Plan(
    [
        RET0,
        {"ar": "abs(r)"},
        *vol_z(3.0),
        {"base": roll("avg", "ar", 60, 10), "mv5": roll("sum", "ar", 5, 2), "mv15": roll("sum", "ar", 15, 2), "vz5": roll("avg", "vz", 5, 2), "vz15": roll("avg", "vz", 15, 2)},
        {"q5": _ratio(5), "q15": _ratio(15)},
        {"strong": flag("q5 < 0.5 AND vz > 0")},
    ],
    {"abs_ratio_5": "q5", "abs_ratio_15": "q15", "abs_streak": over("sum", "strong", -9)},
)

FAMILIES["pvd"] = Plan(
    [{"pd": f"coalesce(sign(close - {lag('close')}), 0.0)", "vd": f"coalesce(sign(volume - ({roll('avg', 'volume', 100, 10)})), 0.0)"}, *corr("pd", "vd", 30, 10), *corr("pd", "vd", 120, 20)[1:], {"a": zero("corr30"), "b": zero("corr120")}],
    {"pvd_corr_30": "a", "pvd_corr_120": "b", "pvd_disagreement": flag("round(a, 9) * round(b, 9) < 0")},
)

# bars since the extreme, the latest of equal ones: the first of the last 30 bars, counted back, that reaches it
_age = lambda x, top: "CASE " + " ".join(f"WHEN {lag(x, k)} = {top} THEN {k - 1}" for k in range(1, 31)) + " ELSE 0 END"
FAMILIES["extension"] = Plan(
    [
        *atr_safe(14, 14, 1e-9),
        {"hp": roll("max", "high", 30, 2, ago=1), "lp": roll("min", "low", 30, 2, ago=1)},
        {"dh": "abs(close - hp) / safe14", "dl": "abs(close - lp) / safe14", "ah": _age("high", "hp"), "al": _age("low", "lp")},
        {"dist": "CASE WHEN dl > dh THEN dl ELSE dh END"},
    ],
    {"ext_dist_from_swing_atr": "dist", "ext_bars_from_swing": "CASE WHEN dl > dh THEN al ELSE ah END", "ext_overextended": flag("dist > 2.5")},
)

_past = {"top": roll("max", "high", 30, 30, ago=1), "bottom": roll("min", "low", 30, 30, ago=1)}
_broke = lambda side, op, back: flag("rn >= 37 AND (" + " OR ".join(f"({lag('close', k)} {op} {lag(side, k)} AND close {back} {lag(side, k)})" for k in range(1, 6)) + ")")
FAMILIES["sweep"] = Plan(
    [
        {**_past, "rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"},
        {"sa": flag("rn >= 32 AND high > top AND close <= top"), "sb": flag("rn >= 32 AND low < bottom AND close >= bottom"), "fa": _broke("top", ">", "<="), "fb": _broke("bottom", "<", ">=")},
        {"hit": "CASE WHEN sa + sb + fa + fb > 0 THEN rn END"},
        {"last_at": ffill("hit")},
    ],
    {"swp_sweep_above_recent": over("sum", "sa", -9), "swp_sweep_below_recent": over("sum", "sb", -9), "swp_failed_break_above": over("sum", "fa", -9), "swp_failed_break_below": over("sum", "fb", -9), "swp_bars_since_last": "least(coalesce(rn - last_at, 100), 100)"},
)

SESSION = [
    {"rth": RTH, "tp": "(high + low + close) / 3.0"},
    {"edge": f"CASE WHEN rth <> coalesce({lag('rth')}, rth) THEN 1 ELSE 0 END"},
    {"sid": over("sum", "edge", None)},
]
_cum = lambda x: f"sum({x}) OVER (PARTITION BY symbol, sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
VWAP = [
    *SESSION,
    {"c1": _cum("tp * volume"), "c0": _cum("volume"), "c2": _cum("tp * tp * volume")},
    {"k1": lag("c1"), "k0": lag("c0"), "k2": lag("c2")},
    {"vwap": div("k1", "k0")},
    {"var_": f"greatest({div('k2', 'k0')} - vwap * vwap, 0.0)"},
    {"sigma": "sqrt(CASE WHEN var_ < 1e-6 THEN 0.0 ELSE var_ END)"},
]
FAMILIES["vwap"] = Plan(
    [*VWAP, *atr_safe(14, 14, 1e-9), {"old": lag("vwap", 15)}],
    {
        "vwap_dist_atr": zero("(close - vwap) / safe14"), "vwap_band_position": clip(zero("(close - vwap) / greatest(sigma, 1e-9)"), -3.0, 3.0),
        "vwap_dist_to_upper1_atr": zero("(vwap + sigma - close) / safe14"), "vwap_dist_to_lower1_atr": zero("(close - vwap + sigma) / safe14"), "vwap_slope_15m": clip(zero("(vwap - old) / safe14"), -5.0, 5.0),
    },
)

FAMILIES["spool"] = Plan(
    [
        *atr_safe(14),
        {"sh": roll("max", "high", 60, 10, ago=1), "sl": roll("min", "low", 60, 10, ago=1), "rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"},
        {"up": "rn > 60 AND sh > close", "dn": "rn > 60 AND sl < close", "pool": clip("(sh - sl) / safe14 * 0.3", 0.5, 5.0)},
        {"da": "CASE WHEN up THEN (sh - close) / safe14 ELSE 10.0 END", "db": "CASE WHEN dn THEN (close - sl) / safe14 ELSE 10.0 END"},
    ],
    {"sp_pool_above_size_atr": "CASE WHEN up THEN pool ELSE 0.0 END", "sp_pool_below_size_atr": "CASE WHEN dn THEN pool ELSE 0.0 END", "sp_trigger_distance_above_atr": "least(da, 10.0)", "sp_trigger_distance_below_atr": "least(db, 10.0)", "sp_pool_imminent": flag("da < 0.3 OR db < 0.3")},
)

FAMILIES["scomp"] = Plan(
    [
        *atr_safe(60),
        {"rng": "high - low"},
        {"cr": f"({roll('avg', 'rng', 20, 10, ago=1)}) / safe60", "em": "rng / safe60", "bp": "CASE WHEN rng > 1e-9 THEN (close - low) / rng ELSE 0.5 END"},
        {"act": flag("cr < 0.7 AND em > 1.5 AND (bp >= 0.75 OR bp <= 0.25)")},
    ],
    {
        "scomp_active": "act", "scomp_strength": clip(f"0.4 * act + 0.25 * coalesce({clip('1.0 - cr / 0.7', 0.0, 1.0)}, 0.0) + 0.2 * {clip('(em - 1.5) / 1.5', 0.0, 1.0)} + 0.15 * least(abs(bp - 0.5) * 2.0, 1.0)", 0.0, 1.0),
        "scomp_direction": "CASE WHEN act = 0 THEN 0 WHEN bp >= 0.75 THEN 1 ELSE -1 END", "scomp_compression_ratio": zero(clip("cr", 0.0, 2.0)), "scomp_expansion_magnitude": clip("em", 0.0, 5.0),
    },
)

PRIMITIVES: dict[str, Plan] = {
    "flagship_causal_bars": Plan([HAS_PREV, RET, *atr(), *rsi(14), {"a": lag("atr14"), "b": lag("rsi14"), "c": lag("lr")}], {"atr14": "a", "rsi14": "b", "logret": "c"}),
    "rolling_ohlcv_3": Plan([{"o3": lag("open", 2)}], {"open": "o3", "high": roll("max", "high", 3, 3), "low": roll("min", "low", 3, 3), "close": f"CASE WHEN o3 IS NOT NULL THEN close END", "volume": roll("sum", "volume", 3, 3)}),  # noqa: F541
    "causal_shift_matrix": Plan([], {c: lag(c) for c in ("open", "high", "low", "close", "volume")}),
    "atr_true_range": Plan([*atr_safe(14), {"atr60": roll("avg", "tr", 60, 15)}], {"tr": "tr", "atr14": "atr14", "atr14_safe": "safe14", "atr60": "atr60"}, digits=9),
    "rsi_100": Plan([HAS_PREV, *rsi(14), *rsi(5)], {"rsi14": "rsi14", "rsi5": "rsi5"}),
    "rsi_pm1": Plan([HAS_PREV, *rsi(14)], {"rsi14": "(rsi14 - 50.0) / 50.0"}),
    "zscore_volume": Plan([], {"volz": f"(volume - ({roll('avg', 'volume', 16, 4)})) / (({roll('stddev_samp', 'volume', 16, 4)}) + 1e-9)"}),
    "rolling_corr_pair": Plan([RET, *corr("lr", "volume", 30, 10)], {"corr30": "corr30"}),
    "lagged_corr_5": Plan([RET, {"l5": lag("lr", 5)}, *corr("lr", "l5", 60, 10)], {"corr60": "corr60"}),
    "expanding_median_volume": Plan([], {"median_volume": f"CASE WHEN {over('count', 'volume', None, -1)} >= 200 THEN @median(volume){frame(None, -1)}@ END"}),
    "session_ids": Plan(SESSION, {"session_id": "sid", "in_rth": flag("rth")}),
    "session_vwap_sigma": Plan(VWAP, {"vwap": "vwap", "sigma": "sigma"}, digits=9),
    "signed_run_length": Plan(
        [{"d": f"coalesce(sign(close - {lag('close')}), 0.0)"}, {"cut": f"CASE WHEN d = coalesce({lag('d')}, 9.0) THEN 0 ELSE 1 END"}, {"isle": over("sum", "cut", None)}],
        {"run": "d * row_number() OVER (PARTITION BY symbol, isle ORDER BY ts)"},
    ),
    "bars_since_event": Plan([{"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"}, {"hit": "CASE WHEN volume >= 2 THEN rn END"}, {"last_at": ffill("hit")}], {"bars_since": "least(coalesce(rn - last_at, 100), 100)"}),
    "price_block_tf15": Plan(
        [HAS_PREV, RET, *atr(), *rsi(14), *rsi(5), {"rng": "high - low"}, {"rp": "rng / NULLIF(close, 0)"}],
        {
            "logret": "lr", "vnret": "lr / NULLIF(atr14 / NULLIF(close, 0), 0)", "body": "(close - open) / (rng + 1e-9)", "uwick": "(high - greatest(open, close)) / (rng + 1e-9)", "lwick": "(least(open, close) - low) / (rng + 1e-9)", "rangepct": "rp",
            "rangez": f"(rp - ({roll('avg', 'rp', 16, 4)})) / (({roll('stddev_samp', 'rp', 16, 4)}) + 1e-9)", "rsi14": "(rsi14 - 50.0) / 50.0", "rsi5": "(rsi5 - 50.0) / 50.0", "volz": f"(volume - ({roll('avg', 'volume', 16, 4)})) / (({roll('stddev_samp', 'volume', 16, 4)}) + 1e-9)",
        },
    ),
    "momentum_baseline": Plan(
        [*atr(), {"mv": f"close - {lag('close', 10)}"}, {"th": "0.5 * atr14 * sqrt(10.0)"}, {"lo": clip("mv / (th + 1e-9)", 0.0, 2.0), "sh": clip("-mv / (th + 1e-9)", 0.0, 2.0)}],
        {"long_tp_pred": f"coalesce({lag('lo')}, 0.0) / 2.0", "short_tp_pred": f"coalesce({lag('sh')}, 0.0) / 2.0"},
    ),
}
for _n in (1, 5, 60):
    PRIMITIVES[f"ohlcv_{_n}m"] = Plan([], {c: c for c in ("open", "high", "low", "close", "volume")}, minutes=_n)


_ret = lambda x, k: f"ln(NULLIF({x}, 0) / NULLIF({lag(x, k)}, 0))"
_cross = {n: (f"{n}5", f"{n}30") for n in ("nq", "es", "zb")}


def _corr_as(name: str, x: str, y: str, n: int, least: int) -> list[dict[str, str]]:
    """corr() under a name of its own."""
    own = lambda t: t.replace("cx", f"{name}_x").replace("cy", f"{name}_y").replace(f"corr{n}", name)
    parts = [f"cn{n}", f"sxy{n}", f"sxx{n}", f"syy{n}", f"sx{n}", f"sy{n}", f"vx{n}", f"vy{n}"]
    out = []
    for step in corr("\0", "\1", n, least):
        new = {}
        for k, e in step.items():
            k, e = own(k), own(e)
            for p in parts:
                k, e = k.replace(p, f"{name}_{p}"), e.replace(p, f"{name}_{p}")
            new[k] = e.replace("\0", x).replace("\1", y)
        out.append(new)
    return out


_agree = {n: f"CASE WHEN {n}5 IS NULL THEN 0.5 WHEN sign({n}5) = sign(p5) THEN 1.0 ELSE 0.0 END" for n in _cross}
FAMILIES["cross"] = Plan(
    [
        {"p1": _ret("close", 1), "p5": _ret("close", 5), **{f"{n}{k}": _ret(f"{n}_close", k) for n in _cross for k in (1, 5, 30)}},
        *[s for n in _cross for s in _corr_as(f"c_{n}", f"{n}1", "p1", 30, 10)],
    ],
    {
        **{f"{n}_{c}": e for n in _cross for c, e in {"ret_5m": zero(f"{n}5"), "ret_30m": zero(f"{n}30"), "corr_30m_mnq": zero(f"c_{n}"), "diverge_mnq": f"CASE WHEN {n}5 IS NULL THEN 0.0 WHEN p5 IS NOT NULL AND sign({n}5) = sign(p5) THEN 0.0 ELSE 1.0 END"}.items()},
        "cross_asset_alignment": "(" + " + ".join(_agree.values()) + ") / 3.0",
        "cross_asset_data_avail": flag(" AND ".join(f"{n}_close IS NOT NULL" for n in _cross)),
    },
    cross=True,
)

FAMILIES["creg"] = Plan(
    [
        {f"{n}1": _ret(f"{n}_close", 1) for n in _cross},
        *_corr_as("c_ne", "nq1", "es1", 60, 20),
        *_corr_as("c_nz", "nq1", "zb1", 60, 20),
        {"ne": zero("c_ne"), "nz": zero("c_nz")},
        *moments("b", "ne", {1440: 200}),
    ],
    {"cr_nq_es_corr_60": "ne", "cr_nq_zb_corr_60": "nz", "cr_corr_regime_z": clip(zero(div("ne - b1440_mean", "b1440_std")), -5.0, 5.0), "cr_avail": "1.0"},
    cross=True,
)

# how the others' earlier returns go with the primary's present ones
FAMILIES["leadlag"] = Plan(
    [
        {"p1": _ret("close", 1), **{f"{n}1": _ret(f"{n}_close", 1) for n in _cross}},
        {f"{n}_l{k}": lag(f"{n}1", k) for n in _cross for k in (1, 5, 15)},
        *[s for n in _cross for k in (1, 5, 15) for s in _corr_as(f"c_{n}{k}_", f"{n}_l{k}", "p1", 60, 10)],
    ],
    {f"flow_ll_{n}_lag{k}": zero(f"c_{n}{k}_") for n in _cross for k in (1, 5, 15)},
    cross=True,
)

PRIMITIVES["align_cross_assets"] = Plan([], {f"{n}_{c}": f"{n}_{c}" for n in _cross for c in ("open", "high", "low", "close", "volume")}, cross=True)
