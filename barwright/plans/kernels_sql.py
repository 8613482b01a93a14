"""SQL of what runs as grouped maps, written without them: recursions and range joins over the demo's 15-minute bars."""

from __future__ import annotations

from barwright.functions import HAS_PREV, atr_safe, clip, lag, roll, rsi
from barwright.operators import families, setups, structure
from barwright.plans import Plan
from barwright.sources import bars_sql


def averages_sql(inner: str, spans: tuple[int, ...], x: str = "close") -> str:
    """(symbol, ts, rn, e{span}): exponential averages of x over the rows of ``inner``, as a recursion."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS e{s}" for s in spans)
    later = ", ".join(f"e.e{s} + 2e0 / {s + 1} * (b.{x} - e.e{s})" for s in spans)
    return f"""WITH RECURSIVE b AS (SELECT symbol, ts, {x}, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({inner}) x),
e AS (SELECT symbol, ts, rn, {first} FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, {later} FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
SELECT * FROM e"""


def facc() -> str:
    flow = f"SELECT symbol, ts, coalesce((close - lag(close) OVER w) * volume, 0) AS flow FROM ({bars_sql(15)}) x WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    tidy = lambda x: f"greatest(least(coalesce(({x}) / norm, 0), 5), -5) + 0.0"
    return f"""SELECT symbol, ts, {tidy("e30")} AS fa_delta_ema30, {tidy("e30 - e5")} AS fa_delta_accel_5, {tidy("e30 - e60")} AS fa_delta_accel_30
FROM (SELECT symbol, ts, e30, lag(e30, 5) OVER o AS e5, lag(e30, 30) OVER o AS e60, CASE WHEN count(*) OVER f >= 30 THEN nullif(avg(abs(flow)) OVER f, 0) END AS norm
FROM ({averages_sql(flow, (30,), "flow")}) a JOIN ({flow}) g USING (symbol, ts) WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)) s"""


def mtf() -> str:
    parts, cols = [], []
    for m in (5, 15, 60, 240):
        coarse = f"SELECT symbol, time_bucket(INTERVAL '{m} minutes', ts) AS ts, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM ({bars_sql(15)}) x GROUP BY 1, 2"
        value = f"SELECT symbol, ts + INTERVAL '{m} minutes' AS ts, CASE WHEN count(*) OVER (PARTITION BY symbol) >= 25 THEN tanh(5 * coalesce((e20 - lag(e20) OVER o) / nullif(CASE WHEN count(*) OVER f >= 2 THEN avg(high - low) OVER f END, 0), 0)) ELSE 0 END AS v FROM ({averages_sql(coarse, (20,))}) a JOIN ({coarse}) c USING (symbol, ts) WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
        parts.append(f"ASOF LEFT JOIN ({value}) t{m} ON t{m}.symbol = g.symbol AND g.ts >= t{m}.ts")
        cols.append(f"coalesce(t{m}.v, 0) AS mtf_trend_sign_{m}m")
    return f"SELECT *, (mtf_trend_sign_5m + mtf_trend_sign_15m + mtf_trend_sign_60m + mtf_trend_sign_240m) / 4 AS mtf_alignment_score FROM (SELECT g.symbol, g.ts, {', '.join(cols)} FROM (SELECT symbol, ts FROM ({bars_sql(15)}) z) g {' '.join(parts)}) q"


def spb() -> str:
    """Trend pullbacks: a plan over bars with three averages."""
    long = "a8 > a21 AND a21 > a50 AND d8 <= -0.3 AND d8 >= -1.5 AND d21 >= -0.5 AND rs >= 30.0 AND rs <= 50.0"
    short = "a8 < a21 AND a21 < a50 AND d8 >= 0.3 AND d8 <= 1.5 AND d21 <= 0.5 AND rs >= 50.0 AND rs <= 70.0"
    depth = f"CASE WHEN way <> 0 AND top > 0 AND bottom > 0 AND top - bottom > 1e-9 THEN {clip('CASE WHEN way = 1 THEN top - close ELSE close - bottom END / (top - bottom)', 0.0, 1.0)} ELSE 0.0 END"
    plan = Plan(
        [HAS_PREV, *rsi(14), *atr_safe(14), {"a8": lag("e8"), "a21": lag("e21"), "a50": lag("e50"), "rs": f"coalesce({lag('rsi14')}, 50.0)", "top": roll("max", "high", 60, 60, ago=1), "bottom": roll("min", "low", 60, 60, ago=1)},
         {"d8": "(close - a8) / safe14", "d21": "(close - a21) / safe14"}, {"way": f"CASE WHEN {long} THEN 1 WHEN {short} THEN -1 ELSE 0 END"}, {"depth": depth}],
        {
            "spb_active": "abs(way)", "spb_direction": "way", "spb_pullback_depth": "depth", "spb_dist_to_ema21_atr": clip("d21", -3.0, 3.0),
            "spb_strength": clip(f"0.4 * abs(way) + 0.25 * least(abs(a8 - a21) / safe14, 2.0) / 2.0 + 0.2 * {clip('1.0 - 2.0 * abs(depth - 0.5)', 0.0, 1.0)} + 0.15 * {clip('1.0 - abs(d8) / 1.5', 0.0, 1.0)}", 0.0, 1.0),
        },
        raw=True,
    )
    return plan.sql(f"SELECT o.*, e8, e21, e50 FROM ({bars_sql(15)}) o JOIN ({averages_sql(bars_sql(15), (8, 21, 50))}) a USING (symbol, ts)")


def _touches(window: int, near: float, away: float, after: int = 5) -> str:
    """(symbol, ts, rn, close, atr, high_level, high_n, high_age, low_level, low_n, low_age): how often the extremes of the last bars were met and left again."""
    safe = Plan(atr_safe(14), {"atr": "safe14"}, raw=True).sql()
    low = ", ".join(f"min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING) AS lo{w}, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING) AS hi{w}" for w in range(after + 1))
    pick = lambda c: "CASE least(t.rn - j.rn, " + f"{after + 1}) " + " ".join(f"WHEN {w + 1} THEN j.{c}{w}" for w in range(after + 1)) + " END"
    return f"""WITH b AS (SELECT x.*, atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, {low} FROM ({bars_sql(15)}) x JOIN ({safe}) s USING (symbol, ts)),
t AS (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bottom FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)),
m AS (SELECT t.symbol, t.rn, t.rn - j.rn AS age, abs(j.high - t.top) <= {near} * t.atr AND t.top - {pick("lo")} >= {away} * t.atr AS up, abs(j.low - t.bottom) <= {near} * t.atr AND {pick("hi")} - t.bottom >= {away} * t.atr AS down
 FROM t JOIN b j ON j.symbol = t.symbol AND j.rn BETWEEN t.rn - {window} AND t.rn - 1 WHERE t.rn > {window}),
c AS (SELECT symbol, rn, count(*) FILTER (up) AS high_n, min(age) FILTER (up) AS high_age, count(*) FILTER (down) AS low_n, min(age) FILTER (down) AS low_age FROM m GROUP BY symbol, rn)
SELECT t.symbol, t.ts, t.close, t.atr, CASE WHEN rn > {window} THEN top END AS top, CASE WHEN rn > {window} THEN bottom END AS bottom, coalesce(high_n, 0) AS high_n, coalesce(high_age, {window + 1}) AS high_age, coalesce(low_n, 0) AS low_n, coalesce(low_age, {window + 1}) AS low_age FROM t LEFT JOIN c USING (symbol, rn)"""


def sfa() -> str:
    return f"""WITH s AS (SELECT *, high_n >= 3 AND high_age <= 8 AS up, low_n >= 3 AND low_age <= 8 AND (low_n > high_n OR NOT (high_n >= 3 AND high_age <= 8)) AS down FROM ({_touches(60, 0.08, 0.5)}) x),
d AS (SELECT *, CASE WHEN down THEN low_n WHEN up THEN high_n ELSE 0 END AS n, CASE WHEN down THEN low_age WHEN up THEN high_age ELSE 61 END AS age FROM s)
SELECT symbol, ts, CAST(n >= 3 AS INT) AS sfa_active, greatest(least(0.4 * CAST(n >= 3 AS INT) + 0.35 * pow(0.5, age / 8e0) + 0.25 * greatest(least((n - 3) / 3e0, 1), 0), 1), 0) AS sfa_strength,
 CASE WHEN down THEN 1 WHEN up THEN -1 ELSE 0 END AS sfa_direction, least(n, 8) AS sfa_touch_count, least(age, 10) AS sfa_age_bars FROM d"""


def sld() -> str:
    return f"""WITH s AS (SELECT *, high_n >= 3 AS up, low_n >= 3 AND (low_n > high_n OR high_n < 3) AS down FROM ({_touches(240, 0.1, 0.4)}) x),
d AS (SELECT *, CASE WHEN down THEN low_n WHEN up THEN high_n ELSE 0 END AS n, CASE WHEN down THEN 1 WHEN up THEN -1 ELSE 0 END AS way, coalesce((CASE WHEN down THEN bottom WHEN up THEN top END - close) / atr, 0) AS d FROM s),
a AS (SELECT *, CAST(way <> 0 AND -way * d >= 0.1 AND -way * d <= 0.5 AS INT) AS act FROM d)
SELECT symbol, ts, act AS sld_active, greatest(least(0.4 * act + 0.35 * greatest(least((n - 3) / 4e0, 1), 0) + 0.25 * greatest(least(1 - abs(d) / 0.5, 1), 0), 1), 0) AS sld_strength, act * way AS sld_direction, least(n, 8) AS sld_defense_count, greatest(least(d, 2), -2) AS sld_dist_to_level_atr FROM a"""


def _setup_table() -> str:
    plans = families.FAMILIES | setups.SETUPS
    tables = {"mtf": mtf(), "spb": spb(), "sfa": sfa(), "sld": sld()} | {n: plans[n].sql() for n in ("sfs", "orb", "svwap", "seod", "scomp")}
    return "SELECT * FROM (SELECT symbol, ts FROM (" + bars_sql(15) + ") z) g " + " ".join(f"JOIN ({q}) t_{n} USING (symbol, ts)" for n, q in tables.items())


def scnf() -> str:
    count = lambda cond: " + ".join(f"CAST({n}_active >= 0.5{cond.format(n)} AS INT)" for n in structure.PRIORITY)
    return f"""SELECT symbol, ts, l AS scf_long_count, s AS scf_short_count, (l - s) / greatest(t, 1e0) AS scf_consensus_score, t AS scf_total_active
FROM (SELECT symbol, ts, {count(" AND {}_direction > 0.5")} AS l, {count(" AND {}_direction < -0.5")} AS s, {count("")} AS t FROM ({_setup_table()}) x) y"""


def shtf() -> str:
    agree = {n: f"greatest(least({n}_direction * mtf_alignment_score, 1), -1)" for n in structure.PRIORITY}
    mid = {n: f"greatest(least({n}_direction * mtf_trend_sign_60m, 1), -1)" for n in structure.PRIORITY}
    first = lambda of: "CASE " + " ".join(f"WHEN {n}_active >= 0.5 THEN {of[n]}" for n in structure.PRIORITY) + " ELSE 0 END"
    count = lambda op: " + ".join(f"CAST({n}_active >= 0.5 AND {agree[n]} {op} 0 AS INT)" for n in structure.PRIORITY)
    each = ", ".join(f"CASE WHEN {n}_active >= 0.5 THEN {agree[n]} ELSE 0 END AS {n}_htf_agree" for n in structure.PRIORITY)
    return f"SELECT symbol, ts, {each}, {first(agree)} AS shtf_primary_agree, {first(mid)} AS shtf_primary_60m, {count('>')} AS shtf_aligned_count, {count('<')} AS shtf_opposed_count FROM ({_setup_table()}) x"


FRAMES = {"4h": 240, "1d": 1440, "1w": 10_080}


def _coarse(minutes: int) -> str:
    """Coarser bars; their bins start on a symbol's first day."""
    return f"SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts, day0) AS ts, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM (SELECT *, date_trunc('day', min(ts) OVER (PARTITION BY symbol)) AS day0 FROM ({bars_sql(15)}) x) y GROUP BY 1, 2"


def trend() -> str:
    parts, cols, names = [], [], []
    for n, m in FRAMES.items():
        tr = f"SELECT *, greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) AS tr, count(*) OVER (PARTITION BY symbol) AS bars FROM ({_coarse(m)}) c WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
        value = f"SELECT symbol, ts + INTERVAL '{m} minutes' AS ts, coalesce((e50 - lag(e50) OVER o) / nullif(CASE WHEN count(*) OVER f >= 2 THEN avg(tr) OVER f END, 0), 0) AS v FROM ({averages_sql(_coarse(m), (50,))}) a JOIN ({tr}) t USING (symbol, ts) WHERE bars >= 2 WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
        short = f"symbol NOT IN (SELECT symbol FROM ({value}) k)"
        parts.append(f"ASOF LEFT JOIN ({value}) t{n} ON t{n}.symbol = g.symbol AND g.ts >= t{n}.ts")
        cols.append(f"CASE WHEN g.{short} THEN 0 ELSE t{n}.v END AS trend_{n}_slope, CASE WHEN g.{short} THEN 0.5 WHEN t{n}.v IS NOT NULL THEN 0.5 END AS trend_{n}_hurst")
        names.append(f"trend_{n}_slope")
    return f"SELECT *, ({' + '.join(f'sign({c})' for c in names)}) / 3e0 AS trend_alignment, ({' + '.join(f'abs({c}) * 0.5' for c in names)}) / 3e0 AS trend_strength FROM (SELECT g.symbol, g.ts, {', '.join(cols)} FROM (SELECT symbol, ts FROM ({bars_sql(15)}) z) g {' '.join(parts)}) q"


def liquidity(reach: int = 3) -> str:
    """Each extreme of coarser bars from its confirmation to its first touch, joined with the bars in between."""
    tables = []
    for n, m in FRAMES.items():
        for side, c, f, op in (("above", "high", "max", ">"), ("below", "low", "min", "<")):
            sign = "" if side == "above" else "-"
            peaks = f"SELECT symbol, {c} AS level, lead(ts, {reach}) OVER o + INTERVAL '{m} minutes' AS born FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars FROM ({_coarse(m)}) c) d WINDOW o AS (PARTITION BY symbol ORDER BY ts) QUALIFY bars >= {4 * reach} AND {c} {op} {f}({c}) OVER (o ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING) AND {c} {op} {f}({c}) OVER (o ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AND lag(ts, {reach}) OVER o IS NOT NULL"
            open_ = f"SELECT p.symbol, p.level, p.born, min(b.ts) FILTER (b.{c} {op}= p.level) AS touched FROM ({peaks}) p JOIN ({bars_sql(15)}) b ON b.symbol = p.symbol AND b.ts >= p.born WHERE p.born IS NOT NULL GROUP BY 1, 2, 3"
            tables.append(f"SELECT b.symbol, b.ts, '{side}_{n}' AS kind, min({sign}(p.level - b.close)) AS d FROM ({bars_sql(15)}) b JOIN ({open_}) p ON p.symbol = b.symbol AND b.ts >= p.born AND (p.touched IS NULL OR b.ts < p.touched) GROUP BY 1, 2")
    names = [f"{s}_{n}" for n in FRAMES for s in ("above", "below")]
    safe = Plan(atr_safe(14, 2, 0.0), {"atr": "safe14"}, raw=True).sql()
    cols = [f"least(coalesce(max(d) FILTER (kind = '{k}') / any_value(atr), 6), 6)" for k in names]
    each = ", ".join(f"{c} AS lz_dist_{k}_atr" for c, k in zip(cols, names))
    return f"SELECT s.symbol, s.ts, {each}, least({', '.join(cols)}) AS lz_closest_zone_atr FROM ({safe}) s LEFT JOIN ({' UNION ALL '.join(tables)}) z USING (symbol, ts) GROUP BY 1, 2"


def lasym() -> str:
    col = lambda s: [f"lz_dist_{s}_{n}_atr" for n in FRAMES]
    count = lambda s: " + ".join(f"CAST({c} < 5.5 AS INT)" for c in col(s))
    return f"""SELECT symbol, ts, (nu - nd) / (nu + nd + 1e0) AS la_count_asymmetry, greatest(least(b - a, 6), -6) AS la_dist_asymmetry, (1 / (b + 0.5) - 1 / (a + 0.5)) / (1 / (b + 0.5) + 1 / (a + 0.5) + 1e-6) AS la_strength_imbalance
FROM (SELECT symbol, ts, {count("above")} AS nu, {count("below")} AS nd, least({", ".join(col("above"))}) AS a, least({", ".join(col("below"))}) AS b FROM ({liquidity()}) x) y"""


def tstruct(reach: int = 5, confirm: int = 5) -> str:
    """Swings as rows; a bar sees the last one that is confirmed."""
    span = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
    safe = Plan(atr_safe(14, 2, 1e-9), {"atr": "safe14"}, raw=True).sql()
    high, low = (f"[x FOR x IN four IF {t}]" for t in ("x.top", "NOT x.top"))
    way = lambda q: f"sign({q}[2].price - {q}[1].price)"
    return f"""WITH b AS (SELECT x.*, atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n, count(*) OVER {span} AS around, high >= max(high) OVER {span} AS hi, low <= min(low) OVER {span} AS lo FROM ({bars_sql(15)}) x JOIN ({safe}) s USING (symbol, ts)),
s AS (SELECT symbol, rn, rn + {confirm} AS seen, hi AS top, CASE WHEN hi THEN high ELSE low END AS price FROM b WHERE around = {2 * reach + 1} AND (hi OR lo)),
f AS (SELECT *, array_agg(struct_pack(top := top, price := price)) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS four FROM s),
g AS (SELECT symbol, rn AS at, seen, price, CASE WHEN len(four) < 4 OR len({high}) <> 2 THEN -1 WHEN {way(high)} = 1 AND {way(low)} = 1 THEN 0 WHEN {way(high)} = -1 AND {way(low)} = -1 THEN 1 WHEN {way(high)} = -1 AND {way(low)} = 1 THEN 2 ELSE 3 END AS state FROM f)
SELECT b.symbol, b.ts, {", ".join(f"CAST(coalesce(state, -1) = {k} AS INT) AS ts_state_{c}" for k, c in enumerate(("bull", "bear", "range", "transition")))}, least(coalesce(b.rn - g.at, b.n), 1440) AS ts_last_swing_age_bars, greatest(least(coalesce((g.price - b.close) / b.atr, 0), 10), -10) AS ts_last_swing_dist_atr
FROM b ASOF LEFT JOIN g ON g.symbol = b.symbol AND b.rn >= g.seen"""
