"""The feature matrix, labels, evaluation, routing and calibration against plain loops on small cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import moments
from barwright.operators import evaluation, features, kernels, labels, router, structure
from barwright.plans import Plan
from barwright.sources import align

T0 = dt.datetime(2024, 3, 4, 12)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def history(n: int, seed: int = 1, symbol: str = "a", minutes: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    c = np.round(100 + np.cumsum(rng.normal(0, 0.4, n)), 2)
    o = np.concatenate([[100.0], c[:-1]])
    hi, lo = np.round(np.maximum(o, c) + rng.exponential(0.3, n), 2), np.round(np.minimum(o, c) - rng.exponential(0.3, n), 2)
    return [(symbol, T0 + dt.timedelta(minutes=minutes * k), float(o[k]), float(hi[k]), float(lo[k]), float(c[k]), int(rng.integers(1, 40))) for k in range(n)]


@pytest.fixture(scope="module")
def minute_bars(spark):
    return spark.createDataFrame([*history(2400), *history(2400, 2, "b")], SCHEMA).cache()


def local(df) -> pd.DataFrame:
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_moments_equal_frames(spark):
    rng = np.random.default_rng(5)
    x = [None if k % 17 == 3 else float(v) for k, v in enumerate(rng.normal(3, 0.01, 900))]
    x[400:700] = [2.5] * 300
    rows = [("s", T0 + dt.timedelta(minutes=k), v) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    plan = Plan(moments("m", "x", {150: 20, 400: 100}), {f"m{n}_{k}": f"m{n}_{k}" for n in (150, 400) for k in ("sum", "mean", "std")}, raw=True)
    got, s = local(plan.apply(df)), pd.Series(x, dtype=float)
    for n, least in ((150, 20), (400, 100)):
        w = s.rolling(n, min_periods=least)
        for k, want in (("sum", w.sum()), ("mean", w.mean()), ("std", w.std())):
            np.testing.assert_allclose(got[f"m{n}_{k}"].astype(float), want, rtol=1e-7, atol=1e-8, equal_nan=True)
    assert (got["m150_std"][570:690] == 0).all()


def brute_labels(bars: pd.DataFrame, horizon: int, points: float | None) -> list[dict]:
    """Every label by walking ahead bar by bar."""
    tr = []
    for k in range(len(bars)):
        prev = bars["close"][k - 1] if k else bars["low"][k]
        tr.append(max(bars["high"][k], prev) - min(bars["low"][k], prev) if k else bars["high"][k] - bars["low"][k])
    mean = [float(np.mean(tr[max(0, k - 60) : k])) if k >= 15 else None for k in range(len(bars))]
    usual = float(np.median([m for m in mean if m is not None]))
    out = []
    for k in range(len(bars) - horizon):
        atr = max(mean[k] if mean[k] is not None else usual, 0.5)
        pts, o = points or 1.5 * atr, bars["open"][k]
        when = lambda d, op: next((j for j in range(horizon) if (bars["high"][k + j] >= o + d if op else bars["low"][k + j] <= o - d)), None)
        u, d, cu, cd = when(pts, True), when(pts, False), when(1.5 * atr, True), when(1.5 * atr, False)
        u, d = horizon if u is None else u, horizon if d is None else d
        stop = min(u, d, horizon - 1)
        above, below = max(0.0, bars["high"][k : k + stop + 1].max() - o), max(0.0, o - bars["low"][k : k + stop + 1].min())
        r15, r60 = (float(np.clip((bars["close"][k + h] - bars["close"][k]) / atr, -10, 10)) for h in (min(15, horizon), horizon))
        up, down = (bars["high"][k : k + horizon].max() - o) / atr, (o - bars["low"][k : k + horizon].min()) / atr
        against = down if r60 > 0 else up if r60 < 0 else max(up, down)
        goes, back = abs(r60) >= 0.5 and against < 0.7, up + down >= 0.7 and abs(r60) < 0.3
        shape = 1 if back else 2 if up + down < 1 and not goes else 0 if goes else 0 if abs(r60) >= 0.3 else 2
        turn = o - bars["open"][k - 10] if k >= 10 else 0
        first = cu is not None and (cd is None or cu < cd)
        span = bars["ts"][k + horizon - 1] - bars["ts"][k] == pd.Timedelta(minutes=horizon - 1)
        out.append({"tp_points": pts, "long_tp": u < d, "short_tp": d < u, "time_to_long_tp": u, "time_to_short_tp": d, "mfe_long": above, "mae_long": below, "mfe_short": below, "mae_short": above, "return_h15": r15, "return_h60": r60, "path_shape_class": shape, "clears_up_first": first, "inflection_label": (turn > 2 and d < u) or (turn < -2 and u < d), "valid": span})
    return out


@pytest.mark.parametrize("points", [None, 2.0])
def test_labels_equal_a_walk(spark, points):
    rows = history(400, 7)
    del rows[250:270]  # a break
    got = local(labels.barrier_labels(spark.createDataFrame(rows, SCHEMA), 30, points))
    want = pd.DataFrame(brute_labels(pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"]), 30, points))
    assert len(got) == len(want) == 350 and 0 < want["valid"].sum() < 350
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, err_msg=c)
        assert want[c].nunique() > 1 or c == "tp_points"
    assert set(want["path_shape_class"]) <= {0, 1, 2}


def test_labels_keep_to_an_index_and_short_histories(spark):
    frame = spark.createDataFrame(history(100), SCHEMA)
    all_ = labels.barrier_labels(frame, 60)
    index = all_.where("minute(ts) % 2 = 0").select("symbol", "ts")
    assert labels.at_index(all_, index).count() == index.count() == 20
    assert labels.barrier_labels(frame.limit(10), 60).count() == 0 and labels.barrier_labels(frame.limit(0), 60).count() == 0


def test_label_scale_knows_only_the_past(spark):
    """Later bars change no distance of a barrier once there is a history."""
    rows = history(300, 3)
    wild = [*rows[:200], *[(*r[:3], r[3] + 50, r[4] - 50, *r[5:]) for r in rows[200:]]]
    a, b = (local(labels.past_range(spark.createDataFrame(x, SCHEMA))) for x in (rows, wild))
    assert np.allclose(a["atr"][15:201], b["atr"][15:201]) and not np.allclose(a["atr"][201:], b["atr"][201:])


def test_splits_need_room(spark):
    times = spark.range(600).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) AS ts")
    out = labels.walk_forward(times, 2, 60, 3).toPandas()
    assert set(out["fold"]) == {0, 1} and (out["rn"] < 600).all()
    for f, g in out.groupby("fold"):
        assert g[g["role"] == "val"]["rn"].min() - g[g["role"] == "train"]["rn"].max() > 60
    everything = labels.numbered(times).orderBy("ts").toPandas()
    assert everything["rn"].tolist() == list(range(600))
    for bad in ({"embargo": 10}, {"folds": 20}):
        with pytest.raises(ValueError):
            labels.walk_forward(times, **({"folds": 2, "embargo": 60, "months": 3} | bad))
    with pytest.raises(ValueError):
        labels.walk_forward(times.limit(0), 2, 60, 3)


def plain_block(bars: pd.DataFrame, minutes: int) -> pd.DataFrame:
    """A price block by pandas."""
    c, o, h, lo, v = (bars[k].astype(float) for k in ("close", "open", "high", "low", "volume"))
    p = c.shift(1)
    atr = (np.fmax(h, p) - np.fmin(lo, p)).rolling(14).mean().replace(0, np.nan)
    mean = lambda x, n: x.rolling(n, min_periods=n).mean()
    rsi = lambda n: (100 - 100 / (1 + mean(c.diff().clip(lower=0), n) / (mean(-c.diff().clip(upper=0), n) + 1e-9)) - 50) / 50
    z = lambda x: (x - x.rolling(240 // minutes, min_periods=240 // minutes // 4).mean()) / (x.rolling(240 // minutes, min_periods=240 // minutes // 4).std() + 1e-9)
    fast, slow = (c.ewm(span=s, adjust=False).mean() for s in (8, 32))
    r, size = np.log(c / p), h - lo
    cols = [r, r / (atr / c), (c - o) / (size + 1e-9), (h - np.maximum(o, c)) / (size + 1e-9), (np.minimum(o, c) - lo) / (size + 1e-9), size / c, z(size / c), rsi(14), rsi(5), (c - fast) / (atr + 1e-9), (c - slow) / (atr + 1e-9), (fast - slow) / (atr + 1e-9), z(v)]
    return pd.DataFrame(dict(zip(features.BLOCK, cols)))


def test_matrix_equals_pandas(minute_bars):
    got = local(features.build_features(minute_bars.where("symbol = 'a'"), timeframes=(3, 15)))
    bars = local(minute_bars.where("symbol = 'a'")).set_index("ts")
    whole = bars.resample("15min").agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}).dropna()
    roll = pd.DataFrame({"open": bars["open"].shift(2), "high": bars["high"].rolling(3).max(), "low": bars["low"].rolling(3).min(), "close": bars["close"], "volume": bars["volume"].rolling(3).sum()}).dropna()
    parts = []
    for m, frame in ((3, roll), (15, whole)):
        block = plain_block(frame, m).set_axis([f"tf{m}_{c}" for c in features.BLOCK], axis=1)
        block.index = block.index + pd.Timedelta(minutes=m)
        parts.append(block.reindex(block.index.union(bars.index)).ffill().reindex(bars.index))
    want = pd.concat(parts, axis=1).shift(1).dropna()
    assert len(got) == len(want) > 1000 and got["ts"].tolist() == want.index.tolist()
    np.testing.assert_allclose(got[want.columns].astype(float), want, rtol=1e-7, atol=1e-7)


def test_matrix_knows_only_the_past(minute_bars):
    cut = F.lit(T0 + dt.timedelta(minutes=2000))
    spec = features.Spec.parse("session, vwap, vol, mtf, liquidity, flow_none".replace(", flow_none", ""))
    full = local(features.build_features(minute_bars, spec=spec).where((F.col("symbol") == "a") & (F.col("ts") < cut)))
    part = local(features.build_features(minute_bars.where((F.col("symbol") == "a") & (F.col("ts") < cut)), spec=spec))
    pd.testing.assert_frame_equal(full, part, rtol=1e-9, atol=1e-9)


def test_spec():
    assert features.Spec.parse("none").enabled == frozenset() and features.Spec.parse("all") == features.Spec()
    assert features.Spec.parse(" Session,vol ,").enabled == {"session", "vol"} and str(features.Spec.parse("vol")) == "structural: vol"
    with pytest.raises(ValueError, match="unknown"):
        features.Spec.parse("vol, nothing")
    assert all(features.family_columns(n) for n in features.REGISTRY) and len(features.REGISTRY) == 44
    every = [c for n in features.REGISTRY for c in features.family_columns(n)]
    assert len(every) == len(set(every))
    assert [len(features.family_columns(n)) for n in ("flow", "vol", "shtf", "scnf", "simmtm", "kronos", "bocpd")] == [12, 8, 12, 4, 96, 12, 9]


def test_every_family_is_causal(spark):
    """All families at once, beside other instruments: cutting later bars changes nothing earlier."""
    names = {"es": 3, "nq": 4, "zb": 5}
    own = spark.createDataFrame(history(1100, minutes=15), SCHEMA)
    frame = align(own, {n: spark.createDataFrame(history(1100, s, n, 15), SCHEMA) for n, s in names.items()}).cache()
    # trends are 0 for a history of fewer than two coarse bars: both of these have two weeks begun
    # surprise compares with its first 5000 rows, by definition: no history here is long enough
    spec, cut = features.Spec(frozenset(features.REGISTRY) - set(features.CACHED) - {"surprise"}), T0 + dt.timedelta(minutes=15 * 900)
    full = local(features.structural_features(frame, spec))
    part = local(features.structural_features(frame.where(F.col("ts") < F.lit(cut)), spec))
    assert len(full) == 1100 and len(part) == 900
    # before the first swing its age is the number of rows, as defined
    for c in part.columns[2:]:
        np.testing.assert_allclose(full[c][60:900].astype(float), part[c][60:].astype(float), rtol=1e-8, atol=1e-8, equal_nan=True, err_msg=c)
    dead = features.degenerate(features.structural_features(frame, features.Spec.parse("session, vwap, kronos"), shift=False))
    assert {c for c, w in dead.items() if w == "null"} == set(features.family_columns("kronos"))


def test_families_ask_for_what_they_read(spark, minute_bars):
    with pytest.raises(ValueError, match="instruments"):
        features.structural_features(minute_bars, features.Spec.parse("cross"))
    with pytest.raises(FileNotFoundError):
        features.structural_features(minute_bars, features.Spec.parse("simmtm"))
    columns = features.family_columns("simmtm")
    cache = minute_bars.where("symbol = 'a' AND minute(ts) % 10 = 0").select("symbol", "ts", *[F.lit(1.5).alias(c) for c in columns])
    got = features.structural_features(minute_bars, features.Spec.parse("simmtm"), {"simmtm": cache}, shift=False)
    assert got.columns == ["symbol", "ts", *columns] and got.agg(F.sum(columns[95])).first()[0] == 1.5 * cache.count()
    assert features.structural_features(minute_bars, features.Spec.parse("none")).columns == ["symbol", "ts"]
    assert features.build_features(minute_bars.limit(0)).count() == 0


def test_late_confirmation_is_causal():
    from test_structure import bars

    pdf = bars(4000)
    for n, kernel in structure.CAUSAL.items():
        full, part = kernel(pdf), kernel(pdf.iloc[:3111])
        for c in structure.KERNELS[n][1]:
            assert np.allclose(full[c][60:3111], part[c][60:], equal_nan=True), c


def test_vpin_equals_filling_buckets_one_by_one():
    rng = np.random.default_rng(2)
    r, volume = rng.normal(0, 1e-3, 400), rng.integers(0, 40, 400).astype(float)
    bucket = np.concatenate([np.full(200, 30.0), np.full(200, 9.0)])
    dev = pd.Series(r).rolling(60, min_periods=10).std().fillna(0).to_numpy()
    done, buy, sell, held, want = [], 0.0, 0.0, 0.0, []
    for t in range(400):
        share = 0.5 * (1 + math.erf(r[t] / (dev[t] or 1e-4) / math.sqrt(2)))
        buy, sell, held = buy + volume[t] * share, sell + volume[t] * (1 - share), held + volume[t]
        while volume[t] > 0 and held >= bucket[t]:
            part = bucket[t] / held
            done.append(abs(buy - sell) * part / bucket[t])
            buy, sell, held = buy * (1 - part), sell * (1 - part), held - bucket[t]
        last = want[-1] if want else math.nan
        want.append(sum(done[-50:]) / 50 if len(done) >= 50 and volume[t] > 0 else last)
    np.testing.assert_allclose(kernels.vpin(r, volume, bucket), want, equal_nan=True, atol=1e-9)
    assert kernels.median_so_far(np.arange(1.0, 300.0))[[0, 200, 250]].tolist() == [1.0, 100.5, 125.5]


def test_mahalanobis_equals_a_loop():
    x = np.random.default_rng(3).standard_normal((300, 3))
    rate = 1 - 0.5 ** (1 / 40)
    centre, cov = x[0].copy(), 1e-3 * np.eye(3)
    got = kernels.mahalanobis(x, 40, chunk=70)
    for t in range(1, 300):
        d = x[t] - centre
        want = math.sqrt(d @ np.linalg.inv(cov + 1e-9 * np.eye(3)) @ d)
        assert math.isnan(got[t]) if t < 10 else got[t] == pytest.approx(want, rel=1e-6)
        centre = (1 - rate) * centre + rate * x[t]
        cov = (1 - rate) * cov + rate * np.outer(x[t] - centre, x[t] - centre)


def test_evaluation_of_a_given_table(spark):
    rng = np.random.default_rng(4)
    n = 500
    given = pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=n, freq="1min"), "long_tp_prob": rng.random(n), "short_tp_prob": rng.random(n)})
    truths = given[["symbol", "ts"]].assign(long_tp=(rng.random(n) < given["long_tp_prob"]).astype(int), short_tp=0, mfe_long=rng.random(n) * 9, mae_long=rng.random(n) * 9, mfe_short=1.0, mae_short=1.0, return_h60=rng.normal(size=n), tp_points=7.0, sl_points=6.0)
    ntz = lambda pdf: spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    table = evaluation.outcomes(ntz(given), ntz(truths))
    p, y = given["long_tp_prob"].to_numpy(), truths["long_tp"].to_numpy()
    pairs = p[y == 1][:, None] - p[y == 0][None]
    assert evaluation.evaluate("auc_rank", table).first()["auc"] == pytest.approx((pairs > 0).mean() + (pairs == 0).mean() / 2, abs=2e-6)
    assert evaluation.evaluate("brier_improvement", table).first()["brier"] == pytest.approx(((p - y) ** 2).mean(), abs=2e-6)
    q = given["short_tp_prob"].to_numpy()
    long, short = (p > 0.6) & (q < 0.4), (q > 0.6) & (p < 0.4)
    pnl_l = np.where(y == 1, 7.0, np.where(truths["mae_long"] >= 6, -6.0, truths["mfe_long"] - truths["mae_long"])) - evaluation.COST
    pnl_s = (truths["mfe_short"] - truths["mae_short"]).to_numpy() - evaluation.COST
    got = evaluation.evaluate("sim_absolute", table).first()
    assert (got["n_long"], got["n_short"]) == (long.sum(), short.sum())
    assert got["total_usd"] == pytest.approx((pnl_l[long].sum() + pnl_s[short].sum()) * evaluation.POINT, abs=1e-5)
    assert evaluation.evaluate("daily_equity_drawdown", table).first()["usd"] == pytest.approx(got["total_usd"], abs=1e-5)
    with pytest.raises(ValueError, match="lacks"):
        evaluation.evaluate("auc_rank", table.drop("y"))


def brute_route(bar: dict) -> tuple:
    """One bar's decision, step by step."""
    on = [n for n in router.PRIOR if bar[f"{n}_active"] >= 0.5 and bar[f"{n}_strength"] >= 0.5 and bar[f"{n}_direction"] != 0]
    worth = {n: router.PRIOR[n] * max(bar[f"vss_match_{n}"] * bar[f"tof_fit_{n}"], 1e-6) for n in on}
    best = {s: max([worth[n] for n in on if bar[f"{n}_direction"] == s], default=None) for s in (1, -1)}
    if None not in best.values() and abs(best[1] - best[-1]) < 0.05:
        return 0, None, 0, 0.0, 0.0, "setup_conflict_ambiguous"
    if on:
        way = max((s for s in best if best[s] is not None), key=lambda s: best[s])
        name = next(n for n in structure.PRIORITY if n in on and bar[f"{n}_direction"] == way and worth[n] == best[way])
        wr = router.PRIOR[name]
    else:
        way, name, wr = bar["l1_direction"], None, bar["no_setup_wr"]
        if way == 0:
            return 0, None, 0, 0.0, 0.0, "no_setup_no_conviction"
    wr += 0.02 if bar["htf_agreement"] > 0.3 else -0.03 if bar["htf_agreement"] < -0.3 else 0
    wr -= 0.02 * (bar["model_confidence"] < 0.5) + 0.03 * (bar["recent_similar_wr"] is not None and bar["recent_similar_wr"] < 0.5) + 0.02 * bar["cross_asset_divergence"]
    wr = min(1.0, max(0.0, min(wr, 0.4) if bar["drift_score"] > 0.7 else wr))
    mates = sum(bar[f"{n}_direction"] == way for n in on)
    if name and mates >= 2:
        wr = min(1.0, wr + 0.02 * min(mates - 1, 2))
    contrary = bar["l1_direction"] not in (0, way)
    if contrary and bar["l1_conviction"] >= 0.65:
        return 0, name, way, wr, 0.0, "l1_direction_veto"
    wr = max(0.0, wr - 0.03) if contrary else wr
    if wr < 0.512:
        return 0, name, way, wr, 0.0, "wr_below_breakeven"
    if bar["conformal_lower_bound"] < 0.502:
        return 0, name, way, wr, 0.0, "conformal_uncertain"
    return 1, name, way, wr, min(1.0, max(0.0, (wr - 0.51) / 0.19)) * bar["model_confidence"], None


def test_routing_equals_a_bar_by_bar_walk(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(600):
        bar = {"symbol": "s", "ts": T0 + dt.timedelta(minutes=k)}
        for n in router.PRIOR:
            bar |= {f"{n}_active": float(rng.random() < 0.25), f"{n}_strength": float(rng.random()), f"{n}_direction": float(rng.integers(-1, 2)), f"vss_match_{n}": float(rng.random() + 0.3), f"tof_fit_{n}": float(rng.choice([0.3, 1.0]))}
        bar |= {"htf_agreement": float(rng.uniform(-1, 1)), "model_confidence": float(rng.random()), "recent_similar_wr": None if k % 4 == 0 else float(rng.random()), "drift_score": float(rng.random()), "cross_asset_divergence": bool(rng.random() < 0.2)}
        bar |= {"conformal_lower_bound": float(rng.uniform(0.45, 0.6)), "l1_direction": int(rng.integers(-1, 2)), "l1_conviction": float(rng.random()), "no_setup_wr": float(rng.uniform(0.45, 0.65))}
        rows.append(bar)
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", dt.datetime: "timestamp_ntz", type(None): "double"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds[type(v)]}" for c, v in rows[0].items()))
    got = {r["ts"]: r for r in router.route(df).collect()}
    reasons = set()
    for bar in rows:
        trade, name, way, wr, size, why = brute_route(bar)
        r = got[bar["ts"]]
        assert (r["trade"], r["setup"], r["direction"], r["abstain_reason"]) == (trade, name, way, why)
        assert r["adjusted_wr"] == pytest.approx(wr, abs=1e-8) and r["sizing_factor"] == pytest.approx(size, abs=1e-8)
        reasons.add(why)
    assert len(reasons) >= 6
    bare = router.route(df.drop(*router.CONTEXT)).collect()
    assert len(bare) == 600 and {r["abstain_reason"] for r in bare if r["setup"] is None} <= {"no_setup_no_conviction", "setup_conflict_ambiguous"}


def test_calibration(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.random(3000), 3)
    y = (rng.random(3000) < p**2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}).rename(columns={"p": "prob"}))
    out = router.isotonic(df, df, "prob", "y").toPandas()
    order = np.argsort(p, kind="stable")
    assert (np.diff(out["prob"].to_numpy()[order]) >= -1e-12).all() and out["prob"].between(1e-4, 1 - 1e-4).all()
    assert abs(out["prob"].mean() - y.mean()) < 0.01 and ((out["prob"] - out["y"]) ** 2).mean() < ((p - y) ** 2).mean()
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 2.5))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"prob": 1 / (1 + np.exp(-z)), "y": y}))
    got = router.temperature(df, df, "prob", "y").toPandas()
    logit = lambda q: np.log(q / (1 - q))
    ratio = (logit(np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)) / logit(got["prob"].to_numpy()))[np.abs(z) > 0.5]
    loss = lambda t: (np.log1p(np.exp(-np.abs(z / t))) + np.maximum(z / t, 0) - y * z / t).sum()
    best = min(np.linspace(1.5, 4, 500), key=loss)
    assert ratio.std() < 1e-6 and ratio.mean() == pytest.approx(best, abs=0.02)


def test_calendar_fills_gaps(spark):
    rows = [("a", dt.date(2024, 1, 2), 5.0), ("a", dt.date(2024, 1, 4), -1.0), ("a", dt.date(2024, 3, 1), 2.0), ("b", dt.date(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "symbol string, day date, usd double")
    days = {(r["symbol"], r["day"]): r["usd"] for r in evaluation.calendar_sums(df).collect()}
    assert len(days) == 61 and days["a", dt.date(2024, 1, 3)] == 0 and days["a", dt.date(2024, 1, 4)] == -1
    months = {(r["symbol"], r["day"]): r["usd"] for r in evaluation.calendar_sums(df, "month").collect()}
    assert months == {("a", dt.date(2024, 1, 1)): 4.0, ("a", dt.date(2024, 2, 1)): 0.0, ("a", dt.date(2024, 3, 1)): 2.0, ("b", dt.date(2024, 1, 1)): 1.0}


def test_causal_ranges_know_only_the_past(spark):
    rng = np.random.default_rng(3)
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), *sorted(map(float, 100 + rng.normal(size=2))), 100.0) for k in range(100)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, low double, high double, close double")
    full, part = (labels.past_range(frame.where(f"ts < TIMESTAMP_NTZ '2024-01-01 {t}'"), causal=True).orderBy("ts").toPandas()["atr"].to_numpy() for t in ("01:40:00", "00:10:00"))
    assert np.allclose(full[:10], part) and full[0] == 1.0
    usual = labels.past_range(frame).orderBy("ts").toPandas()["atr"].to_numpy()
    assert np.allclose(full[20:], usual[20:]) and not np.allclose(full[1:10], usual[1:10])
