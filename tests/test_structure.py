"""Structure kernels and setups against plain loops on small cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import setups, structure
from barwright.plans import Plan


def bars(n: int, seed: int = 3, start: str = "2024-06-03 12:00", minutes: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    c = 1000 + np.cumsum(rng.normal(0, 1, n))
    o = np.concatenate([[1000.0], c[:-1]])
    hi, lo = np.maximum(o, c) + rng.exponential(0.7, n), np.minimum(o, c) - rng.exponential(0.7, n)
    return pd.DataFrame({"symbol": "x", "ts": pd.date_range(start, periods=n, freq=f"{minutes}min"), "open": o, "high": hi, "low": lo, "close": c, "volume": rng.integers(1, 50, n)})


def test_untouched_levels_equal_a_loop():
    pdf = bars(3000)
    frame = structure.coarse(pdf, 60)
    hi = frame["high"].to_numpy()
    up, _ = structure.untouched(pdf, 60)
    for i in range(0, len(pdf), 37):
        t, best = pdf["ts"][i], np.inf
        for p in range(3, len(hi) - 3):
            if hi[p] > max(*hi[p - 3 : p], *hi[p + 1 : p + 4]) and frame.index[p + 3] <= t:
                later = pdf[(pdf["ts"] >= frame.index[p + 3]) & (pdf["ts"] <= t)]
                if later["high"].max() < hi[p]:
                    best = min(best, hi[p] - pdf["close"][i])
        assert np.isnan(up[i]) if best == np.inf else up[i] == pytest.approx(best)


def test_defended_levels_equal_a_loop():
    pdf = bars(220)
    atr = structure.safe_range(pdf)
    hi, lo = pdf["high"].to_numpy(), pdf["low"].to_numpy()
    (_, level, touches, age), (_, floor, under, _) = structure.defended(pdf, atr, 60, 0.3, 0.5)
    for i in range(60, 220):
        top, low = hi[i - 60 : i].max(), lo[i - 60 : i].min()
        over = [j for j in range(i - 60, i) if top - hi[j] <= 0.3 * atr[i] and top - lo[j : min(j + 6, i)].min() >= 0.5 * atr[i]]
        below = [j for j in range(i - 60, i) if lo[j] - low <= 0.3 * atr[i] and hi[j : min(j + 6, i)].max() - low >= 0.5 * atr[i]]
        assert (level[i], touches[i], floor[i], under[i]) == (top, len(over), low, len(below))
        assert age[i] == (i - over[-1] if over else 61)


def test_peaks():
    at, prom = structure.peaks(np.array([0, 2, 1, 3, 3, 3, 0, 1, 0.5]), 0.0)
    assert at.tolist() == [1, 4, 7] and prom.tolist() == [1.0, 3.0, 0.5]
    assert structure.peaks(np.array([0, 2, 1, 3, 3, 3, 0, 1, 0.5]), 0.0, 4)[0].tolist() == [4]
    assert structure.peaks(np.array([0, 2, 1, 3, 3, 3, 0, 1, 0.5]), 1.0)[0].tolist() == [1, 4]


def test_density_is_a_density_of_the_stated_width():
    rng = np.random.default_rng(1)
    x, w = rng.normal(0, 2, 80), rng.random(80)
    grid = np.linspace(-30, 30, 4001)
    d = structure.density(x, w, grid, 0.8)
    assert np.trapezoid(d, grid) == pytest.approx(1.0, abs=1e-6)
    p = w / w.sum()
    s2 = (0.8 / x.std()) ** 2 * np.cov(x, aweights=p)
    mean = np.trapezoid(d * grid, grid)
    assert np.trapezoid(d * (grid - mean) ** 2, grid) == pytest.approx(s2 + p @ (x - p @ x) ** 2, rel=1e-4)
    assert structure.density(np.ones(5), np.ones(5), grid, 0.8) is None


@pytest.mark.parametrize("name", sorted(set(structure.KERNELS) - {"liquidity", "lasym", "tstruct", "levels"}))
def test_kernels_do_not_look_ahead(name):
    kernel, columns = structure.KERNELS[name]
    n, cut = (9000, 8111) if name == "mtf" else (1500, 1111)  # mtf is 0 for histories of fewer than 25 coarse bars
    pdf = bars(n)
    full, part = kernel(pdf), kernel(pdf.iloc[:cut])
    for c in columns:
        assert len(full[c]) == n
        assert np.allclose(np.asarray(full[c], float)[:cut], np.asarray(part[c], float), equal_nan=True), c


def test_later_confirmation_and_levels_do_not_look_ahead():
    pdf = bars(1500)
    for run in (lambda f: structure.swings(f, confirm=5), lambda f: structure.key_levels(f, 600)):
        full, part = run(pdf), run(pdf.iloc[:1111])
        for c in full:
            # before the first swing the age is the number of rows, as defined
            assert np.allclose(full[c][40:1111], part[c][40:], equal_nan=True), c
    assert np.isfinite(structure.key_levels(pdf, 600)["kl_dist_above_atr"][600:]).all()


@pytest.mark.parametrize("name", sorted(structure.KERNELS))
@pytest.mark.parametrize("n", [1, 2, 40])
def test_short_and_flat_histories(name, n):
    kernel, columns = structure.KERNELS[name]
    flat = bars(n)
    flat[["open", "high", "low", "close"]] = 5.0
    for pdf in (bars(n), flat):
        assert set(columns) <= set(kernel(pdf)) and all(len(kernel(pdf)[c]) == n for c in columns)


def test_anchors_follow_sessions(spark):
    pdf = bars(2 * 1440, start="2024-06-03 12:00")
    plan = Plan(setups.ANCHORS, {c: c for c in ("pdh", "pdl", "onh", "onl", "pdc", "ro")})
    out = plan.apply(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))).toPandas().sort_values("ts").reset_index(drop=True)
    day = pdf.set_index("ts")
    first, at = day["2024-06-03 13:30":"2024-06-03 19:59"], out.set_index("ts").loc["2024-06-04 13:31"]
    night = day["2024-06-03 20:00":"2024-06-04 13:29"]
    assert out.set_index("ts").loc["2024-06-04 13:30", "pdh"] is None or np.isnan(out.set_index("ts").loc["2024-06-04 13:30", "pdh"])
    want = {"pdh": first["high"].max(), "pdl": first["low"].min(), "onh": night["high"].max(), "onl": night["low"].min(), "pdc": night["close"].iloc[-1], "ro": day.loc["2024-06-04 13:30", "open"]}
    for c, v in want.items():
        assert at[c] == pytest.approx(v, abs=1e-6), c


def test_opening_range_breaks_once_a_session(spark):
    n = 150
    ts = pd.date_range("2024-06-03 13:20", periods=n, freq="1min")
    c = np.where(np.arange(n) < 60, 100 + np.arange(n) % 2, 104.0)
    pdf = pd.DataFrame({"symbol": "x", "ts": ts, "open": c, "high": c + 0.5, "low": c - 0.5, "close": c, "volume": 1})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = setups.SETUPS["orb"].apply(df).toPandas().sort_values("ts").reset_index(drop=True)
    broke = np.flatnonzero(out["orb_direction"] != 0)
    assert broke.min() == 60 and broke.max() == 10 + 90 and (out["orb_direction"][broke] == 1).all()
    assert out["orb_breakout_age"][75] == 15 and out["orb_breakout_age"][59] == 90


def test_confluence_and_context(spark):
    row = {"symbol": "x", "ts": pd.Timestamp("2024-06-03"), "mtf_alignment_score": 0.5, "mtf_trend_sign_60m": -0.25}
    for n in structure.PRIORITY:
        row |= {f"{n}_active": 0.0, f"{n}_direction": 0.0}
    row |= {"sfa_active": 1.0, "sfa_direction": -1.0, "orb_active": 1.0, "orb_direction": 1.0, "seod_active": 1.0, "seod_direction": 1.0, "spb_direction": 1.0}
    table = spark.createDataFrame(pd.DataFrame([row]))
    a, b = structure.confluence(table).first(), structure.htf_context(table).first()
    assert (a["scf_long_count"], a["scf_short_count"], a["scf_total_active"]) == (2, 1, 3) and a["scf_consensus_score"] == pytest.approx(1 / 3)
    assert (b["shtf_primary_agree"], b["shtf_primary_60m"], b["shtf_aligned_count"], b["shtf_opposed_count"]) == (-0.5, 0.25, 2, 1)
    assert b["spb_htf_agree"] == 0 and b["orb_htf_agree"] == 0.5
