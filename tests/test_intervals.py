"""Interval joins, back adjustment, overlaps, subsamples, gates and lifts on small tables."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import sources
from barwright.operators import order, router

T0 = dt.datetime(2024, 1, 1)


def at(k):
    return T0 + dt.timedelta(minutes=k)


@pytest.mark.parametrize("width", [60, 3600, 86_400])
def test_interval_join(spark, width):
    rng = random.Random(width)
    points = [(rng.choice("ab"), at(rng.randrange(3000)), k) for k in range(300)]
    spans = [(s, at(lo), at(lo + rng.choice([-5, 0, 1, 60, 200, 1500])), k) for k, (s, lo) in enumerate((rng.choice("abc"), rng.randrange(3000)) for _ in range(60))] + [("a", None, at(5), -1), ("a", at(60), at(120), -2)]
    df = spark.createDataFrame(points, "symbol string, ts timestamp_ntz, p int")
    iv = spark.createDataFrame(spans, "symbol string, lo timestamp_ntz, hi timestamp_ntz, i int")
    got = sorted((r["p"], r["i"]) for r in sources.interval_join(df, iv, ["symbol"], width=width).collect())
    assert got == sorted((p, i) for s, t, p in points for z, lo, hi, i in spans if s == z and lo is not None and lo <= t < hi)


def test_back_adjust(spark):
    frame = spark.createDataFrame([(s, at(k), 10.0, 12.0, 9.0, 11.0, 5) for s in ("a", "b") for k in range(10)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    rolls = spark.createDataFrame([("a", at(3), -2.0), ("a", at(6), -1.0), ("a", at(6), 0.5), ("z", at(2), 9.0), ("a", at(-50), 100.0)], "instrument string, t_roll timestamp_ntz, gap_points double")
    got = sources.back_adjust(frame, rolls, 60)
    assert got.columns == frame.columns
    rows = {(r["symbol"], r["ts"]): r for r in got.collect()}
    assert len(rows) == 20
    for k in range(10):
        gap = (-2.0 if k <= 3 else 0) + (-0.5 if k <= 6 else 0)
        assert (rows["a", at(k)]["close"], rows["a", at(k)]["high"], rows["a", at(k)]["volume"]) == (11 - gap, 12 - gap, 5) and rows["b", at(k)]["close"] == 11
    assert sources.back_adjust(frame, rolls.limit(0)).exceptAll(frame).count() == 0


def test_overlap(spark):
    make = lambda lo, hi: spark.createDataFrame([("s", at(k), 1.0, 1.0, 1.0, float(k), 1) for k in range(lo, hi)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    got = sources.align(make(0, 50), {"x": make(10, 60), "y": make(5, 40)}, require_overlap=True)
    assert got.agg(F.min("ts"), F.max("ts")).first() == (at(10), at(39))
    assert got.where("x_close IS NULL OR y_close <> close").count() == 0
    assert sources.align(make(0, 50), {"x": make(0, 50).limit(0)}, require_overlap=True).count() == 0


def test_subsample_is_deterministic(spark):
    df = spark.range(20_000)
    one, two = (sources.subsample(d, 3000, ["id"]) for d in (df, df.repartition(13)))
    assert 2800 < one.count() < 3200 and one.exceptAll(two).count() == 0
    assert sources.subsample(df, 50_000, ["id"]).count() == 20_000


@pytest.mark.parametrize("rows,least", [(5, 1), (50, 10), (1000, 3)])
def test_rolling_rank_is_that_of_pandas(spark, rows, least):
    rng = random.Random(rows)
    data = [(s, at(k), None if rng.random() < 0.1 else rng.choice([rng.random(), 0.25, 7.0])) for s, n in (("a", 400), ("b", 30), ("c", 1)) for k in range(n)]
    got = order.rolling_rank(spark.createDataFrame(data, "symbol string, ts timestamp_ntz, x double"), "x", rows, least).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(data)
    for _, g in got.groupby("symbol"):
        want = g["x"].rolling(rows, min_periods=least).rank(pct=True)
        pd.testing.assert_series_equal(g["rank"], want, check_names=False)


def test_gates_by_the_road(spark):
    schema = "symbol string, ts timestamp_ntz, trade int, setup string, direction int, adjusted_wr double, sizing_factor double, abstain_reason string"
    decisions = spark.createDataFrame([("s", at(0), 1, "orb", 1, 0.6, 0.8, None), ("s", at(1), 1, None, -1, 0.6, 0.8, None), ("s", at(2), 1, "orb", 1, 0.6, 0.8, None), ("s", at(3), 0, None, 0, 0.0, 0.0, "no_setup_no_conviction"), ("s", at(4), 1, "sfs", -1, 0.6, 0.5, None)], schema)
    clear = spark.createDataFrame([("s", at(0), 3.0, 0.1, 0.5, 0.0), ("s", at(1), 9.0, 0.75, 9.0, 0.0), ("s", at(2), 0.3, 9.0, 0.0, 0.0), ("s", at(3), 1.0, 1.0, 0.0, 0.0)], "symbol string, ts timestamp_ntz, pc_clearance_above_atr double, pc_clearance_below_atr double, pc_obstacle_above_strength double, pc_obstacle_below_strength double")
    got = {r["ts"]: (r["gate"], r["side"], r["path_quality"], r["executed"], r["size"], r["reason"]) for r in router.gates(decisions, clear).collect()}
    assert got == {
        at(0): (1, 1, 0.7, "orb", pytest.approx(0.56), None),
        at(1): (1, -1, 0.5, None, pytest.approx(0.2), None),
        at(2): (0, 0, pytest.approx(0.2), None, 0.0, "path_walled_in"),
        at(3): (0, 0, 1.0, None, 0.0, "no_setup_no_conviction"),
        at(4): (1, -1, 1.0, "sfs", 0.5, None),
    }
    assert {r["path_quality"] for r in router.gates(decisions).collect()} == {1.0}


def test_lift_of_setups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        side = int(rng.integers(-1, 2))
        rows.append((1.0 if k % 2 else 0.0, float(side), int(side > 0 and k % 8 != 1), int(rng.random() < 0.3)))
    table = spark.createDataFrame(rows, "orb_active double, orb_direction double, long_tp int, short_tp int")
    got = {r["side"]: r for r in router.setup_lift(table, ["orb"]).collect()}
    own = [r for r in rows if r[0] >= 0.5 and r[1] > 0.5]
    assert got[1]["n"] == len(own) and got[1]["win_rate"] == pytest.approx(np.mean([r[2] for r in own]))
    assert got[1]["lift"] == pytest.approx(100 * (np.mean([r[2] for r in own]) - np.mean([r[2] for r in rows]))) and got[1]["verdict"] == "good"
    none = router.setup_lift(table.limit(0), ["orb"]).collect()
    assert [(r["n"], r["win_rate"], r["verdict"]) for r in none] == [(0, None, "few")] * 2
