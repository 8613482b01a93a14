"""Statistics of paths and distances to weighted distributions against plain loops."""

import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import anomaly, features, kernels, paths
from barwright.plans import catalogue

T0 = dt.datetime(2024, 1, 1)


def at(k):
    return T0 + dt.timedelta(minutes=k)


def brute(entry, samples, target, stop):
    """The statistics of one bar's paths, each a list of (high, low, close)."""
    rise = [max(max(h for h, _, _ in p) - entry, 0) for p in samples]
    fall = [max(entry - min(lo for _, lo, _ in p), 0) for p in samples]

    def first(p, side):
        for h, lo, _ in p:
            if (h - entry if side > 0 else entry - lo) >= target:
                return 1
            if (entry - lo if side > 0 else h - entry) >= stop:
                return 0
        return 0

    closes = [np.array([c for _, _, c in p]) for p in samples]

    def run(c):
        d = np.sign(np.diff(c))
        if not len(d):
            return 0
        best = cur = 1
        for a, b in zip(d, d[1:]):
            cur = cur + 1 if a == b and b != 0 else 1
            best = max(best, cur)
        return best

    ends = np.array([c[-1] for c in closes])
    away = ends - ends.mean()
    skew = 0.0 if len(ends) <= 2 else (np.mean(away**3) / np.mean(away**2) ** 1.5 if np.mean(away**2) else None)
    spread = (np.std(rise) + np.std(fall)) / 2
    return [np.mean(rise), np.mean(fall), np.mean(fall), np.mean(rise), np.mean([first(p, 1) for p in samples]), np.mean([first(p, -1) for p in samples]), spread, spread, np.mean([np.polyfit(np.arange(len(c)), c, 1)[0] for c in closes]), np.mean([np.diff(np.log(c + 1e-9)).std() for c in closes]), skew, np.mean([run(c) for c in closes])]


@pytest.mark.parametrize("samples", [1, 2, 7])
def test_statistics_of_paths(spark, samples):
    rng = random.Random(samples)
    rows, want = [], {}
    for b in range(6):
        entry, held = 100.0, []
        for s in range(samples):
            c, p = entry, []
            for step in range(20):
                c = max(1.0, c + rng.choice([-4, -1, 0, 0, 1, 4]))
                p.append((c + rng.randrange(4), c - rng.randrange(4), c))
                rows.append(("s", at(b), entry, s, step, *map(float, p[-1])))
            held.append(p)
        want[at(b)] = brute(entry, held, 8.0, 6.0)
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, entry double, sample int, step int, high double, low double, close double").repartition(5)
    got = {r["ts"]: [r[c] for c in paths.COLUMNS] for r in paths.path_statistics(df, 8.0, 6.0).collect()}
    for t, w in want.items():
        assert got[t] == [None if x is None else pytest.approx(x, abs=1e-9) for x in w]
    assert paths.path_statistics(df.limit(0)).count() == 0


def test_analogs_are_over_before_the_entry(spark):
    rng = np.random.default_rng(1)
    rows = [(s, at(k), *(100 + rng.normal(size=4)).tolist(), 1) for s in "ab" for k in range(130)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    found = paths.analog_paths(frame, lookback=50, horizon=10, samples=3, decimation=20)
    assert found.count() == 2 * 4 * 3 * 10 and {r[0] for r in found.select("ts").distinct().collect()} == {at(k) for k in (50, 70, 90, 110)}
    # later bars change nothing, and an entry's own prices only scale its paths
    other = frame.withColumn("close", F.when(F.col("ts") >= F.lit(at(90)), 5.0).otherwise(F.col("close")))
    again = paths.analog_paths(other, lookback=50, horizon=10, samples=3, decimation=20)
    assert found.where(F.col("ts") <= F.lit(at(90))).exceptAll(again.where(F.col("ts") <= F.lit(at(90)))).count() == 0
    cache = paths.path_cache(frame, found, 1.0, 1.0)
    assert cache.columns == ["symbol", "ts", *paths.COLUMNS] == ["symbol", "ts", *features.family_columns("kronos")]
    known = cache.where("kronos_pred_tp_long_prob IS NOT NULL")
    assert cache.count() == 260 and known.count() == 160 and known.agg(F.min("ts")).first()[0] == at(50)
    built = features.structural_features(frame, features.Spec.parse("kronos"), {"kronos": cache}, shift=False)
    assert built.na.drop("any").count() == 160
    with pytest.raises(ValueError):
        paths.analog_paths(frame, lookback=5, horizon=10)


def test_paths_from_a_zero_price_are_no_samples(spark, tmp_path):
    """Bars that open at zero have no ratio to scale by, and a flat entry has no skew: both as in SQL."""
    rng = np.random.default_rng(2)
    rows = []
    for s in "ab":
        for k in range(700):
            price = 0.0 if k % 3 == 1 or (s == "b" and k == 300) else float(rng.integers(1, 90))
            rows.append((len(rows), T0 + dt.timedelta(minutes=15 * k), s, price))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = paths.QUERIES["path_cache"](spark, str(tmp_path)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(paths.ORACLES["path_cache"]).df().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(got) == 1400 and want["kronos_pred_endpoint_skew"].isna().sum() > want["kronos_pred_max_run_length"].isna().sum()
    pd.testing.assert_frame_equal(got[paths.COLUMNS], want[paths.COLUMNS], check_dtype=False, rtol=1e-9, atol=2e-9)


@pytest.mark.parametrize("name", ["anomaly_short", "kern_mahalanobis"])
def test_distances_after_a_zero_price_equal_sql(spark, tmp_path, name):
    """A bar that closes at zero leaves the covariances close to singular, so that only the same steps give the same numbers; batches are smaller than a symbol."""
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 3400), ("b", 300)):
        for k in range(n):
            for e in range(1 + (k % 4 == 0)):
                rows.append((len(rows), T0 + dt.timedelta(seconds=60 * k + len(rows) % 50), s, 0.0 if e and k in (280, 2600) else round(float(rng.exponential(50)) + 0.01, 2)))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(anomaly.ORACLES[name]).df().sort_values(["symbol", "ts"])
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas().sort_values(["symbol", "ts"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert len(got) == 3700 and got["anomaly_mahalanobis"].max() > 1e6
    np.testing.assert_array_equal(got["anomaly_mahalanobis"].to_numpy(float), want["anomaly_mahalanobis"].to_numpy(float))


def test_rows_before_the_lockbox(spark):
    days = spark.createDataFrame([(dt.datetime(2024, m, 15),) for m in range(1, 13)], "ts timestamp_ntz")
    assert paths.before_lockbox(days, 6).agg(F.max("ts")).first()[0] == dt.datetime(2024, 5, 15)
    assert paths.before_lockbox(days, 6, dt.datetime(2024, 3, 1)).count() == 2
    with pytest.raises(ValueError):
        paths.before_lockbox(days, 6, dt.datetime(2024, 6, 15))
    assert paths.before_lockbox(days.limit(0)).count() == 0


@pytest.mark.parametrize("halflife", [8, 60])
def test_distances_equal_the_kernel(spark, halflife):
    rng = np.random.default_rng(halflife)
    rows = []
    for s, n in (("a", 700), ("b", 40), ("c", 1)):
        close = 100 + rng.normal(size=n).cumsum()
        for k, c in enumerate(close):
            rows.append((s, at(k), float(c + rng.normal()), float(c + 3), float(c - 3 * rng.random() - 1), float(c), int(rng.integers(0, 50))))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long").repartition(5)
    got = anomaly.distances(frame, halflife).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(rows)
    for s, g in got.groupby("symbol"):
        pdf = pd.DataFrame([r for r in rows if r[0] == s], columns=["symbol", "ts", "open", "high", "low", "close", "volume"])
        want = kernels.anomaly(pdf, halflife)["anomaly_mahalanobis"]
        assert np.allclose(g["anomaly_mahalanobis"].to_numpy(float), want, rtol=1e-6, atol=1e-8, equal_nan=True)
