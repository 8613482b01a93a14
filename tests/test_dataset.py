"""Windows, the second layer's input, tracker cells, barriers by setup, verdicts and prediction files on small cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import dataset

T0 = dt.datetime(2024, 3, 4, 12)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    rows = [(s, T0 + dt.timedelta(minutes=k), float(rng.normal(5, 2)), float(k)) for s in "ab" for k in range(30)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, f double, g double").cache()


def test_windows_and_their_normal_form(spark, matrix):
    truths = matrix.where("minute(ts) % 3 = 0").select("symbol", "ts", (F.col("f") > 5).cast("int").alias("long_tp"), (F.col("f") < 4).cast("int").alias("short_tp"))
    got = dataset.windows(matrix, truths, 8)
    rows = {(r["symbol"], r["ts"]): (r["f"], r["g"]) for r in matrix.collect()}
    seen = got.collect()
    assert len(seen) == 2 * sum(k % 3 == 0 and k >= 7 for k in range(30))
    for r in seen:
        want = [list(rows[r["symbol"], r["ts"] - dt.timedelta(minutes=7 - k)]) for k in range(8)]
        assert r["x"] == want and r["direction_class"] == (0 if want[-1][0] > 5 else 1 if want[-1][0] < 4 else 2)
    plain = {(r["symbol"], r["ts"]): np.array(r["x"]) for r in seen}
    for r in dataset.normalised(got, 2).collect():
        x = plain[r["symbol"], r["ts"]]
        np.testing.assert_allclose(np.array(r["x"]), (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5), atol=1e-9)
    for r in dataset.restored(dataset.normalised(got, 2)).collect():
        np.testing.assert_allclose(np.array(r["x"]), plain[r["symbol"], r["ts"]], atol=1e-9)
    with pytest.raises(ValueError, match="without a row"):
        dataset.windows(matrix, truths.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")), 8)
    assert dataset.windows(matrix, truths.limit(0), 8).count() == 0 and dataset.windows(matrix, truths, 99).count() == 0


def test_second_layer_fills_what_is_missing(spark, matrix):
    given = matrix.select("symbol", "ts", *[F.lit(0.25).alias(c) for c in dataset.FIRST], F.lit(0.75).alias("inflection_prob"))
    structural = matrix.where("minute(ts) < 10").select("symbol", "ts", "g")
    out = dataset.second_layer(given, structural, ["g", "absent"])
    rows = {(r["symbol"], r["ts"]): r for r in out.collect()}
    assert len(rows) == 60 and out.columns[-2:] == ["g", "absent"]
    late, early = rows["a", T0 + dt.timedelta(minutes=20)], rows["a", T0 + dt.timedelta(minutes=5)]
    assert (late["g"], early["g"], late["absent"]) == (0.0, 5.0, 0.0)
    assert (late["l1_inflection_prob"], late["l1_clears_level_prob"], late["l1_long_tp_prob"]) == (0.75, 0.5, 0.25) and late["time_hour_sin"] is not None


def test_tracker_equals_lists(spark):
    rng = np.random.default_rng(2)
    trades = [(str(rng.choice(["sfs", "orb", "odd"], p=[0.7, 0.28, 0.02])), int(rng.integers(0, 2)), T0 + dt.timedelta(minutes=k), float(rng.normal(0.1, 1))) for k in range(400)]
    priors = {"sfs": 0.62, "orb": 0.57}
    got = {(r["setup"], r["regime"]): r for r in dataset.tracker(spark.createDataFrame(trades, "setup string, regime int, ts timestamp_ntz, r_multiple double"), priors).collect()}
    cells = {}
    for s, g, t, r in trades:
        cells.setdefault((s, g), []).append((t, r))
    cells = {k: v[-100:] for k, v in cells.items()}
    for (s, g), own in cells.items():
        prior, recent = priors.get(s, 0.5), [r for _, r in own][-30:]
        wr = sum(r > 0 for r in recent) / len(recent) if len(own) >= 10 else prior
        pool = sorted(x for (n, _), v in cells.items() if n == s for x in v)
        r = got[s, g]
        assert r["n"] == len(own) and r["recent_wr"] == pytest.approx(wr, abs=1e-6) and r["recent_r"] == pytest.approx(np.mean(recent) if len(own) >= 10 else 0, abs=1e-6)
        assert r["drift"] == pytest.approx(min(1, max(0, prior - wr) / prior * 2), abs=1e-6)
        assert r["pooled_wr"] == pytest.approx(np.mean([x > 0 for _, x in pool[-60:]]) if len(pool) >= 10 else prior, abs=1e-6)
    assert len(got) == len(cells)


def test_barriers_and_grades_by_setup(spark):
    df = spark.createDataFrame([("sfs", 2.0, 9.0, 8.0, 0.8), (None, 2.0, 9.0, 8.0, 0.5), ("unknown", 2.0, 9.0, 8.0, 0.1), ("seod", 10.0, 9.0, 8.0, 0.0)], "setup string, atr double, tp_points double, sl_points double, s double")
    got = dataset.setup_barriers(df).select("*", dataset.sizing_grade(F.col("s")).alias("grade")).collect()
    assert [(r["effective_tp"], r["effective_sl"], r["hold_bars"], r["grade"]) for r in got] == [(3.0, 1.2, 45, 3), (9.0, 8.0, 60, 2), (9.0, 8.0, 60, 1), (4.0, 5.0, 20, 0)]
    assert dataset.setup_barriers(df.drop("tp_points", "sl_points")).collect()[1]["effective_tp"] == 30.0


def test_verdicts(spark):
    rows = [(-0.6, 0.07, 0.07, 0.3, 0.5), (-0.4, 0.04, 0.04, 0.3, 0.5), (0.0, 0.04, 0.0, 0.3, 0.5), (0.0, 0.0, 0.0, 0.3, 0.5), (0.6, 0.1, 0.1, 0.9, 0.9), (None, None, None, None, None), (None, 0.07, 0.07, 0.43, None)]
    got = dataset.verdict(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in dataset.TIERS))).collect()
    assert [r["verdict"] for r in got] == ["STRONG-PREDICTIVE", "PREDICTIVE", "WEAK", "PACING-LIKE", "PACING", "INCONCLUSIVE", "STRONG-PREDICTIVE"]


def test_predictions_by_fold(spark, tmp_path):
    df = pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=6, freq="1min"), "long_tp_prob": 0.5, "fold": [0, 0, 0, 1, 1, 1]})
    path = str(tmp_path / "p")
    dataset.write_predictions(spark.createDataFrame(df), path)
    dataset.write_predictions(spark.createDataFrame(df[df["fold"] == 1].assign(long_tp_prob=0.9)), path)
    assert dataset.read_predictions(spark, path).count() == 6
    assert [r[0] for r in dataset.read_predictions(spark, path, 1).select("long_tp_prob").distinct().collect()] == [0.9]
