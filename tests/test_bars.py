"""Sources, kernels and streams on small cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import sources
from barwright.operators import families, kernels, labels
from barwright.plans import spark_text
from barwright.streaming import streaming_bars

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in ("a", "b"):
        c = 100 * np.exp(np.cumsum(0.001 * rng.standard_normal(700)))
        for k in range(700):
            rows.append((s, T0 + dt.timedelta(minutes=15 * k), float(c[k] * 1.0001), float(c[k] * 1.002), float(c[k] * 0.998), float(c[k]), int(rng.integers(1, 9))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long").cache()


@pytest.mark.parametrize("name", sorted(k for k, p in families.FAMILIES.items() if not p.cross))
def test_truncation_and_isolation(walk, name):
    """Later bars and other symbols change nothing before or beside them."""
    plan, cut = families.FAMILIES[name], T0 + dt.timedelta(minutes=15 * 500)
    full = plan.apply(walk).where((F.col("symbol") == "a") & (F.col("ts") < F.lit(cut))).orderBy("ts").toPandas()
    part = plan.apply(walk.where((F.col("symbol") == "a") & (F.col("ts") < F.lit(cut)))).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(full, part, rtol=1e-9, atol=1e-9)


def test_bars_of_empty_input(walk):
    for plan in families.FAMILIES.values():
        if not plan.cross:
            assert plan.apply(walk.limit(0)).count() == 0


def test_align_carries_at_most_five_rows(spark):
    bar = lambda s, k: (s, T0 + dt.timedelta(minutes=k), 1.0, 1.0, 1.0, float(k), 1)
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    got = sources.align(spark.createDataFrame([bar("p", k) for k in range(10)], schema), {"x": spark.createDataFrame([bar("x", 0)], schema)}).orderBy("ts").collect()
    assert [r["x_close"] for r in got] == [0.0] * 6 + [None] * 4 and [r["x_volume"] for r in got] == [1] + [0] * 9


def test_barrier_tie_is_a_loss(spark):
    rows = [("s", T0 + dt.timedelta(minutes=k), 100.0, h, lo, 100.0, 1) for k, (h, lo) in enumerate([(101, 99), (140, 60), (100, 100), (100, 100)])]
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    frame = spark.createDataFrame([(*r[:3], float(r[3]), float(r[4]), *r[5:]) for r in rows], schema)
    first = labels.triple_barrier(frame, 2, "30e0").orderBy("ts").first()
    assert (first["long_tp"], first["short_tp"], first["time_to_long_tp"], first["mfe_long"]) == (0, 0, 1, 40.0)


def test_weekly_bins_start_on_the_first_day(walk):
    got = sources.resample(walk, 10_080).where("symbol = 'a'").orderBy("ts").collect()
    assert got[0]["ts"] == T0 and sum(r["volume"] for r in got) == walk.where("symbol = 'a'").agg(F.sum("volume")).first()[0]


def test_roll_log(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# note\ninstrument,t_roll,from_contract,to_contract,gap_points,gap_pct,n_prior_bars_adjusted\nx,2024-01-01,a,b,1.5,0.1,7\n")
    assert sources.read_roll_log(spark, str(tmp_path / "r.csv")).collect()[0]["gap_points"] == 1.5


def test_change_points_notice_a_jump():
    rng = np.random.default_rng(0)
    age, prob, entropy = kernels.change_points(np.concatenate([rng.normal(0, 0.1, 200), rng.normal(4, 0.1, 100)]))
    assert age[195] > 100 and age[210] < 30 and ((0 <= prob) & (prob <= 1)).all() and ((0 <= entropy) & (entropy <= 1)).all()


def test_rank_share_equals_pandas():
    x = np.random.default_rng(3).integers(0, 20, 300).astype(float)
    want = pd.Series(x).rolling(50, min_periods=10).rank(pct=True)
    assert np.allclose(kernels.rank_share(x, 50, 10), want, equal_nan=True)


def test_hurst_of_noise_and_short_series():
    assert kernels.hurst(np.arange(100.0)) == 0.5
    assert abs(kernels.hurst(np.random.default_rng(1).standard_normal(4096)) - 0.5) < 0.12


def test_kernels_are_causal(walk):
    for kernel, columns in kernels.KERNELS.values():
        pdf = walk.where("symbol = 'a'").toPandas()
        full, part = kernel(pdf), kernel(pdf.iloc[:500])
        for c in columns:
            assert np.allclose(full[c][:500], part[c], equal_nan=True)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 60)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    want = sources.bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 60)
    assert spark.table("bars_out").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume").exceptAll(want.select("symbol", "ts", "open", "high", "low", "close", "volume")).count() == 0


def test_number_literals_are_doubles():
    assert spark_text("a * 0.5 + 1e-9 + x1.5y") == "a * 0.5e0 + 1e-9 + x1.5y"
