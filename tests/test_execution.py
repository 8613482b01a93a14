"""The sequential rules, each on a few candidates."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators.execution import Rules, concurrency, execute, next_close

OPEN = Rules(releases=())


def run(spark, rows, rules=OPEN):
    pdf = pd.DataFrame([("x", pd.Timestamp(t), s, g, p, z) for t, s, g, p, z in rows], columns=["symbol", "ts", "side", "grade", "pnl", "z"])
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp, side int, grade int, pnl double, z double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return execute(df, rules)


def verdicts(spark, rows, rules=OPEN):
    return [r["verdict"] for r in run(spark, rows, rules).orderBy("ts").collect()]


def test_closes_follow_daylight_saving():
    ts = pd.Series(pd.to_datetime(["2024-03-08 20:59", "2024-03-08 21:00", "2024-03-11 20:00", "2024-03-11 20:01"]))
    assert next_close(ts, OPEN).astype(str).tolist() == ["2024-03-08 21:00:00", "2024-03-08 21:00:00", "2024-03-11 20:00:00", "2024-03-12 20:00:00"]


def test_entries_legs_and_sizes(spark):
    d = "2024-06-03 "
    rows = [(d + "08:00", 1, 4, 5.0, 0.0), (d + "08:03", 1, 4, 5.0, 0.0), (d + "08:05", 1, 4, 5.0, 0.0), (d + "08:06", 1, 3, 5.0, 0.0), (d + "08:12", -1, 4, 5.0, 0.0), (d + "08:20", 1, 4, 5.0, 0.0), (d + "08:30", 1, 4, 5.0, 0.0), (d + "09:30", -1, 1, 5.0, 0.0)]
    out = run(spark, rows).orderBy("ts").collect()
    assert [r["verdict"] for r in out] == ["entry", "passed_over", "leg", "passed_over", "passed_over", "leg", "passed_over", "entry"]
    assert [r["contracts"] for r in out] == [3, 0, 3, 0, 0, 3, 0, 1] and out[0]["usd"] == pytest.approx(30.0)
    assert concurrency(run(spark, rows)).first()["max_contracts"] == 9


def test_losses_pause_and_lock(spark):
    d = "2024-06-03 "
    two = [(d + "06:00", 1, 1, -1.0, 0.0), (d + "07:00", 1, 1, -1.0, 0.0), (d + "08:05", 1, 1, 1.0, 0.0), (d + "08:10", 1, 1, 1.0, 0.0)]
    assert verdicts(spark, two) == ["entry", "entry", "cooldown", "entry"]
    big = [(d + "06:00", 1, 3, -150.0, 0.0), (d + "07:30", 1, 1, 1.0, 0.0), ("2024-06-04 07:30", 1, 1, 1.0, 0.0)]
    assert verdicts(spark, big) == ["entry", "daily_loss", "entry"]


def test_closing_releases_and_volatility(spark):
    d = "2024-06-03 "
    assert verdicts(spark, [(d + "19:39", 1, 1, 1.0, 0.0), (d + "19:40", 1, 1, 1.0, 0.0), (d + "20:00", 1, 1, 1.0, 0.0)]) == ["entry", "eod", "entry"]
    assert verdicts(spark, [(d + "11:29", 1, 1, 1.0, 0.0), (d + "12:45", 1, 1, 1.0, 0.0), ("2024-06-08 12:45", 1, 1, 1.0, 0.0)], Rules()) == ["entry", "release", "entry"]
    assert verdicts(spark, [(d + "08:00", 1, 1, 1.0, 3.0), (d + "08:04", 1, 1, 1.0, None), (d + "08:05", 1, 1, 1.0, None)]) == ["volatility", "volatility", "entry"]


def test_no_candidates(spark):
    assert execute(spark.createDataFrame([], "symbol string, ts timestamp_ntz, side int, grade int, pnl double, z double")).count() == 0
