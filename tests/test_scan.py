"""Exponential averages over blocks against walking the rows."""

import datetime as dt
import random

import pandas as pd
import pytest

from barwright.operators import scan


@pytest.mark.parametrize("block,period", [(1, "day"), (7, "hour"), (256, "day"), (256, "month")])
def test_averages_for_any_block(spark, block, period):
    rng = random.Random(block)
    rows = []
    for s, n in (("a", 900), ("b", 60), ("c", 1), ("d", 5)):
        at = dt.datetime(2024, 1, 1, 20)
        for k in range(n):
            at += dt.timedelta(minutes=rng.choice([1, 1, 5, 300]))
            x = None if s == "d" or (k < 3 and s == "b") or rng.random() < 0.05 else rng.uniform(-5, 100)
            rows.append((s, at, x, None if x is None else -x, k))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double, n int").repartition(5)
    got = scan.ewm(df, {"e8": ("x", 8), "e200": ("x", 200), "f3": ("y", 3), "own": ("x", 1)}, period, block).toPandas()
    assert list(got.columns) == [*df.columns, "e8", "e200", "f3", "own"] and len(got) == len(rows)
    for _, g in got.sort_values("ts").groupby("symbol"):
        for name, column, span in (("e8", "x", 8), ("e200", "x", 200), ("f3", "y", 3), ("own", "x", 1)):
            want = g[column].ewm(span=span, adjust=False, ignore_na=True).mean()
            pd.testing.assert_series_equal(g[name], want, check_names=False, rtol=1e-10, atol=1e-10)


def test_no_averages_and_no_rows(spark):
    df = spark.createDataFrame([], "symbol string, ts timestamp_ntz, x double")
    assert scan.ewm(df, {}).columns == df.columns and scan.ewm(df, {"e": ("x", 5)}).count() == 0


def test_past_does_not_depend_on_the_future(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), float(k * 7919 % 101)) for k in range(1000)]
    schema = "symbol string, ts timestamp_ntz, x double"
    full, part = (scan.ewm(spark.createDataFrame(r, schema), {"e": ("x", 32)}, "hour", 16).orderBy("ts").toPandas() for r in (rows, rows[:777]))
    assert (full["e"][:777] == part["e"]).all()
