"""Stores: versions of trades through replays, NPZ files through failures, bars and JSON."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import dataset
from barwright.sources import load_bars, stores
from barwright.sources.npz import NpzSource

T0 = dt.datetime(2024, 1, 1)


def trades(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["sfs", "orb"]), rng.randrange(3), T0 + dt.timedelta(minutes=k), rng.uniform(-1, 1)) for k in range(n)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path, rows = f"file://{tmp_path}/store", trades(900)
    put = stores.record_trades(path, kept=40)
    batch = lambda k: spark.createDataFrame(rows[300 * k : 300 * k + 300], stores.SCHEMA)
    assert stores.read_trades(spark, path).count() == 0
    put(batch(0), 0)
    put(batch(1), 1)
    once = stores.read_trades(spark, path)
    want = sorted(tuple(r) for r in once.collect())
    put(batch(1), 1)
    assert sorted(tuple(r) for r in stores.read_trades(spark, path).collect()) == want and len(want) == 240
    put(batch(2), 2)
    put(batch(2), 2)
    priors = {"sfs": 0.62, "orb": 0.57}
    got = {(r["setup"], r["regime"]): r for r in dataset.tracker(stores.read_trades(spark, path), priors).collect()}
    newest = {}
    for s, g, _, r in rows:
        newest.setdefault((s, g), []).append(r)
    assert set(got) == set(newest)
    for cell, r in newest.items():
        assert got[cell]["n"] == min(40, len(r)) and got[cell]["recent_wr"] == pytest.approx(np.mean([x > 0 for x in r[-30:]]), abs=1e-6)


def test_trades_of_a_stream(spark, tmp_path):
    rows, path = trades(400, 2), f"file://{tmp_path}/store"
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], stores.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(stores.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(stores.record_trades(path)).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()
    kept = stores.read_trades(spark, path)
    assert kept.exceptAll(spark.createDataFrame(rows, stores.SCHEMA)).count() == 0 and kept.count() == sum(min(100, n) for n in np.unique([f"{s}{g}" for s, g, *_ in rows], return_counts=True)[1])
    assert len([d for d in os.listdir(f"{tmp_path}/store") if d.startswith("version=")]) <= 3


def test_a_version_that_is_not_whole_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    stores.record_trades(path)(spark.createDataFrame(trades(10), stores.SCHEMA), 0)
    os.makedirs(f"{tmp_path}/store/version=1")
    assert stores.read_trades(spark, path).count() == 10


def test_npz_round_trip(spark, tmp_path):
    spark.dataSource.register(NpzSource)
    df = spark.range(0, 1000, 1, 4).select(F.col("id").alias("position"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") / 7).alias("p"), F.when(F.col("id") % 5 > 0, F.col("id").cast("float")).alias("q"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("e"), (F.col("id") > 4).alias("b"))
    df.repartition(3, "fold").write.format("npz").mode("append").save(f"{tmp_path}/out")
    back = spark.read.format("npz").schema(df.schema).load(f"{tmp_path}/out")
    clean = lambda d: d.withColumn("q", F.when(F.isnan("q") | F.col("q").isNull(), -1.0).otherwise(F.col("q")))
    assert back.count() == 1000 and clean(back).exceptAll(clean(df)).count() == 0
    assert not [n for n in os.listdir(f"{tmp_path}/out") if n.startswith("_staging")]
    few = spark.read.format("npz").schema("p double, other int").load(f"{tmp_path}/out")
    assert few.where("other IS NULL").count() == 1000
    df.where("position < 10").coalesce(1).write.format("npz").mode("overwrite").save(f"{tmp_path}/out")
    assert spark.read.format("npz").schema(df.schema).load(f"{tmp_path}/out").count() == 10
    assert spark.read.format("npz").schema("p double").load(f"{tmp_path}/none").count() == 0


def test_npz_of_other_writers(spark, tmp_path):
    spark.dataSource.register(NpzSource)
    for f in range(3):
        np.savez(f"{tmp_path}/fold{f}.npz", fold=f, val_preds_long_tp_prob=np.linspace(0, 1, 20_000, dtype=np.float32), fusion_embedding=np.ones((20_000, 4), np.float16), names=np.array(["x"]))
    got = spark.read.format("npz").schema("fold int, position long, val_preds_long_tp_prob float, fusion_embedding array<float>").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    assert got.groupBy("fold").agg(F.count("*").alias("n"), F.max("position").alias("p"), F.sum(F.aggregate("fusion_embedding", F.lit(0.0).cast("float"), lambda a, x: a + x)).alias("s")).orderBy("fold").collect() == [(f, 20_000, 19_999, 80_000.0) for f in range(3)]


def test_a_failed_npz_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(NpzSource)
    df = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id")).alias("id"))  # a null in the last task
    with pytest.raises(Exception):
        df.write.format("npz").mode("append").save(f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []
    with pytest.raises(Exception):
        spark.range(3).select(F.lit("x").alias("s")).write.format("npz").mode("append").save(f"{tmp_path}/out")


def test_stored_bars_and_json(spark, tmp_path):
    rows = [(s, T0 + dt.timedelta(minutes=k), float(v), 9.0, 1.0, 5.0, 3, v) for s in "abc" for k in range(50) for v in (2, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, seq int")
    stores.write_bars(df, f"{tmp_path}/bars")
    got = load_bars(spark, f"{tmp_path}/bars", ["a", "b"], "2024-01-01 00:10:00", "2024-01-01 00:19:00", ["seq"])
    assert got.count() == 20 and {r["open"] for r in got.collect()} == {1.0}
    assert load_bars(spark, f"{tmp_path}/bars").count() == 150
    stores.write_json(df.where("symbol = 'a'").withColumn("none", F.lit(None).cast("int")), f"{tmp_path}/json", ["ts"])
    lines = [json.loads(x) for f in os.listdir(f"{tmp_path}/json") if f.endswith(".json") for x in open(f"{tmp_path}/json/{f}")]
    assert len(lines) == 100 and all("none" in x for x in lines)
    stores.write_report(spark, {"a": np.float64(1.5), "b": [1, 2]}, f"{tmp_path}/report")
    assert json.loads("\n".join(r[0] for r in spark.read.text(f"{tmp_path}/report").collect())) == {"a": 1.5, "b": [1, 2]}
