"""Streams with state against the batch plans, through a restart and through replayed batches."""

import pytest
from pyspark.sql import functions as F

from barwright.operators import families, kernels, setups
from barwright.plans import Plan
from barwright.sources import bars
from barwright.streaming import state


@pytest.fixture(scope="module")
def frame(spark, sf_dir):
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15).where("ts < TIMESTAMP_NTZ '2024-01-08'").persist()


def pieces(frame, path, cuts):
    """The bars in files by time, neighbours overlapping by half an hour's disorder."""
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = frame.withColumn("at", F.col("ts") + F.expr("make_dt_interval(0, 0, 30 * (pmod(xxhash64(ts, symbol), 2)), 0)"))
        part = part.where(f"at >= TIMESTAMP_NTZ '{lo}' AND at < TIMESTAMP_NTZ '{hi}'").drop("at")
        part.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        yield k


def test_state_equals_batch_through_a_restart(spark, frame, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    cuts = ["2024-01-01", "2024-01-03 14:00", "2024-01-05", "2024-01-08"]
    schema = frame.withColumn("ts", F.col("ts").cast("timestamp")).schema
    for _ in pieces(frame, path, cuts):  # a new query goes on where the last one stopped
        with state.state_store(spark):
            stream = state.streaming_kernels(spark.readStream.schema(schema).parquet(path))
            q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(out)
            q.awaitTermination()
    got = spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    last = frame.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    averages = kernels.ema_trend(frame)
    prices = Plan(families.VWAP, {"vwap": "vwap", "sigma": "sigma"}, raw=True).apply(frame)
    levels = Plan(setups.ANCHORS, {n: n for n in state.LEVELS}, raw=True).apply(frame)
    want = averages.join(prices, ["symbol", "ts"]).join(levels, ["symbol", "ts"]).where(F.col("ts") < F.lit(last)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    got = got.where(F.col("ts") < F.lit(last)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) > 1000 and (got[["symbol", "ts"]] == want[["symbol", "ts"]]).all().all()
    for c in ["ema8", "ema32", "vwap", *state.LEVELS]:
        assert (got[c].isna() == want[c].isna()).all(), c
        assert ((got[c] - want[c]).abs().fillna(0) < 2e-6).all(), c
    assert ((got["sigma"] - want["sigma"]).abs().fillna(0) < 1e-3).all()
