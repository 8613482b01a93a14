"""Queries through streams and stores: bars in files by time, a stream over them, and what it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import dataset, families, setups
from barwright.plans import Plan
from barwright.sources import bars, bars_sql, load_bars, stores
from barwright.streaming import state

LATE = "1 hour"


def stream_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state kernels over all 15-minute bars, streamed in the order of their times; bars that the watermark has not passed are still held."""
    frame = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15).withColumn("ts", F.col("ts").cast("timestamp"))
    given, out = stores.scratch(spark, "bars"), stores.scratch(spark, "kernels")
    frame.repartitionByRange(4, "ts").write.parquet(given)
    with state.state_store(spark):
        stream = state.streaming_kernels(spark.readStream.schema(frame.schema).parquet(given), LATE)
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", stores.scratch(spark, "state")).trigger(availableNow=True).start(out).awaitTermination()
    done = spark.read.schema(state.OUTPUT).parquet(out)
    return done.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 9 if c == "vwap" else 6).alias(c) for c in (*state.SPANS, "vwap", *state.LEVELS)])


def stream_kernels_sql() -> str:
    ema = f"""b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars_sql(15)}) x),
e AS (SELECT symbol, ts, rn, CAST(close AS DOUBLE) AS ema8, CAST(close AS DOUBLE) AS ema32 FROM b WHERE rn = 1
 UNION ALL SELECT b.symbol, b.ts, b.rn, e.ema8 + 2e0 / 9 * (b.close - e.ema8), e.ema32 + 2e0 / 33 * (b.close - e.ema32) FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""
    prices = Plan(families.VWAP, {"vwap": "vwap"}, digits=9).sql()
    levels = Plan(setups.ANCHORS, {n: n for n in state.LEVELS}).sql()
    return f"""WITH RECURSIVE {ema}
SELECT symbol, ts, round(ema8, 6) AS ema8, round(ema32, 6) AS ema32, vwap, {", ".join(state.LEVELS)} FROM e JOIN ({prices}) p USING (symbol, ts) JOIN ({levels}) l USING (symbol, ts)
WHERE ts <= (SELECT max(ts) - INTERVAL '1 hour' FROM b)"""


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols' bars of a week from a store in which each bar stands twice, the second time with other prices."""
    frame = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15).withColumn("seq", F.lit(0))
    path = stores.scratch(spark, "store")
    stores.write_bars(frame.unionByName(frame.withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(1))), path)
    return load_bars(spark, path, ["click", "view"], "2024-01-08 00:00:00", "2024-01-14 23:45:00", ["seq"])


def tracked_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of trades that came in four batches, one of them twice: all bars of all symbols as trades."""
    all_ = trades(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15))
    path = stores.scratch(spark, "trades")
    put = stores.record_trades(path)
    for k in (0, 1, 2, 2, 3):
        lo, hi = 8 * k + 1, 8 * k + 9
        put(all_.where((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < hi)), k)
    return dataset.tracker(stores.read_trades(spark, path), dataset._PRIORS)


_TRADES = {"setup": "CASE rn % 9 WHEN 0 THEN 'sfs' WHEN 1 THEN 'orb' WHEN 2 THEN 'new' ELSE 'spb' END", "regime": "CASE WHEN rn % 997 = 3 THEN 7 ELSE rn % 3 END", "r_multiple": "(close - open) / 100.0"}


def trades(frame: DataFrame) -> DataFrame:
    rows = frame.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    return rows.selectExpr(f"concat(symbol, '_', {_TRADES['setup']}) AS setup", f"CAST({_TRADES['regime']} AS INT) AS regime", "ts", f"{_TRADES['r_multiple'].replace('100.0', '100e0')} AS r_multiple")


def tracked_stream_sql() -> str:
    given = f"SELECT symbol || '_' || {_TRADES['setup']} AS setup, CAST({_TRADES['regime']} AS INT) AS regime, ts, (close - open) / 100e0 AS r_multiple FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars_sql(15)}) b) r"
    return dataset.tracker_sql(given, dataset._PRIORS)


QUERIES = {"stream_state_kernels": stream_kernels, "stored_bars": stored_bars, "tracker_batches": tracked_stream}
ORACLES = {
    "stream_state_kernels": stream_kernels_sql(),
    "stored_bars": f"SELECT * FROM ({bars_sql(15)}) b WHERE symbol IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:45:00'",
    "tracker_batches": tracked_stream_sql(),
}
