"""Bars and their sources: events, stored bars of one or many symbols, caches and the roll log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Symbols in the part of other instruments.
CROSS = {"es": "view", "nq": "purchase", "zb": "signup"}
OHLCV = ["open", "high", "low", "close", "volume"]


def _bin(ts, minutes: int):
    return F.window(ts, f"{minutes} minutes").start.cast("timestamp_ntz")


def bars(events: DataFrame, minutes: int) -> DataFrame:
    """OHLCV bars of events: the type is the symbol, the value the price, the count the volume; empty bins never appear."""
    order = F.struct("ts", "event_id")
    rows = events.select("event_type", "ts", "event_id", "value")
    return rows.groupBy(F.col("event_type").alias("symbol"), _bin("ts", minutes).alias("bin")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    ).withColumnRenamed("bin", "ts")


def pooled(events: DataFrame) -> DataFrame:
    """All events as those of one instrument."""
    return events.withColumn("event_type", F.lit("all"))


def bars_sql(minutes: int, pool: bool = False) -> str:
    order = "(epoch_us(ts)::HUGEINT * 1000000000 + event_id)"
    return f"SELECT {"'all'" if pool else 'event_type'} AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(value, {order}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {order}) AS close, count(*) AS volume FROM events GROUP BY 1, 2"


def resample(frame: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars, labelled by their start. Bins that do not divide a day start on the first day of the data."""
    start = None
    if 1440 % minutes:
        first = frame.agg(F.date_trunc("day", F.min("ts"))).first()[0]
        if first is not None:
            start = f"{int((first - first.replace(year=1970, month=1, day=1)).total_seconds() // 60) % minutes} minutes"
    key = F.window("ts", f"{minutes} minutes", startTime=start) if start else F.window("ts", f"{minutes} minutes")
    return frame.groupBy("symbol", key.start.cast("timestamp_ntz").alias("bin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bin", "ts")


def keep_first(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def load_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, first_by: list[str] | None = None) -> DataFrame:
    """Stored bars of the symbols in the closed range; filters and columns reach the scan. Unknown symbols are an error.

    Of bars of one time the first by the stored columns ``first_by`` counts (by default by their own values, so that the choice never depends on files).
    """
    first_by = first_by or OHLCV
    frame = spark.read.parquet(path)
    frame = frame.select("symbol", "ts", *OHLCV, *[c for c in first_by if c not in OHLCV])
    if symbols is not None:
        have = {r[0] for r in frame.where(F.col("symbol").isin(symbols)).select("symbol").distinct().collect()}  # at most len(symbols) rows
        if missing := set(symbols) - have:
            raise ValueError(f"unknown symbols: {sorted(missing)}")
        frame = frame.where(F.col("symbol").isin(symbols))
    if start is not None:
        frame = frame.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        frame = frame.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return keep_first(frame, ["symbol", "ts"], first_by).select("symbol", "ts", *OHLCV)


def overlap(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames cut to the times that all of them span; frames without rows leave none."""
    ends = [f.agg(F.min("ts"), F.max("ts")).first() for f in frames]  # one row a frame
    if any(lo is None for lo, _ in ends):
        return [f.limit(0) for f in frames]
    lo, hi = max(e[0] for e in ends), min(e[1] for e in ends)
    return [f.where(F.col("ts").between(F.lit(lo), F.lit(hi))) for f in frames]


def align(primary: DataFrame, others: dict[str, DataFrame], limit: int = 5, require_overlap: bool = False) -> DataFrame:
    """Other symbols' bars on the primary's grid: prices carried on for at most ``limit`` rows, missing volume 0.

    With ``require_overlap`` only times that all symbols span are kept, before anything is carried on.
    """
    if require_overlap:
        primary, *cut = overlap([primary, *others.values()])
        others = dict(zip(others, cut))
    out = primary
    for name, other in others.items():
        out = out.join(other.select("ts", *[F.col(c).alias(f"{name}_{c}") for c in OHLCV]), "ts", "left")
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-limit, 0)
    cols = [F.coalesce(f"{n}_volume", F.lit(0)).alias(f"{n}_volume") if c == "volume" else F.last(f"{n}_{c}", ignorenulls=True).over(w).alias(f"{n}_{c}") for n in others for c in OHLCV]
    return out.select(*primary.columns, *cols)


def as_of(grid: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Each grid row with the latest values at or before its time, by symbol: a union and a carried value, no range join."""
    left = grid.select("symbol", "ts", F.lit(1).alias("__side"), *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in columns])
    right = values.select("symbol", "ts", F.lit(0).alias("__side"), *columns)
    w = Window.partitionBy("symbol").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).select("symbol", "ts", "__side", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return both.where("__side = 1").drop("__side")


def join_cache(frame: DataFrame, cache: DataFrame | None, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """Cached columns by ts; gaps get ``fill``; without a cache and with a null fill all are null."""
    if cache is None:
        if fill is not None:
            raise FileNotFoundError("no cache to read")
        return frame.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
    out = frame.join(cache.select("ts", *columns), "ts", "left")
    return out if fill is None else out.na.fill(fill, columns)


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str = "ts", lo: str = "lo", hi: str = "hi", width: int = 86_400) -> DataFrame:
    """Each row of ``points`` with every interval [lo, hi) of its ``by`` keys that holds its time, as an equi-join.

    Time is cut into bins of ``width`` seconds; an interval is repeated for each bin that it
    meets, a point has one bin, and the bounds are compared within a bin. Take a width near
    the usual length of an interval, so that each is repeated a few times only. Intervals
    that are null or empty hold nothing. Columns of both sides must differ but for ``by``.
    """
    bin_ = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1_000_000))
    some = intervals.where(F.col(lo) < F.col(hi))
    last = bin_(F.col(hi)) - (F.pmod(F.unix_micros(F.col(hi).cast("timestamp")), F.lit(width * 1_000_000)) == 0).cast("int")
    some = some.withColumn("__bin", F.explode(F.sequence(bin_(F.col(lo)), last)))
    out = points.withColumn("__bin", bin_(F.col(at))).join(some, [*by, "__bin"])
    return out.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__bin")


def back_adjust(frame: DataFrame, rolls: DataFrame, width: int = 90 * 86_400) -> DataFrame:
    """``frame`` with prices on the level of the last contract: from bars up to a roll (instrument, t_roll, gap_points) its gap, the old price less the new one, is taken off.

    A bar loses the gaps of all rolls at or after it. The sums hold between two rolls, so a bar meets one interval.
    Symbols without rolls stay as they are; rolls of the same time count together.
    """
    each = rolls.groupBy(F.col("instrument").alias("symbol"), F.col("t_roll").alias("end")).agg(F.sum("gap_points").alias("gap"))
    along = Window.partitionBy("symbol").orderBy("end")  # the rolls of one instrument: a few a year
    step = each.select("symbol", F.lag("end").over(along).alias("start"), "end", F.sum("gap").over(along.rowsBetween(0, Window.unboundedFollowing)).alias("__gap"))
    first = frame.groupBy("symbol").agg(F.min("ts").alias("__first"))
    tick = F.expr("INTERVAL 0.000001 SECOND")  # a bar at the time of a roll still belongs to the old contract
    spans = step.join(first, "symbol").select("symbol", F.coalesce(F.col("start") + tick, F.least("__first", "end")).alias("__lo"), (F.col("end") + tick).alias("__hi"), "__gap")
    found = interval_join(frame.select("symbol", "ts"), spans, ["symbol"], "ts", "__lo", "__hi", width).select("symbol", "ts", "__gap")
    out = frame.join(found, ["symbol", "ts"], "left")
    return out.select(*[(F.col(c) - F.coalesce("__gap", F.lit(0.0))).alias(c) if c in OHLCV[:4] else F.col(c) for c in frame.columns])


def subsample(frame: DataFrame, rows: int, keys: list[str], seed: int = 42) -> DataFrame:
    """About ``rows`` of the rows, the same for any partitioning: those whose keys hash lowest. Fewer rows are all kept."""
    n = frame.count()
    if n <= rows:
        return frame
    return frame.where(F.xxhash64(F.lit(seed), *keys) < F.lit(int(-(2**63) + 2**64 * rows / n)))


def read_roll_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "instrument string, t_roll string, from_contract string, to_contract string, gap_points double, gap_pct double, n_prior_bars_adjusted long"
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
