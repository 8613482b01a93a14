"""Queries of joins with intervals: sessions' bars, and prices on the level of the last contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.sources import CROSS, OHLCV, align, back_adjust, bars, bars_sql, interval_join


def _bars(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet"), minutes)


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of every regular session (13:30 to 20:00) by symbol: how many, highest, lowest."""
    frame = _bars(spark, sf_dir, 1)
    day = frame.groupBy("symbol").agg(F.min(F.date_trunc("day", "ts")).alias("a"), F.max(F.date_trunc("day", "ts")).alias("b"))
    day = day.select("symbol", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day")).withColumn("day", F.col("day").cast("timestamp_ntz"))
    sessions = day.select("symbol", "day", (F.col("day") + F.expr("INTERVAL 13 HOUR 30 MINUTE")).alias("lo"), (F.col("day") + F.expr("INTERVAL 20 HOUR")).alias("hi"))
    held = interval_join(frame, sessions, ["symbol"])
    return held.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high"), F.min("low").alias("low"))


def demo_rolls(frame: DataFrame) -> DataFrame:
    """A roll at the last bar of every week, its gap the close less the next open."""
    along = Window.partitionBy("symbol").orderBy("ts")
    after, next_ = F.lead("open").over(along), F.lead("ts").over(along)
    rolls = frame.select("symbol", "ts", (F.col("close") - after).alias("gap_points"), (F.date_trunc("week", "ts") < F.date_trunc("week", next_)).alias("last"))
    return rolls.where("last").select(F.col("symbol").alias("instrument"), F.col("ts").alias("t_roll"), "gap_points")


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _bars(spark, sf_dir)
    out = back_adjust(frame, demo_rolls(frame), 7 * 86_400)
    return out.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in OHLCV[:4]], "volume")


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary and others on the times that all span: the others start and end on days of their own here."""
    frame = _bars(spark, sf_dir)
    others = {n: frame.where(F.col("symbol") == s).where(f"ts >= TIMESTAMP_NTZ '2024-01-0{k + 2}' AND ts < TIMESTAMP_NTZ '2024-01-2{k + 1}'") for k, (n, s) in enumerate(CROSS.items())}
    out = align(frame.where("symbol = 'click'"), others, require_overlap=True)
    return out.select("symbol", "ts", "close", *[f"{n}_{c}" for n in CROSS for c in ("close", "volume")])


_B = f"SELECT *, lead(open) OVER w AS o2, lead(ts) OVER w AS t2 FROM ({bars_sql(15)}) b WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
_n = lambda k, n, s: f"{n} AS (SELECT * FROM b WHERE symbol = '{s}' AND ts >= TIMESTAMP '2024-01-0{k + 2}' AND ts < TIMESTAMP '2024-01-2{k + 1}')"
_span = "(SELECT greatest(" + ", ".join(f"(SELECT min(ts) FROM {n})" for n in ("p", *CROSS)) + ") AS lo, least(" + ", ".join(f"(SELECT max(ts) FROM {n})" for n in ("p", *CROSS)) + ") AS hi)"
_held = lambda n: f"last_value({n}.close IGNORE NULLS) OVER (ORDER BY p.ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {n}_close, coalesce({n}.volume, 0) AS {n}_volume"
QUERIES = {"interval_sessions": session_bars, "back_adjusted": adjusted, "align_overlap": overlapping}
ORACLES = {
    "interval_sessions": f"""WITH b AS ({bars_sql(1)}), d AS (SELECT symbol, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS day FROM b GROUP BY symbol)
SELECT d.symbol, CAST(d.day AS TIMESTAMP) AS day, count(*) AS n, max(high) AS high, min(low) AS low FROM d JOIN b ON b.symbol = d.symbol AND b.ts >= d.day + INTERVAL '13 hours 30 minutes' AND b.ts < d.day + INTERVAL '20 hours' GROUP BY 1, 2""",
    "back_adjusted": f"""WITH b AS ({_B}), r AS (SELECT symbol, ts AS t_roll, close - o2 AS gap FROM b WHERE date_trunc('week', ts) < date_trunc('week', t2)),
g AS (SELECT b.symbol, b.ts, coalesce(sum(gap), 0) AS gap FROM b LEFT JOIN r ON r.symbol = b.symbol AND r.t_roll >= b.ts GROUP BY ALL)
SELECT symbol, ts, {", ".join(f"round({c} - gap, 6) AS {c}" for c in OHLCV[:4])}, volume FROM b JOIN g USING (symbol, ts)""",
    "align_overlap": f"""WITH b AS ({bars_sql(15)}), p AS (SELECT * FROM b WHERE symbol = 'click'), {", ".join(_n(k, n, s) for k, (n, s) in enumerate(CROSS.items()))}
SELECT p.symbol, p.ts, p.close, {", ".join(_held(n) for n in CROSS)} FROM p JOIN {_span} z ON p.ts BETWEEN z.lo AND z.hi {" ".join(f"LEFT JOIN {n} ON {n}.ts = p.ts AND {n}.ts BETWEEN z.lo AND z.hi" for n in CROSS)}""",
}
