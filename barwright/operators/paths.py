"""Statistics of sampled price paths, and a cache of them by bar.

A forecaster gives paths (symbol, ts, entry, sample, step, high, low, close): at some
bars, a few continuations of some steps. Their statistics are two aggregations, of a
path's steps and of a bar's paths. ``analog_paths`` is a forecaster without a model: what
followed earlier bars of the same symbol, scaled to the present price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.sources import as_of, bars, bars_sql

# The columns of the cache; bars of history, steps, samples and bars between entries; points of target and stop.
COLUMNS = [
    "kronos_pred_mfe_long_mean", "kronos_pred_mae_long_mean", "kronos_pred_mfe_short_mean", "kronos_pred_mae_short_mean", "kronos_pred_tp_long_prob", "kronos_pred_tp_short_prob",
    "kronos_pred_mfe_uncertainty", "kronos_pred_mae_uncertainty", "kronos_pred_trajectory_slope", "kronos_pred_realized_vol", "kronos_pred_endpoint_skew", "kronos_pred_max_run_length",
]
LOOKBACK, HORIZON, SAMPLES, DECIMATION, POINTS = 240, 60, 10, 60, 30.0


def _longest_run(signs: Column) -> Column:
    """The longest run of equal signs other than 0; 1 where there is none, 0 without signs."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1).alias("run"), F.lit(1).alias("best"))

    def step(a: Column, s: Column) -> Column:
        run = F.when((s == a.last) & (s != 0), a.run + 1).otherwise(1)
        return F.struct(s.alias("last"), run.alias("run"), F.greatest(a.best, run).alias("best"))

    return F.when(F.size(signs) == 0, 0).otherwise(F.aggregate(signs, start, step, lambda a: a.best))


def path_statistics(paths: DataFrame, target: float = POINTS, stop: float = POINTS, ends: int = 3) -> DataFrame:
    """(symbol, ts, COLUMNS): excursions, first touches, slopes, deviations, skew of the ends and runs, over the paths of each bar.

    A step that reaches both the target and the stop counts for the target. Paths of one step have no deviation and no run.
    Steps without prices do not count: a path that has none with prices is no sample. Fewer than ``ends`` paths have a skew of 0.
    """
    paths = paths.na.drop("any", subset=["high", "low", "close"])
    up, down = F.col("high") - F.col("entry"), F.col("entry") - F.col("low")
    first = lambda c: F.min(F.when(c, F.col("step")))
    one = paths.groupBy("symbol", "ts", "sample").agg(
        F.greatest(F.max(up), F.lit(0.0)).alias("rise"), F.greatest(F.max(down), F.lit(0.0)).alias("fall"),
        first(up >= target).alias("ut"), first(down >= stop).alias("ds"), first(down >= target).alias("dt"), first(up >= stop).alias("us"),
        F.regr_slope("close", "step").alias("slope"), F.max_by("close", "step").alias("last"), F.sort_array(F.collect_list(F.struct("step", "close"))).alias("at"),
    )
    hit = lambda t, s: (F.col(t).isNotNull() & (F.col(s).isNull() | (F.col(t) <= F.col(s)))).cast("double")
    close, size = F.col("at.close"), F.size("at")
    pairs = F.when(size > 1, F.zip_with(F.slice(close, F.lit(2), size - 1), F.slice(close, F.lit(1), size - 1), lambda b, a: F.struct(b.alias("b"), a.alias("a")))).otherwise(F.array())
    one = one.withColumn("pairs", pairs)
    returns = F.transform("pairs", lambda p: F.log(p.b + 1e-9) - F.log(p.a + 1e-9))
    one = one.withColumns({"returns": returns, "run": _longest_run(F.transform("pairs", lambda p: F.signum(p.b - p.a)))})
    total = lambda f: F.aggregate("returns", F.lit(0.0), lambda s, v: s + f(v))
    one = one.withColumn("mean", F.try_divide(total(lambda v: v), F.size("returns")))
    one = one.withColumn("vol", F.sqrt(F.try_divide(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.size("returns"))))
    spread = (F.stddev_pop("rise") + F.stddev_pop("fall")) / 2
    values = [F.avg("rise"), F.avg("fall"), F.avg("fall"), F.avg("rise"), F.avg(hit("ut", "ds")), F.avg(hit("dt", "us")), spread, spread, F.avg("slope"), F.avg("vol"), F.when(F.count(F.lit(1)) >= ends, F.nanvl(F.skewness("last"), F.lit(None).cast("double"))).otherwise(0.0), F.avg("run")]
    return one.groupBy("symbol", "ts").agg(*[v.cast("double").alias(c) for c, v in zip(COLUMNS, values)])


def analog_paths(frame: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, samples: int = SAMPLES, decimation: int = DECIMATION) -> DataFrame:
    """Paths at every ``decimation``-th bar after ``lookback``: the ``horizon`` bars from an earlier one on, all of them over before the entry, times the ratio of both opens.

    Which earlier bars is plain arithmetic on row numbers, so it repeats. The paths are joined by symbol and row number.
    An earlier bar that opens at zero has no ratio: its path has no prices.
    """
    if lookback < horizon:
        raise ValueError("the history must hold a whole path")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("long")
    numbered = frame.select("symbol", n.alias("rn"), "ts", "open", "high", "low", "close")
    entries = numbered.where((F.col("rn") > lookback) & ((F.col("rn") - lookback - 1) % decimation == 0)).select("symbol", "ts", "rn", F.col("open").alias("entry"))
    each = entries.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    each = each.withColumn("start", 1 + (F.col("rn") * 7919 + F.col("sample") * 104729) % (F.col("rn") - horizon))
    base = numbered.select("symbol", F.col("rn").alias("start"), F.col("open").alias("base"))
    each = each.join(base, ["symbol", "start"]).select("symbol", "ts", "entry", "sample", "start", (F.col("entry") / F.nullif(F.col("base"), F.lit(0.0))).alias("scale"))
    steps = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step")).withColumn("rn", F.col("start") + F.col("step"))
    later = numbered.select("symbol", "rn", "high", "low", "close")
    return steps.join(later, ["symbol", "rn"]).select("symbol", "ts", "entry", "sample", "step", *[(F.col(c) * F.col("scale")).alias(c) for c in ("high", "low", "close")])


def path_cache(frame: DataFrame, paths: DataFrame | None = None, target: float = POINTS, stop: float = POINTS, ends: int = 3) -> DataFrame:
    """(symbol, ts, COLUMNS) at every bar: the statistics of the last bar that has paths, all of them, nulls too; null before any. A cache for the family ``kronos``."""
    found = path_statistics(analog_paths(frame) if paths is None else paths, target, stop, ends)
    held = as_of(frame.select("symbol", "ts"), found.select("symbol", "ts", F.struct(*COLUMNS).alias("found")), ["found"])
    return held.select("symbol", "ts", *[F.col(f"found.{c}") for c in COLUMNS])


def before_lockbox(frame: DataFrame, months: int = 6, end=None, embargo_days: int = 1) -> DataFrame:
    """The rows that may teach an encoder: those before the out-of-sample months, less an embargo. An ``end`` beyond that is an error."""
    last = frame.agg(F.expr(f"CAST(add_months(CAST(max(ts) AS DATE), -{months}) AS TIMESTAMP_NTZ) - INTERVAL {embargo_days} DAY")).first()[0]
    if last is None:
        return frame
    if end is not None and end > last:
        raise ValueError(f"rows up to {end} would reach into the out-of-sample months; the last allowed is {last}")
    return frame.where(F.col("ts") < F.lit(last if end is None else end))


_DEMO = {"lookback": 240, "horizon": 60, "samples": 5, "decimation": 60}


def cached_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of the demo's bars."""
    frame = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15)
    out = path_cache(frame, analog_paths(frame, **_DEMO), ends=1)
    return out.select("symbol", "ts", *[F.round(c, 9).alias(c) for c in COLUMNS])


def statistics_sql() -> str:
    d = _DEMO
    values = [
        "avg(rise)", "avg(fall)", "avg(fall)", "avg(rise)", "avg(CAST(ut IS NOT NULL AND (ds IS NULL OR ut <= ds) AS INT))", "avg(CAST(dt IS NOT NULL AND (us IS NULL OR dt <= us) AS INT))",
        "(stddev_pop(rise) + stddev_pop(fall)) / 2", "(stddev_pop(rise) + stddev_pop(fall)) / 2", "avg(slope)", "avg(vol)", "avg((last - m) ** 3) / NULLIF(avg((last - m) ** 2) ** 1.5, 0)", "avg(run)",
    ]
    first = lambda c: f"min(CASE WHEN {c} THEN step END)"
    return f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars_sql(15)}) b),
e AS (SELECT symbol, ts, rn, open AS entry, unnest(range(0, {d["samples"]})) AS sample FROM b WHERE rn > {d["lookback"]} AND (rn - {d["lookback"] + 1}) % {d["decimation"]} = 0),
s AS (SELECT e.symbol, e.ts, e.entry, e.sample, x.rn AS start, e.entry / NULLIF(x.open, 0) AS scale FROM e JOIN b x ON x.symbol = e.symbol AND x.rn = 1 + (e.rn * 7919 + e.sample * 104729) % (e.rn - {d["horizon"]})),
p AS (SELECT s.symbol, s.ts, s.entry, s.sample, y.rn - s.start AS step, y.high * scale AS high, y.low * scale AS low, y.close * scale AS close FROM s JOIN b y ON y.symbol = s.symbol AND y.rn BETWEEN s.start AND s.start + {d["horizon"] - 1}),
q AS (SELECT *, sign(close - lag(close) OVER w) AS d, ln(close + 1e-9) - ln(lag(close) OVER w + 1e-9) AS r FROM p WINDOW w AS (PARTITION BY symbol, ts, sample ORDER BY step)),
c AS (SELECT *, CASE WHEN d <> 0 AND d = lag(d) OVER w THEN 0 ELSE 1 END AS cut FROM q WINDOW w AS (PARTITION BY symbol, ts, sample ORDER BY step)),
i AS (SELECT symbol, ts, sample, isle, count(*) AS n FROM (SELECT *, sum(cut) OVER (PARTITION BY symbol, ts, sample ORDER BY step) AS isle FROM c) z WHERE d IS NOT NULL GROUP BY ALL),
r AS (SELECT symbol, ts, sample, max(n) AS run FROM i GROUP BY ALL),
o AS (SELECT symbol, ts, sample, greatest(max(high - entry), 0) AS rise, greatest(max(entry - low), 0) AS fall, {first(f"high - entry >= {POINTS}")} AS ut, {first(f"entry - low >= {POINTS}")} AS ds, {first(f"entry - low >= {POINTS}")} AS dt, {first(f"high - entry >= {POINTS}")} AS us,
 regr_slope(close, step) AS slope, arg_max(close, step) AS last, stddev_pop(r) AS vol FROM q GROUP BY ALL),
m AS (SELECT o.*, r.run, avg(last) OVER (PARTITION BY o.symbol, o.ts) AS m FROM o JOIN r USING (symbol, ts, sample)),
a AS (SELECT symbol, ts, {", ".join(f"{v} AS {c}" for c, v in zip(COLUMNS, values))} FROM m GROUP BY symbol, ts)
SELECT b.symbol, b.ts, {", ".join(f"round(a.{c}, 9) AS {c}" for c in COLUMNS)} FROM b ASOF LEFT JOIN a ON a.symbol = b.symbol AND b.ts >= a.ts"""


QUERIES = {"path_cache": cached_statistics}
ORACLES = {"path_cache": statistics_sql()}
