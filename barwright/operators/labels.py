"""Triple-barrier labels, as-of joins, keep-first and walk-forward splits, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import TRUE_RANGE
from barwright.sources import as_of, bars, bars_sql, keep_first, resample

# Barriers in mean ranges and the bars of their mean; least range; points of a fixed barrier.
SCALE, RANGE_BARS, LEAST_RANGE, POINTS = 1.5, 60, 0.5, 30.0
# Bars and points of the move that an inflection turns; bounds of returns; shares of a range that tell path shapes apart.
TURN_BARS, TURN_POINTS, RETURN_BOUND = 10, 2.0, 10.0
MOVED, AGAINST, WIDE, BACK, CALM = 0.5, 0.7, 0.7, 0.3, 1.0


def past_range(frame: DataFrame, bars_: int = RANGE_BARS, least: float = LEAST_RANGE, causal: bool = False) -> DataFrame:
    """``frame`` with ``atr``: the mean true range of the bars before each one; a symbol's median (1 without any) where a quarter of them is missing.

    That median is of the whole history, so it looks ahead. With ``causal`` such rows take the mean range of what bars there were before them (1 without any).
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    before = w.rowsBetween(-bars_, -1)
    rows = frame.withColumn("__tr", F.expr(TRUE_RANGE))
    rows = rows.withColumn("__atr", F.when(F.count("__tr").over(before) >= max(2, bars_ // 4), F.avg("__tr").over(before)))
    if causal:
        so_far = F.avg("__tr").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("atr", F.greatest(F.coalesce("__atr", so_far, F.lit(1.0)), F.lit(least))).drop("__tr", "__atr")
    usual = F.broadcast(rows.groupBy("symbol").agg(F.median("__atr").alias("__usual")))  # one row per symbol
    usual = usual.withColumn("__usual", F.when(F.col("__usual") > 0, F.col("__usual")).otherwise(1.0))
    return rows.join(usual, "symbol").withColumn("atr", F.greatest(F.coalesce("__atr", "__usual"), F.lit(least))).drop("__tr", "__atr", "__usual")


def barrier_labels(frame: DataFrame, horizon: int = 60, points: float | None = None, minutes: int = 1) -> DataFrame:
    """All labels of an entry at each bar's open, held for at most ``horizon`` bars; the last ``horizon`` bars of a symbol get none.

    Barriers lie ``points`` away, or SCALE times the mean range of the bars before
    the entry. A bar that hits both counts as a loss for both sides. Excursions
    count up to the bar that decided. ``valid`` tells whether the bars ahead follow
    each other by ``minutes`` without a break. Future bars are bounded arrays.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = lambda c: F.collect_list(c).over(w.rowsBetween(0, horizon - 1))
    after = lambda k: F.lead("close", k).over(w)
    rows = past_range(frame).select(
        "symbol", "ts", F.col("open").alias("entry_price"), "close", "atr", ahead("high").alias("hi"), ahead("low").alias("lo"),
        (F.lit(float(points)) if points else F.col("atr") * SCALE).alias("pts"), after(min(15, horizon)).alias("c15"), after(horizon).alias("c60"),
        F.coalesce(F.col("open") - F.lag("open", TURN_BARS).over(w), F.lit(0.0)).alias("turn"), F.lead("ts", horizon - 1).over(w).alias("last"),
    ).where("c60 IS NOT NULL")
    o, atr = F.col("entry_price"), F.col("atr")
    first = lambda arr, cond, none: F.coalesce(F.nullif(F.array_position(F.transform(arr, cond), F.lit(True)), F.lit(0)).cast("int") - 1, F.lit(none))
    rows = rows.withColumns({
        "u": first("hi", lambda x: x >= o + F.col("pts"), horizon), "d": first("lo", lambda x: x <= o - F.col("pts"), horizon),
        "cu": first("hi", lambda x: x >= o + SCALE * atr, horizon + 1), "cd": first("lo", lambda x: x <= o - SCALE * atr, horizon + 1),
        "r15": F.least(F.greatest((F.col("c15") - F.col("close")) / atr, F.lit(-RETURN_BOUND)), F.lit(RETURN_BOUND)), "r60": F.least(F.greatest((F.col("c60") - F.col("close")) / atr, F.lit(-RETURN_BOUND)), F.lit(RETURN_BOUND)),
        "up": (F.array_max("hi") - o) / atr, "down": (o - F.array_min("lo")) / atr,
    })
    stop = F.least("u", "d", F.lit(horizon - 1)) + 1
    above, below = F.array_max(F.slice("hi", F.lit(1), stop)) - o, o - F.array_min(F.slice("lo", F.lit(1), stop))
    rows = rows.withColumns({"above": F.greatest(above, F.lit(0.0)), "below": F.greatest(below, F.lit(0.0)), "lw": (F.col("u") < F.col("d")).cast("int"), "sw": (F.col("d") < F.col("u")).cast("int")})
    against = F.when(F.col("r60") > 0, F.col("down")).when(F.col("r60") < 0, F.col("up")).otherwise(F.greatest("up", "down"))
    size, span = F.abs("r60"), F.col("up") + F.col("down")
    # 0 goes on, 1 comes back, 2 stays calm
    shape = F.when((span >= WIDE) & (size < BACK), 1).when((size >= MOVED) & (against < AGAINST), 0).when(span < CALM, 2).when(size >= BACK, 0).otherwise(2)
    turned = ((F.col("turn") > TURN_POINTS) & (F.col("sw") == 1)) | ((F.col("turn") < -TURN_POINTS) & (F.col("lw") == 1))
    r = lambda c: F.round(c, 6)
    return rows.select(
        "symbol", "ts", "entry_price", F.round("pts", 9).alias("tp_points"), F.round("pts", 9).alias("sl_points"), F.col("lw").alias("long_tp"), F.col("sw").alias("short_tp"), F.col("u").alias("time_to_long_tp"), F.col("d").alias("time_to_short_tp"),
        r("above").alias("mfe_long"), r("below").alias("mae_long"), r("below").alias("mfe_short"), r("above").alias("mae_short"), r("r15").alias("return_h15"), r("r60").alias("return_h60"), shape.alias("path_shape_class"),
        (F.col("cu") < F.col("cd")).cast("int").alias("clears_up_first"), turned.cast("int").alias("inflection_label"), (F.col("last") == F.col("ts") + F.expr(f"INTERVAL {(horizon - 1) * minutes} MINUTES")).alias("valid"),
    )


def at_index(labels_: DataFrame, index: DataFrame) -> DataFrame:
    """The labels whose (symbol, ts) is in ``index``, as the rows that a feature matrix kept."""
    return labels_.join(index.select("symbol", "ts"), ["symbol", "ts"], "left_semi")


def labels_sql(horizon: int, points: float | None, minutes: int, columns: str = "*") -> str:
    """``barrier_labels`` in SQL, by a range join of each entry with the bars ahead."""
    return f"""
WITH b AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n, greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) AS tr FROM ({bars_sql(minutes)}) x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
a AS (SELECT *, CASE WHEN count(tr) OVER p >= {max(2, RANGE_BARS // 4)} THEN avg(tr) OVER p END AS mean_tr FROM b WINDOW p AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {RANGE_BARS} PRECEDING AND 1 PRECEDING)),
m AS (SELECT symbol, CASE WHEN median(mean_tr) > 0 THEN median(mean_tr) ELSE 1.0 END AS usual FROM a GROUP BY symbol),
e AS (SELECT a.symbol, a.ts, a.rn, a.open, a.close, greatest(coalesce(a.mean_tr, m.usual), {LEAST_RANGE}) AS atr, t.open AS was, q.close AS c15, z.close AS c60, l.ts AS last_ts
 FROM a JOIN m USING (symbol) JOIN b z ON z.symbol = a.symbol AND z.rn = a.rn + {horizon} JOIN b q ON q.symbol = a.symbol AND q.rn = a.rn + {min(15, horizon)} JOIN b l ON l.symbol = a.symbol AND l.rn = a.rn + {horizon - 1} LEFT JOIN b t ON t.symbol = a.symbol AND t.rn = a.rn - {TURN_BARS}),
p AS (SELECT *, CAST({f"{points}" if points else f"{SCALE} * atr"} AS DOUBLE) AS pts FROM e),
j AS (SELECT p.symbol, p.rn, p.open, f.rn - p.rn AS k, f.high, f.low FROM p JOIN b f ON f.symbol = p.symbol AND f.rn BETWEEN p.rn AND p.rn + {horizon - 1}),
h AS (SELECT p.symbol, p.rn, min(k) FILTER (j.high >= p.open + pts) AS u, min(k) FILTER (j.low <= p.open - pts) AS d, min(k) FILTER (j.high >= p.open + {SCALE} * atr) AS cu, min(k) FILTER (j.low <= p.open - {SCALE} * atr) AS cd, max(j.high) AS top, min(j.low) AS bottom
 FROM p JOIN j ON j.symbol = p.symbol AND j.rn = p.rn GROUP BY p.symbol, p.rn),
x AS (SELECT h.symbol, h.rn, greatest(max(j.high) - any_value(j.open), 0) AS above, greatest(any_value(j.open) - min(j.low), 0) AS below FROM h JOIN j ON j.symbol = h.symbol AND j.rn = h.rn AND j.k <= least(coalesce(u, {horizon}), coalesce(d, {horizon}), {horizon - 1}) GROUP BY h.symbol, h.rn),
v AS (SELECT p.*, coalesce(u, {horizon}) AS u, coalesce(d, {horizon}) AS d, coalesce(cu, {horizon + 1}) AS cu, coalesce(cd, {horizon + 1}) AS cd, above, below, (top - p.open) / atr AS up, (p.open - bottom) / atr AS down,
 greatest(least((c15 - close) / atr, {RETURN_BOUND}), -{RETURN_BOUND}) AS r15, greatest(least((c60 - close) / atr, {RETURN_BOUND}), -{RETURN_BOUND}) AS r60, coalesce(p.open - was, 0) AS turn FROM p JOIN h USING (symbol, rn) JOIN x USING (symbol, rn)),
y AS (SELECT *, CASE sign(r60) WHEN 1 THEN down WHEN -1 THEN up ELSE greatest(up, down) END AS against FROM v)
SELECT {columns} FROM (SELECT symbol, ts, open AS entry_price, round(pts, 9) AS tp_points, round(pts, 9) AS sl_points, CAST(u < d AS INT) AS long_tp, CAST(d < u AS INT) AS short_tp, CAST(u AS INT) AS time_to_long_tp, CAST(d AS INT) AS time_to_short_tp,
 round(above, 6) AS mfe_long, round(below, 6) AS mae_long, round(below, 6) AS mfe_short, round(above, 6) AS mae_short, round(r15, 6) AS return_h15, round(r60, 6) AS return_h60,
 CASE WHEN up + down >= {WIDE} AND abs(r60) < {BACK} THEN 1 WHEN abs(r60) >= {MOVED} AND against < {AGAINST} THEN 0 WHEN up + down < {CALM} THEN 2 WHEN abs(r60) >= {BACK} THEN 0 ELSE 2 END AS path_shape_class,
 CAST(cu < cd AS INT) AS clears_up_first, CAST((turn > {TURN_POINTS} AND d < u) OR (turn < -{TURN_POINTS} AND u < d) AS INT) AS inflection_label, last_ts = ts + INTERVAL '{(horizon - 1) * minutes} minutes' AS valid FROM y) o"""


def triple_barrier(frame: DataFrame, horizon: int, points: str = "30.0") -> DataFrame:
    """Which barrier is hit first within ``horizon`` bars from the open, and the excursions up to that bar.

    ``points`` is an expression of the barriers' distance. A bar that hits both
    counts as a loss; the last ``horizon`` bars of a symbol get no label. The
    future bars are one bounded array a row.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = w.rowsBetween(0, horizon - 1)
    rows = frame.select(
        "symbol", "ts", "open", F.expr(points).alias("pts"), F.collect_list("high").over(ahead).alias("hi"), F.collect_list("low").over(ahead).alias("lo"),
        F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"),
    ).where(F.col("rn") <= F.col("n") - horizon)
    first = lambda arr, cond: F.coalesce(F.nullif(F.array_position(F.transform(arr, cond), F.lit(True)), F.lit(0)) - 1, F.lit(horizon))
    up = first("hi", lambda x: x >= F.col("open") + F.col("pts"))
    down = first("lo", lambda x: x <= F.col("open") - F.col("pts"))
    rows = rows.withColumns({"u": up.cast("int"), "d": down.cast("int")})
    stop = F.least("u", "d", F.lit(horizon - 1)) + 1
    rows = rows.withColumns({"mx": F.array_max(F.slice("hi", F.lit(1), stop)), "mn": F.array_min(F.slice("lo", F.lit(1), stop))})
    r = lambda c: F.round(c, 6)
    return rows.select(
        "symbol", "ts", r("pts").alias("points"), (F.col("u") < F.col("d")).cast("int").alias("long_tp"), (F.col("d") < F.col("u")).cast("int").alias("short_tp"),
        F.col("u").alias("time_to_long_tp"), F.col("d").alias("time_to_short_tp"),
        r(F.greatest(F.col("mx") - F.col("open"), F.lit(0.0))).alias("mfe_long"), r(F.greatest(F.col("open") - F.col("mn"), F.lit(0.0))).alias("mae_long"),
    )


def _barrier_sql(horizon: int, points: str) -> str:
    return f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ({bars_sql(15)}) x),
e AS (SELECT symbol, ts, open, rn, CAST({points} AS DOUBLE) AS pts FROM b WHERE rn <= n - {horizon}),
j AS (SELECT e.symbol, e.ts, e.open, e.pts, f.rn - e.rn AS k, f.high, f.low FROM e JOIN b f ON f.symbol = e.symbol AND f.rn BETWEEN e.rn AND e.rn + {horizon - 1}),
h AS (SELECT symbol, ts, open, pts, coalesce(min(CASE WHEN high >= open + pts THEN k END), {horizon}) AS u, coalesce(min(CASE WHEN low <= open - pts THEN k END), {horizon}) AS d FROM j GROUP BY ALL)
SELECT h.symbol, h.ts, round(h.pts, 6) AS points, CAST(u < d AS INT) AS long_tp, CAST(d < u AS INT) AS short_tp, CAST(u AS INT) AS time_to_long_tp, CAST(d AS INT) AS time_to_short_tp,
 round(greatest(max(j.high) - h.open, 0), 6) AS mfe_long, round(greatest(h.open - min(j.low), 0), 6) AS mae_long
FROM h JOIN j ON j.symbol = h.symbol AND j.ts = h.ts AND j.k <= least(u, d, {horizon - 1}) GROUP BY h.symbol, h.ts, h.pts, h.open, u, d"""


def _bars(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet"), minutes)


VOL = ["symbol", "ts", "tp_points", "long_tp", "short_tp", "time_to_long_tp", "time_to_short_tp", "mfe_long", "mae_long", "mfe_short", "mae_short"]
INFLECTION = ["symbol", "ts", "inflection_label"]


def _vol(spark, sf_dir):
    return barrier_labels(_bars(spark, sf_dir), 20, None, 15).select(VOL)


def _complete(spark, sf_dir):
    return barrier_labels(_bars(spark, sf_dir), 60, None, 15)


def _complete_fixed(spark, sf_dir):
    return barrier_labels(_bars(spark, sf_dir, 60), 20, POINTS, 60)


def _inflection(spark, sf_dir):
    return barrier_labels(_bars(spark, sf_dir), 60, None, 15).select(INFLECTION)


def _fixed(spark, sf_dir):
    return triple_barrier(_bars(spark, sf_dir), 20, "30e0")


def dedup_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "ts", "event_id", "value")
    return keep_first(events, ["event_type", "minute"], ["ts", "event_id"]).select("event_type", "minute", "event_id", "value")


def htf_close(spark, sf_dir):
    """The close of the last finished hour at every 15-minute bar."""
    grid = _bars(spark, sf_dir)
    hours = resample(grid, 60).select("symbol", (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("ts"), F.col("close").alias("htf_close"))
    return as_of(grid, hours, ["htf_close"])


def numbered(times: DataFrame) -> DataFrame:
    """Distinct times with ``rn``, their place from 0: counts of days before, then places within a day, so no task sees all times."""
    each = times.select("ts", F.date_trunc("day", "ts").alias("day"))
    days = each.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    starts = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # one row a day
    within = F.row_number().over(Window.partitionBy("day").orderBy("ts"))
    return each.join(F.broadcast(starts), "day").select("ts", (F.col("start") + within - 1).alias("rn"))


def walk_forward(times: DataFrame, folds: int, embargo: int, months: int, horizon: int = 60) -> DataFrame:
    """(fold, role, ts, rn): purged walk-forward ranges of distinct times; the last months are out of sample.

    ``embargo`` rows before a validation range are in no fold and must cover the
    labels' ``horizon``; there must be enough rows for every fold.
    """
    if embargo < horizon:
        raise ValueError(f"an embargo of {embargo} rows does not cover labels of {horizon}")
    n = numbered(times)
    last = times.agg(F.max("ts")).first()[0]
    if last is None:
        raise ValueError("no times to split")
    dev = n.where(F.col("ts") < F.add_months(F.lit(last).cast("date"), -months).cast("timestamp_ntz")).count()
    part = dev // (folds + 1)
    if part <= embargo:
        raise ValueError(f"{dev} rows are too few for {folds} folds with an embargo of {embargo}")
    at, picks = F.col("rn"), []
    for k in range(folds):
        role = F.when(at < part * (k + 1) - embargo, "train").when((at >= part * (k + 1)) & (at < min(part * (k + 2), dev)), "val")
        picks.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    return n.select("ts", "rn", F.explode(F.filter(F.array(*picks), lambda p: p.isNotNull())).alias("p")).select("p.fold", "p.role", "ts", "rn")


def splits(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").alias("ts")).distinct()
    out = walk_forward(days, 5, 60, 6)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_row"), F.max("rn").alias("last_row"))


QUERIES = {"labels_complete": _complete, "labels_fixed_hourly": _complete_fixed, "label_inflection": _inflection, "triple_barrier_fixed": _fixed, "triple_barrier_vol": _vol, "dedup_keep_first": dedup_events, "asof_htf_close": htf_close, "purged_walk_forward": splits}
ORACLES = {
    "triple_barrier_fixed": _barrier_sql(20, "30"),
    "triple_barrier_vol": labels_sql(20, None, 15, ", ".join(VOL)),
    "labels_complete": labels_sql(60, None, 15),
    "labels_fixed_hourly": labels_sql(20, POINTS, 60),
    "label_inflection": labels_sql(60, None, 15, ", ".join(INFLECTION)),
    "dedup_keep_first": "SELECT event_type, minute, event_id, value FROM (SELECT *, date_trunc('minute', ts) AS minute, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS k FROM events) t WHERE k = 1",
    "asof_htf_close": f"SELECT g.symbol, g.ts, h.close AS htf_close FROM ({bars_sql(15)}) g ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL '60 minutes' AS ts, close FROM ({bars_sql(60)}) z) h ON g.symbol = h.symbol AND g.ts >= h.ts",
    "purged_walk_forward": """
WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM (SELECT DISTINCT l_shipdate AS ts FROM lineitem) d),
p AS (SELECT sum(CASE WHEN ts < (SELECT CAST(max(ts) AS DATE) - INTERVAL '6 months' FROM t) THEN 1 ELSE 0 END)::BIGINT AS dev FROM t),
f AS (SELECT fold, dev, dev // 6 AS c FROM p, (VALUES (0), (1), (2), (3), (4)) v(fold))
SELECT fold, CASE WHEN rn < c * (fold + 1) - 60 THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(rn) AS first_row, max(rn) AS last_row
FROM t, f WHERE rn < c * (fold + 1) - 60 OR (rn >= c * (fold + 1) AND rn < least(c * (fold + 2), dev)) GROUP BY 1, 2""",
}
