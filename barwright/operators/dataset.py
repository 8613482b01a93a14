"""What a model reads: windows of the matrix with their labels, normalised by window, and the second layer's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import evaluation, families, features, labels
from barwright.plans import Plan
from barwright.sources import bars, bars_sql

# Fixed value: what is added to a window's variance.
EPSILON = 1e-5


def direction_class(long_tp: Column, short_tp: Column) -> Column:
    """0 where the long side won, 1 where the short side did, else 2."""
    return F.when(long_tp == 1, 0).when(short_tp == 1, 1).otherwise(2)


def windows(matrix: DataFrame, truths: DataFrame, length: int) -> DataFrame:
    """Each label with ``x``, the last ``length`` rows of the matrix up to it as an array of rows, and its direction class.

    Rows follow each other as they are in the matrix; labels without a full window
    are left out, and a label whose row the matrix lacks is an error.
    """
    columns = [c for c in matrix.columns if c not in ("symbol", "ts")]
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - length, 0)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    held = matrix.select("symbol", "ts", F.collect_list(row).over(w).alias("x"))
    missing = truths.join(matrix.select("symbol", "ts"), ["symbol", "ts"], "left_anti").limit(1).count()
    if missing:
        raise ValueError("labels without a row in the matrix: keep those of its index first")
    out = truths.join(held.where(F.size("x") == length), ["symbol", "ts"])
    return out.withColumn("direction_class", direction_class(F.col("long_tp"), F.col("short_tp")))


def normalised(data: DataFrame, size: int, column: str = "x") -> DataFrame:
    """Windows of ``size`` columns with each column's mean taken off and divided by its deviation in the window; both are kept as mean and dev."""
    n = F.size(column)
    at = lambda k: F.transform(column, lambda r: r[k])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    data = data.withColumn("mean", F.array(*[total(at(k)) / n for k in range(size)]))
    square = lambda k: F.aggregate(at(k), F.lit(0.0), lambda s, v: s + (v - F.col("mean")[k]) * (v - F.col("mean")[k]))
    data = data.withColumn("dev", F.array(*[F.sqrt(square(k) / n + EPSILON) for k in range(size)]))
    return data.withColumn(column, F.transform(column, lambda r: F.zip_with(F.zip_with(r, F.col("mean"), lambda v, m: v - m), F.col("dev"), lambda v, d: v / d)))


def restored(data: DataFrame, column: str = "x") -> DataFrame:
    """The inverse of ``normalised``."""
    return data.withColumn(column, F.transform(column, lambda r: F.zip_with(F.zip_with(r, F.col("dev"), lambda v, d: v * d), F.col("mean"), lambda v, m: v + m)))


# What stands for outputs that a first layer does not have.
NEUTRAL = {"return_h15_pred": 0.0, "return_h60_pred": 0.0, "path_shape_p0": 1 / 3, "path_shape_p1": 1 / 3, "path_shape_p2": 1 / 3, "clears_level_prob": 0.5, "inflection_prob": 0.5}
FIRST = ["long_tp_prob", "short_tp_prob", "mfe_long", "mae_long", "mfe_short", "mae_short"]


def second_layer(predictions: DataFrame, structural: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, ts, l1_ outputs, time columns, structural ``columns``): outputs that are missing get their neutral value, missing columns and rows 0."""
    time = families.FAMILIES["session"].apply(predictions.select("symbol", "ts")).select("symbol", "ts", "time_hour_sin", "time_hour_cos", "time_dow_sin", "time_dow_cos")
    own = predictions.select("symbol", "ts", *[F.col(c).cast("double").alias(f"l1_{c}") for c in FIRST], *[(F.col(c).cast("double") if c in predictions.columns else F.lit(v)).alias(f"l1_{c}") for c, v in NEUTRAL.items()])
    have = [c for c in columns if c in structural.columns]
    out = own.join(time, ["symbol", "ts"]).join(structural.select("symbol", "ts", *have), ["symbol", "ts"], "left").na.fill(0.0, have)
    return out.select(*out.columns[: len(out.columns) - len(have)], *[F.col(c).cast("double") if c in have else F.lit(0.0).alias(c) for c in columns])


LENGTH = 20
_COLUMNS = ["atr14", "rsi14", "logret"]


def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised windows of the flagship's columns: per label the direction, means, deviations and the last row."""
    frame = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15)
    matrix = families.PRIMITIVES["flagship_causal_bars"].apply(frame).na.drop("any")
    truths = labels.at_index(labels.barrier_labels(frame, 60, None, 15), matrix)
    data = normalised(windows(matrix, truths, LENGTH), len(_COLUMNS))
    r = lambda c: F.round(c, 5) + 0.0
    cols = [e for k, c in enumerate(_COLUMNS) for e in ((F.round(F.col("mean")[k], 9) + 0.0).alias(f"mean_{c}"), r(F.col("dev")[k]).alias(f"dev_{c}"), r(F.element_at("x", -1)[k]).alias(f"last_{c}"))]
    return data.select("symbol", "ts", "direction_class", *cols)


def window_sql() -> str:
    w = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)"
    known = " AND ".join(f"{c} IS NOT NULL" for c in _COLUMNS)
    cols = ", ".join(f"round(avg({c}) OVER {w}, 9) + 0.0 AS mean_{c}, round(sqrt(var_pop({c}) OVER {w} + {EPSILON}), 5) + 0.0 AS dev_{c}, round(({c} - avg({c}) OVER {w}) / sqrt(var_pop({c}) OVER {w} + {EPSILON}), 5) + 0.0 AS last_{c}" for c in _COLUMNS)
    return f"""WITH m AS (SELECT * FROM ({families.PRIMITIVES["flagship_causal_bars"].sql()}) f WHERE {known}), s AS (SELECT symbol, ts, count(*) OVER {w} AS n, {cols} FROM m)
SELECT s.* EXCLUDE (n), CASE WHEN long_tp = 1 THEN 0 WHEN short_tp = 1 THEN 1 ELSE 2 END AS direction_class FROM s JOIN ({labels.labels_sql(60, None, 15)}) l USING (symbol, ts) WHERE n = {LENGTH}"""


# Trades kept by cell, trades before a cell counts, and how a fall below the prior scales.
KEPT, COLD, DRIFT_SCALE = 100, 10, 2.0


def tracker(trades: DataFrame, priors: dict[str, float], last: int = 30, pooled: int = 60) -> DataFrame:
    """(setup, regime, n, recent_wr, recent_r, drift, pooled_wr) of trades (setup, regime, ts, r_multiple): priors where there are too few."""
    prior = F.coalesce(*[F.when(F.col("setup") == k, F.lit(v)) for k, v in priors.items()], F.lit(0.5))
    newest = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("ts"), F.desc("r_multiple")))
    kept = trades.withColumn("k", newest("setup", "regime")).where(F.col("k") <= KEPT)
    won = F.avg((F.col("r_multiple") > 0).cast("double"))
    recent = kept.where(F.col("k") <= last).groupBy("setup", "regime").agg(won.alias("wr"), F.avg("r_multiple").alias("r"))
    cells = kept.groupBy("setup", "regime").agg(F.count(F.lit(1)).alias("n")).join(recent, ["setup", "regime"])
    each = kept.withColumn("p", newest("setup"))
    pools = each.groupBy("setup").agg(F.count(F.lit(1)).alias("all"), F.avg(F.when(F.col("p") <= pooled, (F.col("r_multiple") > 0).cast("double"))).alias("pool"))
    warm = F.col("n") >= COLD
    out = cells.join(pools, "setup").withColumn("prior", prior).withColumn("recent_wr", F.when(warm, F.col("wr")).otherwise(F.col("prior")))
    fall = F.greatest(F.col("prior") - F.col("recent_wr"), F.lit(0.0)) / F.greatest("prior", F.lit(0.01))
    return out.select(
        "setup", "regime", "n", F.round("recent_wr", 6).alias("recent_wr"), F.round(F.when(warm, F.col("r")).otherwise(0.0), 6).alias("recent_r"), F.round(F.least(fall * DRIFT_SCALE, F.lit(1.0)), 6).alias("drift"),
        F.round(F.when(F.col("all") >= COLD, F.col("pool")).otherwise(F.col("prior")), 6).alias("pooled_wr"),
    )


_TRADES = Plan([{"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"}], {"setup": "CASE (rn + length(symbol)) % 9 WHEN 0 THEN 'sfs' WHEN 1 THEN 'orb' WHEN 2 THEN 'new' ELSE 'spb' END", "regime": "CASE WHEN rn % 1499 = 3 THEN 7 ELSE rn % 3 END", "r_multiple": "(close - open) / 100.0"}, keys=("symbol", "ts"), raw=True)
_PRIORS = {"sfs": 0.62, "orb": 0.57, "spb": 0.57}


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker(_TRADES.run(spark, sf_dir), _PRIORS)


def tracker_sql(trades: str, priors: dict[str, float]) -> str:
    """``tracker`` over the query ``trades``."""
    prior = "CASE setup " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in priors.items()) + " ELSE 5e-1 END"
    return f"""WITH t AS (SELECT * FROM ({trades}) x QUALIFY row_number() OVER (PARTITION BY setup, regime ORDER BY ts DESC, r_multiple DESC) <= {KEPT}),
k AS (SELECT *, row_number() OVER (PARTITION BY setup, regime ORDER BY ts DESC, r_multiple DESC) AS k, row_number() OVER (PARTITION BY setup ORDER BY ts DESC, r_multiple DESC) AS p FROM t),
c AS (SELECT setup, regime, count(*) AS n, avg(CASE WHEN k <= 30 THEN CAST(r_multiple > 0 AS DOUBLE) END) AS wr, avg(CASE WHEN k <= 30 THEN r_multiple END) AS r FROM k GROUP BY ALL),
q AS (SELECT setup, count(*) AS total, avg(CASE WHEN p <= 60 THEN CAST(r_multiple > 0 AS DOUBLE) END) AS pool FROM k GROUP BY setup),
j AS (SELECT c.*, total, pool, {prior} AS prior, CASE WHEN n >= {COLD} THEN wr ELSE {prior} END AS recent FROM c JOIN q USING (setup))
SELECT setup, regime, n, round(recent, 6) AS recent_wr, round(CASE WHEN n >= {COLD} THEN r ELSE 0 END, 6) AS recent_r, round(least(greatest(prior - recent, 0) / greatest(prior, 0.01) * {DRIFT_SCALE}, 1), 6) AS drift, round(CASE WHEN total >= {COLD} THEN pool ELSE prior END, 6) AS pooled_wr FROM j"""


def tracked_sql() -> str:
    return tracker_sql(_TRADES.sql(), _PRIORS)


# A setup's target and stop in mean ranges, and the bars it is held.
EXECUTION = {"sfs": (1.5, 0.6, 45), "sfa": (1.3, 0.8, 60), "sld": (1.2, 0.5, 40), "orb": (1.5, 1.0, 60), "svwap": (1.0, 0.5, 40), "spb": (1.2, 0.6, 45), "scomp": (1.5, 0.7, 30), "seod": (0.4, 0.5, 20)}


def setup_barriers(table: DataFrame, hold: int = 60, points: float = labels.POINTS) -> DataFrame:
    """``table`` (setup, atr[, tp_points, sl_points]) with effective_tp, effective_sl and hold_bars: by setup, or the bar's own barriers without one."""
    own = lambda c: F.col(c) if c in table.columns else F.lit(points)
    by = lambda k: F.coalesce(*[F.when(F.col("setup") == n, F.lit(v[k])) for n, v in EXECUTION.items()])
    return table.withColumns({"effective_tp": F.coalesce(by(0) * F.col("atr"), own("tp_points")), "effective_sl": F.coalesce(by(1) * F.col("atr"), own("sl_points")), "hold_bars": F.coalesce(by(2), F.lit(hold))})


def sizing_grade(sizing: Column) -> Column:
    """3 from three quarters on, 2 from a half, 1 above nothing: a router never asks for the highest grade."""
    return F.when(sizing >= 0.75, 3).when(sizing >= 0.5, 2).when(sizing > 0, 1).otherwise(0)


#: Bars of diagnostics: correlation of both sides, information coefficients, accuracy of shapes, AUC of clearance; marginal and strong.
TIERS = {"side_corr": (-0.3, -0.5), "ic_15": (0.03, 0.06), "ic_60": (0.03, 0.06), "shape_accuracy": (0.38, 0.42), "clear_auc": (0.53, 0.56)}


def verdict(table: DataFrame) -> DataFrame:
    """``table`` with ``verdict`` of its diagnostics (the columns of TIERS; null ones pass no bar)."""
    passed = lambda k: sum((F.coalesce((F.col(c) < b[k]) if b[0] < 0 else (F.col(c) > b[k]), F.lit(False)).cast("int") for c, b in TIERS.items()), F.lit(0))
    told = F.when(F.coalesce(*[F.col(c) for c in TIERS]).isNull(), "INCONCLUSIVE").when(F.col("side_corr") > 0.5, "PACING")
    return table.withColumn("verdict", told.when(passed(1) >= 3, "STRONG-PREDICTIVE").when(passed(0) >= 3, "PREDICTIVE").when(passed(0) >= 1, "WEAK").otherwise("PACING-LIKE"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions by fold, each fold a folder, so that one can be read or replaced by itself."""
    predictions.write.partitionBy("fold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_predictions(spark: SparkSession, path: str, fold: int | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if fold is None else out.where(F.col("fold") == fold)


def routed_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo's routed bars with their setup's barriers and grade."""
    from barwright.operators import router

    frame = labels.past_range(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15)).select("symbol", "ts", "atr")
    table = setup_barriers(router.routed(spark, sf_dir).join(frame, ["symbol", "ts"]))
    return table.select("symbol", "ts", "setup", F.round("effective_tp", 5).alias("effective_tp"), F.round("effective_sl", 5).alias("effective_sl"), "hold_bars", sizing_grade(F.col("sizing_factor")).alias("grade"))


def routed_barriers_sql() -> str:
    from barwright.operators import router

    pick = lambda k: "CASE setup " + " ".join(f"WHEN '{n}' THEN {v[k]}" for n, v in EXECUTION.items()) + " END"
    ranges = f"""WITH b AS (SELECT *, greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) AS tr FROM ({bars_sql(15)}) x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
a AS (SELECT symbol, ts, CASE WHEN count(tr) OVER p >= 15 THEN avg(tr) OVER p END AS m FROM b WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, greatest(coalesce(m, median(m) OVER (PARTITION BY symbol)), 0.5) AS atr FROM a"""
    return f"""SELECT symbol, ts, setup, round(CAST(coalesce({pick(0)} * atr, {labels.POINTS}) AS DOUBLE), 5) AS effective_tp, round(CAST(coalesce({pick(1)} * atr, {labels.POINTS}) AS DOUBLE), 5) AS effective_sl, coalesce({pick(2)}, 60) AS hold_bars,
CASE WHEN sizing_factor >= 0.75 THEN 3 WHEN sizing_factor >= 0.5 THEN 2 WHEN sizing_factor > 0 THEN 1 ELSE 0 END AS grade FROM ({router.routed_sql()}) r JOIN ({ranges}) q USING (symbol, ts)"""


QUERIES = {"window_dataset": window_summary, "tracker_cells": tracked, "setup_barriers": routed_barriers}
ORACLES = {"window_dataset": window_sql(), "tracker_cells": tracked_sql(), "setup_barriers": routed_barriers_sql()}
