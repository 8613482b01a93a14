"""The feature matrix: price blocks of several time frames, and structural families by name.

Both take bars of any number of symbols. A row has what was complete before it:
coarser blocks count from their bars' ends, and at last every column moves one row
on. Plans follow each other on one lineage, so they share one exchange and one sort;
kernels run in one grouped map.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import HAS_PREV, LOG_RETURN, atr, lag, roll, rsi
from barwright.operators import families, kernels, paths, setups, structure
from barwright.plans import Plan, extend
from barwright.sources import OHLCV, bars, bars_sql, resample

# Minutes of the blocks, rows of the rolling primary bar, spans of the averages.
TIMEFRAMES, PRIMARY, FAST, SLOW = (3, 5, 15, 30, 60), 3, 8, 32
BLOCK = ["logret", "vnret", "body", "uwick", "lwick", "rangepct", "rangez", "rsi14", "rsi5", "distfast", "distslow", "trend", "volz"]


def price_block(minutes: int) -> Plan:
    """The block of one time frame, of bars that have the averages ema_fast and ema_slow."""
    n = 240 // minutes
    z = lambda x: f"({x} - ({roll('avg', x, n, n // 4)})) / (({roll('stddev_samp', x, n, n // 4)}) + 1e-9)"
    return Plan(
        [HAS_PREV, {"lr": LOG_RETURN}, *atr(), *rsi(14), *rsi(5), {"rng": "high - low", "size": "NULLIF(atr14, 0)"}, {"rp": "rng / NULLIF(close, 0)"}],
        {
            "logret": "lr", "vnret": "lr / NULLIF(size / NULLIF(close, 0), 0)", "body": "(close - open) / (rng + 1e-9)", "uwick": "(high - greatest(open, close)) / (rng + 1e-9)", "lwick": "(least(open, close) - low) / (rng + 1e-9)",
            "rangepct": "rp", "rangez": z("rp"), "rsi14": "(rsi14 - 50.0) / 50.0", "rsi5": "(rsi5 - 50.0) / 50.0",
            "distfast": "(close - ema_fast) / (size + 1e-9)", "distslow": "(close - ema_slow) / (size + 1e-9)", "trend": "(ema_fast - ema_slow) / (size + 1e-9)", "volz": z("volume"),
        },
        raw=True,
    )


def with_averages(frame: DataFrame) -> DataFrame:
    """Bars with the exponential averages of their closes: a grouped map, which costs five blocks less than five scans over blocks (``scan.ewm``) where a symbol's history fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        c = pdf["close"].to_numpy(float)
        return pdf.assign(ema_fast=kernels.ema(c, FAST), ema_slow=kernels.ema(c, SLOW))

    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["symbol", "ts", *OHLCV]) + ", ema_fast double, ema_slow double"
    return frame.select("symbol", "ts", *OHLCV).groupBy("symbol").applyInPandas(run, schema)


def rolling_bars(frame: DataFrame, rows: int) -> DataFrame:
    """At every bar one bar of the last ``rows``, the bar itself as raw_open, ... and other columns as they are; none before there are so many."""
    w = Window.partitionBy("symbol").orderBy("ts")
    last = w.rowsBetween(1 - rows, 0)
    own = [F.lag("open", rows - 1).over(w).alias("open"), F.max("high").over(last).alias("high"), F.min("low").over(last).alias("low"), F.col("close"), F.sum("volume").over(last).alias("volume")]
    others = [c for c in frame.columns if c not in ("symbol", "ts", *OHLCV)]
    out = frame.select("symbol", "ts", *own, *[F.col(c).alias(f"raw_{c}") for c in OHLCV], *others, F.row_number().over(w).alias("__n"))
    return out.where(F.col("__n") >= rows).drop("__n")


def shifted(matrix: DataFrame) -> DataFrame:
    """Every column one row later; what is no finite number is null."""
    w = Window.partitionBy("symbol").orderBy("ts")
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)  # noqa: E731  false for NaN as well: Spark sorts it above all numbers
    return matrix.select("symbol", "ts", *[F.lag(finite(F.col(c).cast("double"))).over(w).alias(c) for c in matrix.columns if c not in ("symbol", "ts")])


def price_features(frame: DataFrame, timeframes: tuple[int, ...] = TIMEFRAMES, primary: int = PRIMARY, shift: bool = True) -> DataFrame:
    """(symbol, ts, 13 columns a time frame) on the grid of minute bars; rows may have nulls.

    The smallest block is of rolling bars, unless ``primary`` is 1. A block's row
    counts from its bar's end on; one union and one carried value align all blocks.
    """
    grid = frame.select("symbol", "ts", F.lit(1).alias("__side"))
    names = [f"tf{m}_{c}" for m in timeframes for c in BLOCK]
    both = grid.select("*", *[F.lit(None).cast("double").alias(c) for c in names])
    for m in timeframes:
        base = rolling_bars(frame, primary) if m == min(timeframes) and primary > 1 else resample(frame, m) if m > 1 else frame
        block = price_block(m).apply(with_averages(base))
        own = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(f"tf{m}_{c}") for c in BLOCK]
        at = F.col("ts") + F.expr(f"INTERVAL {m if m > 1 else 0} MINUTES")
        both = both.unionByName(block.select("symbol", at.alias("ts"), F.lit(0).alias("__side"), *own), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.select("symbol", "ts", "__side", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in names]).where("__side = 1").drop("__side")
    return shifted(out) if shift else out


KERNELS: dict[str, tuple[kernels.Kernel, list[str]]] = {k: structure.KERNELS[k] if k not in structure.CAUSAL else (structure.CAUSAL[k], structure.KERNELS[k][1]) for k in structure.KERNELS}
KERNELS |= {n: kernels.KERNELS[k] for n, k in {"facc": "kern_facc", "anomaly": "kern_mahalanobis", "bocpd": "kern_bocpd", "flow": "kern_vpin", "volrank": "kern_vol_rank"}.items()}
PLANS: dict[str, Plan] = families.FAMILIES | setups.SETUPS
#: Families that are made of a plan and a kernel.
PARTS = {"flow": ["flow", "leadlag"], "vol": ["vol", "volrank"]}
AGGREGATORS = {"scnf": structure.confluence, "shtf": structure.htf_context}
#: Families that only read a cache by time, with their columns and what fills gaps; without a cache the second is an error.
CACHED: dict[str, tuple[list[str], float | None]] = {
    "kronos": (paths.COLUMNS, None),
    "simmtm": ([f"simmtm_{i:03d}" for i in range(96)], 0.0),
}
REGISTRY = sorted((set(PLANS) | set(KERNELS) | set(AGGREGATORS) | set(CACHED)) - {"leadlag", "volrank"})
#: Families of setups that aggregators read.
NEEDS = {"scnf": structure.PRIORITY, "shtf": [*structure.PRIORITY, "mtf"]}


@dataclass(frozen=True)
class Spec:
    """Which structural families to build: ``Spec.parse("session, vol")``, "all" or "none"."""

    enabled: frozenset[str] = field(default_factory=lambda: frozenset(REGISTRY))

    @classmethod
    def parse(cls, text: str) -> Spec:
        text = text.strip().lower()
        if text in ("all", ""):
            return cls()
        names = set() if text == "none" else {n.strip() for n in text.split(",") if n.strip()}
        if unknown := names - set(REGISTRY):
            raise ValueError(f"unknown families: {sorted(unknown)}; there are {REGISTRY}")
        return cls(frozenset(names))

    def __str__(self) -> str:
        return "structural: " + (", ".join(sorted(self.enabled)) or "none")


def family_columns(name: str) -> list[str]:
    """The columns of a family, in order."""
    if name in CACHED:
        return CACHED[name][0]
    if name in AGGREGATORS:
        return ["scf_long_count", "scf_short_count", "scf_consensus_score", "scf_total_active"] if name == "scnf" else [*[f"{n}_htf_agree" for n in structure.PRIORITY], "shtf_primary_agree", "shtf_primary_60m", "shtf_aligned_count", "shtf_opposed_count"]
    parts = PARTS.get(name, [name])
    return [c for p in parts for c in ((KERNELS[p][1] if p in KERNELS else []) if p not in PLANS else list(PLANS[p].out))]


def structural_features(frame: DataFrame, spec: Spec = Spec(), caches: dict[str, DataFrame] | None = None, shift: bool = True) -> DataFrame:
    """(symbol, ts, columns of the enabled families). Aggregators read the others' columns in a second pass.

    Families of several instruments need the columns that ``sources.align`` adds;
    cached ones a table in ``caches``.
    """
    wanted = [n for n in REGISTRY if n in spec.enabled]
    base = {p for n in wanted for p in PARTS.get(n, [n])} | {p for n in wanted for p in NEEDS.get(n, [])}
    out = frame
    held = [n for n in KERNELS if n in base]
    if held:
        columns = [c for n in held for c in KERNELS[n][1]]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts", kind="stable")
            found = functools.reduce(dict.__or__, ({c: v for c, v in KERNELS[n][0](pdf).items() if c in KERNELS[n][1]} for n in held))
            own = pd.DataFrame(found, index=pdf.index)[columns].astype(float).replace([np.inf, -np.inf], np.nan)
            return pd.concat([pdf, own.astype(object).where(own.notna(), None)], axis=1)

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema] + [f"{c} double" for c in columns])
        out = out.groupBy("symbol").applyInPandas(run, schema)
    plans = {n: PLANS[n] for n in sorted(base & set(PLANS))}
    if (beside := [n for n in plans if plans[n].cross]) and "es_close" not in frame.columns:
        raise ValueError(f"families {beside} need other instruments beside the bars")
    out = extend(out, plans)
    for n in wanted:
        if n in AGGREGATORS:
            out = out.select("*", *AGGREGATORS[n](out, columns_only=True))
        elif n in CACHED:
            cache, (columns, fill) = (caches or {}).get(n), CACHED[n]
            if cache is None and fill is not None:
                raise FileNotFoundError(f"family {n} reads a cache")
            if cache is None:
                out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
            else:
                rows = cache.select(*[c for c in ("symbol", "ts") if c in cache.columns], *columns)
                out = out.join(rows, [c for c in ("symbol", "ts") if c in cache.columns], "left")
                out = out if fill is None else out.na.fill(fill, columns)
    out = out.select("symbol", "ts", *[c for n in wanted for c in family_columns(n)])
    return shifted(out) if shift else out


def build_features(frame: DataFrame, timeframes: tuple[int, ...] = TIMEFRAMES, primary: int = PRIMARY, spec: Spec | None = None, caches: dict[str, DataFrame] | None = None, shift: bool = True) -> DataFrame:
    """The price blocks and the enabled families of minute bars; only rows without any null.

    ``frame`` may have aligned columns of other instruments beside its own.
    Families see rolling bars of ``primary`` rows, and the bars themselves where
    they build coarser ones; with ``primary`` 1 only those.
    """
    out = price_features(frame.select("symbol", "ts", *OHLCV), timeframes, primary, shift)
    if spec is not None and spec.enabled:
        base = frame
        if primary > 1:
            base = rolling_bars(frame, primary)
        out = out.join(structural_features(base, spec, caches, shift), ["symbol", "ts"])
    return out.na.drop("any")


def degenerate(matrix: DataFrame) -> dict[str, str]:
    """Columns without any value, or with nothing but zeros: signs of a missing cache or broken input."""
    cols = [c for c in matrix.columns if c not in ("symbol", "ts")]
    if not cols:
        return {}
    row = matrix.agg(*[F.count(c).alias(f"n_{c}") for c in cols], *[F.max(F.abs(F.col(c).cast("double"))).alias(f"m_{c}") for c in cols]).first()
    return {c: "null" if not row[f"n_{c}"] else "zero" for c in cols if not row[f"n_{c}"] or row[f"m_{c}"] == 0}


def _averages_sql(inner: str) -> str:
    """The bars of ``inner`` with both averages, as a recursion over rows."""
    return f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({inner}) x),
e AS (SELECT symbol, rn, CAST(close AS DOUBLE) AS ema_fast, CAST(close AS DOUBLE) AS ema_slow FROM b WHERE rn = 1
 UNION ALL SELECT b.symbol, b.rn, e.ema_fast + 2e0 / {FAST + 1} * (b.close - e.ema_fast), e.ema_slow + 2e0 / {SLOW + 1} * (b.close - e.ema_slow) FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.volume, e.ema_fast, e.ema_slow FROM b JOIN e USING (symbol, rn)"""


def _coarse_sql(minutes: int) -> str:
    if minutes > min(TIMEFRAMES):
        return f"SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({bars_sql(1)}) m GROUP BY 1, 2"
    w = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {PRIMARY - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT symbol, ts, first_value(open) OVER {w} AS open, max(high) OVER {w} AS high, min(low) OVER {w} AS low, close, sum(volume) OVER {w} AS volume FROM ({bars_sql(1)}) m QUALIFY count(*) OVER {w} = {PRIMARY}"


def matrix_sql(digits: int = 6) -> str:
    """``build_features`` of the price blocks in SQL: as-of joins of blocks that SQL computes by itself."""
    joins, cols = [], []
    for m in TIMEFRAMES:
        plan = price_block(m)
        block = plan.sql().replace(f"({bars_sql(plan.minutes)}) b", f"({_averages_sql(_coarse_sql(m))}) b")
        values = ", ".join(f"last_value(CASE WHEN isfinite({c}) THEN {c} END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS {c}" for c in BLOCK)
        joins.append(f"ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL '{m} minutes' AS ts, {values} FROM ({block}) q{m}) t{m} ON t{m}.symbol = g.symbol AND g.ts >= t{m}.ts")
        cols += [f"lag(t{m}.{c}) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS tf{m}_{c}" for c in BLOCK]
    names = [f"tf{m}_{c}" for m in TIMEFRAMES for c in BLOCK]
    return f"SELECT symbol, ts, {', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in names)} FROM (SELECT g.symbol, g.ts, {', '.join(cols)} FROM ({bars_sql(1)}) g {' '.join(joins)}) f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names)}"


def _rounded(matrix: DataFrame, digits: int = 6) -> DataFrame:
    return matrix.select("symbol", "ts", *[(F.round(c, digits) + 0.0).alias(c) for c in matrix.columns if c not in ("symbol", "ts")])


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All price blocks of the demo's minute bars."""
    return _rounded(build_features(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 1)))


DEMO = Spec.parse("session, sanat, tof, round, vreg, vss, rhythm, absorp, pvd, sweep, vwap, spool, scomp, pda, pclear, seod, svwap, surprise")


def structural_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families that are plans, on the demo's 15-minute bars, moved one row on."""
    out = structural_features(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15), DEMO)
    digits = {c: PLANS[n].digits for n in DEMO.enabled for c in family_columns(n)}
    return out.select("symbol", "ts", *[(F.round(c, d) + 0.0).alias(c) for c, d in ((c, digits[c]) for c in out.columns[2:])])


def structural_sql() -> str:
    names = sorted(DEMO.enabled)
    cols = [(n, c) for n in names for c in family_columns(n)]
    joins = " ".join(f"JOIN ({PLANS[n].sql()}) f{k} ON f{k}.symbol = g.symbol AND f{k}.ts = g.ts" for k, n in enumerate(names))
    return f"SELECT g.symbol, g.ts, {', '.join(f'round(CAST(lag(f{names.index(n)}.{c}) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS DOUBLE), {PLANS[n].digits}) + 0.0 AS {c}' for n, c in cols)} FROM (SELECT symbol, ts FROM ({bars_sql(15)}) b) g {joins}"


def every_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families that need no cache, kernels and aggregators among them, beside aligned instruments."""
    from barwright.sources import CROSS, align

    frame = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15)
    frame = align(frame.where("symbol = 'click'"), {n: frame.where(F.col("symbol") == s) for n, s in CROSS.items()})
    return structural_features(frame, Spec(frozenset(REGISTRY) - set(CACHED)))


QUERIES = {"build_features": feature_matrix, "structural_features": structural_matrix, "all_families": every_family}
ORACLES = {"build_features": matrix_sql(), "structural_features": structural_sql()}
