"""Sequential execution of graded candidates: one stack of positions a symbol, entry rules, forced closes.

A plan grades both sides and keeps the candidates; only those reach the grouped
map, which walks a symbol's candidates in order of time and gives each a
verdict. What trades or totals are wanted follows from that table.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import TRUE_RANGE, over, roll
from barwright.operators.evaluation import PNL, POINT, PREDS
from barwright.plans import Plan


@dataclass(frozen=True)
class Rules:
    """Contracts by grade 1 to 3 and for further legs, minutes, shares of the daily loss limit, hours (UTC)."""

    contracts: tuple[int, int, int] = (1, 2, 3)
    leg: int = 3
    depth: int = 3
    leg_gap: int = 5
    hold: int = 60
    before_close: int = 20
    close_hour: int = 16
    zone: str = "America/New_York"
    pauses: tuple[tuple[int, int], ...] = ((2, 10), (3, 20), (4, 30))
    releases: tuple[tuple[float, float], ...] = ((12.0, 13.5), (13.5, 14.5), (17.5, 18.75))
    release_margin: float = 0.5
    loss_limit: float = 1000.0
    loss_stop: float = 0.8
    loss_resume: float = 0.6
    vol_z: float = 3.0
    vol_pause: int = 5


def next_close(ts: pd.Series, rules: Rules) -> pd.Series:
    """The first session close at or after each UTC time, by the zone's own clock."""
    local = ts.dt.tz_localize("UTC").dt.tz_convert(rules.zone)
    day = local.dt.tz_localize(None).dt.normalize()
    day += pd.to_timedelta((local.dt.tz_localize(None) > day + pd.Timedelta(hours=rules.close_hour)).astype(int), unit="D")
    return (day + pd.Timedelta(hours=rules.close_hour)).dt.tz_localize(rules.zone).dt.tz_convert("UTC").dt.tz_localize(None)


class Stack:
    """Open positions of one symbol, and what the rules remember of closed ones."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.open, self.losses = rules, [], 0
        self.paused = self.calm = pd.Timestamp.min
        self.day, self.locked = defaultdict(float), set()

    def settle(self, now: pd.Timestamp) -> None:
        """Closes what has reached its exit, oldest entry first."""
        due = [p for p in self.open if p["exit"] <= now]
        self.open = [p for p in self.open if p["exit"] > now]
        for p in due:
            self.day[p["exit"].date()] += p["pnl"] * p["contracts"] * POINT
            self.losses = self.losses + 1 if p["pnl"] <= 0 else 0
            pause = max((m for n, m in self.rules.pauses if self.losses >= n), default=0)
            if pause:
                self.paused = p["exit"] + pd.Timedelta(minutes=pause)
            elif not self.losses:
                self.paused = pd.Timestamp.min

    def loss_locked(self, day) -> bool:
        r = self.rules
        if day in self.locked and self.day[day] > -r.loss_limit * r.loss_resume:
            self.locked.discard(day)
        elif day not in self.locked and self.day[day] < -r.loss_limit * r.loss_stop:
            self.locked.add(day)
        return day in self.locked

    def verdict(self, now: pd.Timestamp, close: pd.Timestamp, side: int, grade: int, z: float) -> str:
        r, minutes = self.rules, pd.Timedelta(minutes=1)
        if close - r.before_close * minutes <= now < close:
            return "eod"
        if now < self.paused:
            return "cooldown"
        hour = now.hour + now.minute / 60
        if now.weekday() < 5 and any(lo - r.release_margin <= hour < hi + r.release_margin for lo, hi in r.releases):
            return "release"
        if self.loss_locked(now.date()):
            return "daily_loss"
        if now < self.calm:
            return "volatility"
        if z >= r.vol_z:
            self.calm = now + r.vol_pause * minutes
            return "volatility"
        if not self.open:
            return "entry"
        last = self.open[-1]
        fits = grade >= 4 and now - last["entry"] >= r.leg_gap * minutes and len(self.open) < r.depth and last["side"] == side
        return "leg" if fits else "passed_over"

    def enter(self, now: pd.Timestamp, close: pd.Timestamp, side: int, grade: int, pnl: float, leg: bool) -> tuple[pd.Timestamp, int]:
        size = self.rules.leg if leg else self.rules.contracts[min(grade, 3) - 1]
        out = min(now + pd.Timedelta(minutes=self.rules.hold), close)
        self.open.append({"entry": now, "exit": out, "side": side, "contracts": size, "pnl": pnl})
        return out, size


def execute(candidates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Each candidate (symbol, ts, side, grade, pnl, z) with its verdict; exit, contracts and usd where it was traded.

    One task walks one symbol's candidates. A null z never stops an entry; candidates with grade 0 or side 0 are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        stack, rows = Stack(rules), []
        for now, close, side, grade, pnl, z in zip(pdf["ts"], next_close(pdf["ts"], rules), pdf["side"], pdf["grade"], pdf["pnl"], pdf["z"]):
            stack.settle(now)
            what = stack.verdict(now, close, side, grade, z)
            traded = what in ("entry", "leg")
            out, size = stack.enter(now, close, side, grade, pnl, what == "leg") if traded else (pd.NaT, 0)
            rows.append((what, out, size, pnl * size * POINT if traded else None))
        return pd.concat([pdf[["symbol", "ts", "side", "grade"]], pd.DataFrame(rows, columns=["verdict", "exit_ts", "contracts", "usd"])], axis=1)

    schema = "symbol string, ts timestamp_ntz, side int, grade int, verdict string, exit_ts timestamp_ntz, contracts int, usd double"
    cols = [F.col("symbol"), F.col("ts"), F.col("side").cast("int"), F.col("grade").cast("int"), F.col("pnl").cast("double"), F.col("z").cast("double")]
    return candidates.where("side <> 0 AND grade > 0").select(*cols).groupBy("symbol").applyInPandas(run, schema)


def concurrency(trades: DataFrame) -> DataFrame:
    """The most contracts open at once, by symbol; closes come before entries of the same time."""
    traded = trades.where("contracts > 0")
    moves = traded.select("symbol", F.col("ts").alias("at"), F.col("contracts").alias("d")).union(traded.select("symbol", F.col("exit_ts"), -F.col("contracts")))
    per = moves.groupBy("symbol", "at", (F.col("d") > 0).alias("opens")).agg(F.sum("d").alias("d"))
    held = per.selectExpr("symbol", "sum(d) OVER (PARTITION BY symbol ORDER BY at, opens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held")
    return held.groupBy("symbol").agg(F.max("held").alias("max_contracts"))


_grade = lambda p, k, n: f"CASE WHEN {p} <= 1e-9 THEN 0 WHEN {k} <= ceil(0.005 * {n}) THEN 4 WHEN {k} <= ceil(0.01 * {n}) THEN 3 WHEN {k} <= ceil(0.05 * {n}) THEN 2 WHEN {k} <= ceil(0.2 * {n}) THEN 1 ELSE 0 END"
CANDIDATES = Plan(
    [
        *PREDS,
        {"tr": TRUE_RANGE},
        {"tp": f"1.5 * ({roll('avg', 'tr', 60, 15)})"},
        PNL,
        {f"k{s}": f"row_number() OVER (PARTITION BY symbol ORDER BY p{s} DESC, ts)" for s in "ls"} | {f"n{s}": f"sum(CASE WHEN p{s} > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol)" for s in "ls"},
        {f"g{s}": _grade(f"p{s}", f"k{s}", f"n{s}") for s in "ls"} | {"past": over("count", "tp", -60, -1), "mid": over("avg", "tp", -60, -1), "dev": over("stddev_pop", "tp", -60, -1)},
        {"way": "CASE WHEN gl > gs OR (gl > 0 AND gl = gs AND pl > ps + 0.02) THEN 1 WHEN gs > gl OR (gs > 0 AND gl = gs AND ps > pl + 0.02) THEN -1 ELSE 0 END"},
    ],
    {"side": "way", "grade": "CASE way WHEN 1 THEN gl WHEN -1 THEN gs ELSE 0 END", "pnl": "CASE way WHEN 1 THEN pnl_l ELSE pnl_s END", "z": "CASE WHEN past >= 30 AND dev > 1e-9 THEN (tp - mid) / dev END"},
)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(CANDIDATES.run(spark, sf_dir))


QUERIES = {"sim_sequential": _trades, "sim_max_concurrency": lambda spark, sf_dir: concurrency(_trades(spark, sf_dir)).withColumn("dollars_a_point", F.col("max_contracts") * F.lit(POINT))}
