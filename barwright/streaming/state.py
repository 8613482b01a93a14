"""Kernels with state over a stream of bars: averages, session prices and prior-day levels, equal to the batch plans.

A bar is worked on once the watermark has passed it, so bars of a symbol may arrive in
any order within the allowed delay. State is one row of numbers a symbol (value state),
the bars that still wait (list state), and a timer at the first of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPANS = {"ema8": 8, "ema32": 32}
#: Hours (UTC) in which the regular session is open.
OPENS, CLOSES = 13.5, 20.0
LEVELS = ("pdh", "pdl", "onh", "onl", "pdc", "ro")
OUTPUT = "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in (*SPANS, "vwap", "sigma", *LEVELS))
_NUMBERS = [*SPANS, "c0", "c1", "c2", "close", "rth", "day", "rh", "rl", "nh", "nl", *LEVELS]


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Timers and lists need the store that keeps several columns; the setting is put back after queries are started."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def step(s: dict[str, float | None], bar: tuple) -> dict[str, float | None]:
    """The results of one bar (ts, open, high, low, close, volume) after the bars that ``s`` has seen; ``s`` then has seen it too."""
    ts, open_, high, low, close, volume = bar
    out: dict[str, float | None] = {}
    for n, span in SPANS.items():
        s[n] = close if s[n] is None else s[n] + 2.0 / (span + 1) * (close - s[n])
        out[n] = s[n]
    # what the rows before this one know
    out["vwap"] = s["c1"] / s["c0"] if s["c0"] else None
    spread = max(s["c2"] / s["c0"] - out["vwap"] ** 2, 0.0) if s["c0"] else None
    out["sigma"] = None if spread is None else 0.0 if spread < 1e-6 else math.sqrt(spread)
    out |= {n: s[n] for n in LEVELS}
    hour = ts.hour + ts.minute / 60.0
    rth, was = OPENS <= hour < CLOSES, bool(s["rth"])
    if s["rth"] is None or rth != was:
        s["c0"] = s["c1"] = s["c2"] = 0.0
    price = (high + low + close) / 3.0
    s["c0"], s["c1"], s["c2"] = s["c0"] + volume, s["c1"] + price * volume, s["c2"] + price * price * volume
    if rth and not was:  # a session opens: the last day is complete
        s["day"] += 1
        for n, v in (("pdh", s["rh"]), ("pdl", s["rl"]), ("onh", s["nh"]), ("onl", s["nl"]), ("pdc", s["close"] if s["day"] >= 2 else None), ("ro", open_)):
            s[n] = s[n] if v is None else v
        s["rh"] = s["rl"] = s["nh"] = s["nl"] = None
    top, low_ = ("rh", "rl") if rth else ("nh", "nl")
    s[top] = high if s[top] is None else max(s[top], high)
    s[low_] = low if s[low_] is None else min(s[low_], low)
    s["rth"], s["close"] = float(rth), close
    return out


class BarKernels(StatefulProcessor):
    """The results of every bar of a symbol, in order of time, once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", ", ".join(f"{n} double" for n in _NUMBERS))
        self.held = handle.getListState("held", "ts timestamp, open double, high double, low double, close double, volume double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            new += [(r.ts.to_pydatetime(), r.open, r.high, r.low, r.close, float(r.volume)) for r in pdf.itertuples()]
        if new:
            self.held.appendList(new)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        # sorted whole, so that bars of one time have one order
        waiting = sorted(tuple(r) for r in self.held.get())
        millis = [int(pd.Timestamp(r[0]).timestamp() * 1000) for r in waiting]
        ready = [r for r, m in zip(waiting, millis) if m <= upto]
        later = [r for r, m in zip(waiting, millis) if m > upto]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if later:
            self.held.put(later)
            self.handle.registerTimer(millis[len(ready)])
        else:
            self.held.clear()
        if ready:
            s = dict(zip(_NUMBERS, self.seen.get())) if self.seen.exists() else {n: 0.0 if n in ("c0", "c1", "c2", "day") else None for n in _NUMBERS}
            out = [{"symbol": key[0], "ts": r[0], **step(s, r)} for r in ready]
            self.seen.update(tuple(s[n] for n in _NUMBERS))
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def streaming_kernels(bars: DataFrame, late: str = "1 hour") -> DataFrame:
    """Results (OUTPUT) of a stream of bars (symbol, ts TIMESTAMP, open, high, low, close, volume); start it within ``state_store``.

    Bars later than the watermark are dropped, as everywhere in streams.
    """
    marked = bars.select("symbol", "ts", "open", "high", "low", "close", "volume").withWatermark("ts", late)
    return marked.groupBy("symbol").transformWithStateInPandas(statefulProcessor=BarKernels(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
