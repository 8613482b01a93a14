"""Exponential averages as a scan over blocks: one symbol's history is work for many tasks.

An average carries one number from row to row, s = q * s + (1 - q) * x, and such maps
compose: a block of n values is s = q ** n * s + b. So blocks of at most BLOCK rows
within a period are summed where they lie, the maps of a symbol's blocks (one row for
up to BLOCK bars) are composed in order, and the state at each block's start is joined
back by period. Only the blocks' maps, not the bars, meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def ewm(frame: DataFrame, averages: dict[str, tuple[str, float]], period: str = "day", block: int = BLOCK, by: str = "symbol", order: str = "ts") -> DataFrame:
    """``frame`` with exponential averages {name: (column, span)}: 2 / (span + 1) of each value, from the first value on.

    Nulls neither change nor age an average; rows before the first value have none.
    ``order`` is unique within ``by``. Weights within a block stay in range of doubles
    for spans from 1 and blocks of up to a few hundred rows.
    """
    if not averages:
        return frame
    rate = {n: 1.0 - 2.0 / (span + 1.0) for n, (_, span) in averages.items()}
    day = Window.partitionBy(by, "__period").orderBy(order)
    rows = frame.withColumn("__period", F.date_trunc(period, order))
    rows = rows.withColumn("__block", ((F.row_number().over(day) - 1) / block).cast("int"))
    within = Window.partitionBy(by, "__period", "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = sorted({c for c, _ in averages.values()})
    rows = rows.select("*", *[F.count(c).over(within).alias(f"__n_{c}") for c in columns])
    # sum of (1 - q) * x / q ** n so far; times q ** n it is what the block adds up to a row
    weighted = lambda n: F.sum((1 - rate[n]) * F.col(averages[n][0]) * F.pow(F.lit(rate[n]), -F.col(f"__n_{averages[n][0]}")))
    live = [n for n in averages if rate[n]]
    rows = rows.select("*", *[weighted(n).over(within).alias(f"__b_{n}") for n in live])
    maps = rows.groupBy(by, "__period", "__block").agg(
        *[F.max(f"__n_{c}").alias(f"__n_{c}") for c in columns],
        *[F.max_by(f"__b_{n}", order).alias(f"__b_{n}") for n in live],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__f_{c}") for c in columns],
    )

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__period", "__block"], kind="stable")
        out = pdf[[by, "__period", "__block"]].copy()
        for n in live:
            c, q = averages[n][0], rate[n]
            size = pdf[f"__n_{c}"].to_numpy(float)
            scale, add, first = q**size, q**size * np.nan_to_num(pdf[f"__b_{n}"].to_numpy(float)), pdf[f"__f_{c}"].to_numpy(float)
            state, at = None, np.zeros(len(pdf))
            begun = np.zeros(len(pdf), bool)
            for k in range(len(pdf)):
                begun[k] = state is not None
                if state is None and size[k]:
                    state = first[k]  # so that the first average is the first value
                if state is not None:
                    at[k] = state
                    state = scale[k] * state + add[k]
            out[f"__s_{n}"], out[f"__before_{n}"] = at, begun
        return out

    kinds = {f.name: f.dataType.simpleString() for f in maps.schema}
    states = maps.groupBy(by).applyInPandas(carry, ", ".join(f"{c} {kinds[c]}" for c in (by, "__period", "__block")) + "".join(f", __s_{n} double, __before_{n} boolean" for n in live))
    # by period, as the rows are dealt already
    held = states.groupBy(by, "__period").agg(F.map_from_entries(F.collect_list(F.struct("__block", F.struct(*[c for n in live for c in (f"__s_{n}", f"__before_{n}")])))).alias("__states")) if live else None
    out = rows.join(held, [by, "__period"]) if live else rows
    state = F.col("__states")[F.col("__block")] if live else None

    def value(n: str):
        c, q = averages[n][0], rate.get(n)
        if not q:
            return F.last(c, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        s = state[f"__s_{n}"]
        begun = (F.col(f"__n_{c}") > 0) | state[f"__before_{n}"]
        return F.when(begun, F.pow(F.lit(q), F.col(f"__n_{c}")) * (s + F.coalesce(F.col(f"__b_{n}"), F.lit(0.0))))

    return out.select(*frame.columns, *[value(n).alias(n) for n in averages])
