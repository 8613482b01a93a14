"""A plan is an input and steps of named expressions; Spark runs it as a DataFrame, and it can be written out as SQL."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.sources import CROSS, align, bars, bars_sql, pooled

NUMBER = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def spark_text(expr: str) -> str:
    expr = re.sub(r"@last\((.*?)\)(\(PARTITION.*?\))@", r"last_value(\1) IGNORE NULLS OVER \2", expr)
    expr = re.sub(r"@rint\((.*?)\)@", r"rint(\1)", expr).replace("@dow@", "weekday(ts)")
    expr = re.sub(r"@median\((.*?)\)(\(PARTITION.*?\))@", r"percentile(\1, 0.5) OVER \2", expr)
    expr = re.sub(r"@each\((\d+)\)@", r"explode(sequence(0, \1 - 1))", expr)
    return NUMBER.sub(r"\1e0", expr)


def duck_text(expr: str) -> str:
    expr = re.sub(r"@last\((.*?)\)(\(PARTITION.*?\))@", r"last_value(\1 IGNORE NULLS) OVER \2", expr)
    expr = re.sub(r"@rint\((.*?)\)@", r"round_even(\1, 0)", expr).replace("@dow@", "(isodow(ts) - 1)")
    expr = re.sub(r"@median\((.*?)\)(\(PARTITION.*?\))@", r"quantile_cont(\1, 0.5) OVER \2", expr)
    expr = re.sub(r"@each\((\d+)\)@", r"unnest(range(0, \1))", expr)
    return NUMBER.sub(r"\1e0", expr)


@dataclass
class Plan:
    """``out`` maps result names to expressions, rounded to ``digits`` unless ``raw``.

    The input is bars of all symbols, ``cross`` bars of the primary symbol beside
    the others', with ``pool`` bars of all events together, or another plan's
    result. With ``group`` the output is aggregated.
    """

    steps: list[dict[str, str]]
    out: dict[str, str]
    minutes: int = 15
    keys: tuple[str, ...] = ("symbol", "ts")
    where: str | None = None
    source: Plan | None = None
    group: bool = False
    cross: bool = False
    raw: bool = False
    pool: bool = False
    primary: str = "click"
    digits: int = 6

    def _final(self, expr: str) -> str:
        return expr if self.raw else f"round(CAST({expr} AS DOUBLE), {self.digits}) + 0.0"

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.select("*", *[F.expr(spark_text(e)).alias(a) for a, e in step.items()])
        if self.where:
            df = df.where(spark_text(self.where))
        cols = [F.expr(spark_text(self._final(e))).alias(a) for a, e in self.out.items()]
        return df.groupBy(*self.keys).agg(*cols) if self.group else df.select(*self.keys, *cols)

    def prefixed(self, prefix: str) -> tuple[list[dict[str, str]], dict[str, str]]:
        """The steps and results with a prefix to the steps' names, so that plans can share one table."""
        names = {a: f"{prefix}__{a}" for step in self.steps for a in step}
        pattern = re.compile(r"(?<![\w.])(" + "|".join(sorted(names, key=len, reverse=True)) + r")(?![\w(])") if names else None
        own = lambda e: pattern.sub(lambda m: names[m[1]], e) if pattern else e
        return [{names[a]: own(e) for a, e in step.items()} for step in self.steps], {a: own(e) for a, e in self.out.items()}

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.source is not None:
            return self.apply(self.source.run(spark, sf_dir))
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        frame = bars(pooled(events) if self.pool else events, self.minutes)
        if self.cross:
            frame = align(frame.where(F.col("symbol") == self.primary), {n: frame.where(F.col("symbol") == s) for n, s in CROSS.items()})
        return self.apply(frame)

    def sql(self, table: str | None = None) -> str:
        """The plan as SQL, over its own input or the query ``table``."""
        inner = f"({table}) b" if table else f"({self.source.sql() if self.source is not None else cross_sql(self.minutes, self.primary) if self.cross else bars_sql(self.minutes, self.pool)}) b"
        for k, step in enumerate(self.steps):
            cols = ", ".join(f"{duck_text(e)} AS {a}" for a, e in step.items())
            inner = f"(SELECT *, {cols} FROM {inner}) s{k}"
        where = f" WHERE {duck_text(self.where)}" if self.where else ""
        cols = ", ".join([*self.keys, *(f"{duck_text(self._final(e))} AS {a}" for a, e in self.out.items())])
        return f"SELECT {cols} FROM {inner}{where}" + (f" GROUP BY {', '.join(self.keys)}" if self.group else "")


def extend(df: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """``df`` with the results of all plans, not rounded, beside its own columns.

    The plans' first steps make one projection, their second ones the next: the
    depth is that of the longest plan, and windows alike share an exchange and a sort.
    """
    each = [p.prefixed(n) for n, p in plans.items()]
    for level in itertools.zip_longest(*[steps for steps, _ in each], fillvalue={}):
        df = df.select("*", *[F.expr(spark_text(e)).alias(a) for step in level for a, e in step.items()])
    made = {a for steps, _ in each for step in steps for a in step}
    return df.select(*[c for c in df.columns if c not in made], *[F.expr(spark_text(e)).alias(a) for _, out in each for a, e in out.items()])


def cross_sql(minutes: int, primary: str = "click", limit: int = 5) -> str:
    one = bars_sql(minutes)
    last = lambda n, c: f"last_value({n}.{c} IGNORE NULLS) OVER (ORDER BY p.ts ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW) AS {n}_{c}"
    cols = ", ".join([last(n, c) for n in CROSS for c in ("open", "high", "low", "close")] + [f"coalesce({n}.volume, 0) AS {n}_volume" for n in CROSS])
    joins = " ".join(f"LEFT JOIN (SELECT * FROM bb WHERE symbol = '{s}') {n} ON {n}.ts = p.ts" for n, s in CROSS.items())
    return f"WITH bb AS ({one}) SELECT p.*, {cols} FROM (SELECT * FROM bb WHERE symbol = '{primary}') p {joins}"
