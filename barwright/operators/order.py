"""Order over all rows without a task that sees them all: exact selection, running sums along a value, and metrics of ranks.

Rows fold into one row a distinct value first, so ties, however many, are one row.
Values are cut into ranges of about equal numbers of rows; a range's sums start where
the ranges before it end. Only ranges, at most PARTS of them, are ever broadcast.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barwright.operators import evaluation
from barwright.plans import duck_text
from barwright.sources import bars, bars_sql

PARTS = 256
GRID = 1024  # cells of one round of a selection
FEW = 4096  # distinct values that a selection may fetch


def kth_values(table: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 1) in rising order of a column's non-null values, exactly.

    Each round counts the cells of a grid over the range that still holds the rank and
    keeps one cell, until it has at most FEW distinct values; the driver sees counts only.
    """
    known = table.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    out = {}
    for rank in sorted(set(ranks)):
        if not 1 <= rank <= size["n"]:
            raise ValueError(f"rank {rank} of {size['n']} values")
        lo, hi, before = size["lo"], size["hi"], 0
        while True:
            inside = known.where((F.col("x") >= lo) & (F.col("x") <= hi))
            width = (hi - lo) / GRID
            if width <= 0 or lo + width == lo:
                few = inside.groupBy("x").count().orderBy("x").collect()  # neighbours among floating-point numbers
                break
            cell = F.least(F.floor((F.col("x") - lo) / width), F.lit(GRID - 1)).cast("int")
            cells = inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # at most GRID rows
            for c in sorted(cells, key=lambda c: c["c"]):
                if before + c["n"] >= rank:
                    break
                before += c["n"]
            lo, hi = c["lo"], c["hi"]
            if lo == hi:
                few = [{"x": lo, "count": c["n"]}]
                break
            if c["n"] <= FEW:
                few = known.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").count().orderBy("x").collect()
                break
        for r in few:
            before += r["count"]
            if before >= rank:
                out[rank] = r["x"]
                break
    return [out[r] for r in ranks]


def running_sums(table: DataFrame, key: str, values: list[str], parts: int = PARTS) -> DataFrame:
    """``table`` (one row a value of ``key``) with ``before_`` sums of ``values`` over all rows with a smaller key."""
    key_ = table.withColumn("__key", F.col(key).cast("double"))
    cuts = sorted(set(key_.approxQuantile("__key", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__key", outputCol="__range").transform(key_) if cuts else key_.withColumn("__range", F.lit(0.0))
    totals = cut.groupBy("__range").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__t_{v}").over(upto), F.lit(0)).alias(f"__s_{v}") for v in values])
    within = Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(starts), "__range")
    return out.select(*table.columns, *[(F.col(f"__s_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"before_{v}") for v in values])


def ranked(table: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): the mean rank from 1 of every distinct value of ``column``."""
    each = table.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(each, "value", ["n"]).select("value", "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def rank_metrics(table: DataFrame, prob: str, label: str) -> DataFrame:
    """One row: n, positives, auc and average precision of ``prob`` against 0/1 ``label`` over all rows together."""
    known = table.select(F.col(prob).cast("double").alias("p"), F.col(label).cast("long").alias("y")).where("p IS NOT NULL AND y IS NOT NULL")
    each = known.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    size = each.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("n")).first()
    n, pos = F.lit(size["n"]), F.lit(size["pos"])
    at = running_sums(each, "p", ["pos", "neg"])
    taken = n - F.col("before_pos") - F.col("before_neg")  # rows with this value or a larger one
    area = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    precision = F.sum(F.col("pos") * (pos - F.col("before_pos")) / taken)
    return at.agg(F.try_divide(area, pos * (n - pos)).alias("auc"), F.try_divide(precision, pos).alias("average_precision")).select(n.alias("n"), pos.alias("positives"), "auc", "average_precision")


def spearman(table: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the correlation of the mean ranks of ``a`` and ``b`` over all rows; null below 30 rows."""
    pair = table.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ra, rb = (ranked(pair, c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c in ("a", "b"))
    both = pairs.join(ra, "a").join(rb, "b")
    n = F.sum("n")
    mean = (n + 1) / 2
    s = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y)) - n * mean * mean
    return both.agg(F.coalesce(n, F.lit(0)).alias("n"), F.when(n >= 30, F.try_divide(s("ra", "rb"), F.sqrt(s("ra", "ra") * s("rb", "rb")))).alias("ic"))


def top_share(table: DataFrame, prob: str, label: str, share: float) -> DataFrame:
    """One row: the threshold that the best ``share`` of all rows reach, the rows at or above it (ties included), and their win rate."""
    n = table.where(F.col(prob).isNotNull()).count()
    if not n:
        return table.sparkSession.createDataFrame([], "threshold double, taken long, win_rate double")
    rank = n - max(1, -(-int(n * share * 1e9) // 10**9)) + 1
    at = kth_values(table, prob, [max(1, rank)])[0]
    return table.where(F.col(prob) >= at).agg(F.lit(at).alias("threshold"), F.count(F.lit(1)).alias("taken"), F.avg(F.col(label).cast("double")).alias("win_rate"))


RADIX = 16


BLOCK_ROWS = 1 << 17  # rows of a block of one history, at least


class Counts:
    """How often each code was seen, as a binary indexed tree that doubles as codes grow: both steps cost as many additions as codes have bits."""

    def __init__(self) -> None:
        self.tree, self.values, self.n = array("q", [0, 0]), array("d", [0.0]), 0

    def add(self, code: int, value: float, times: int = 1) -> None:
        size = len(self.values)
        while code >= size:
            self.tree.frombytes(bytes(8 * size))
            self.values.frombytes(bytes(8 * size))
            size *= 2
            self.tree[size] = self.n
        self.values[code] = value
        self.n += times
        at = code + 1
        while at <= size:
            self.tree[at] += times
            at += at & -at

    def kth(self, k: int) -> float:
        """The value at rank ``k`` (from 0)."""
        at, step = 0, len(self.values)
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= k:
                at += step
                k -= self.tree[at]
            step >>= 1
        return self.values[at]


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the columns of ``b`` for equal keys, nulls included; rows without a partner stay."""
    own = b.withColumnsRenamed({k: f"{k}_b" for k in keys})
    return a.join(own, functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys]), "left").drop(*[f"{k}_b" for k in keys])


def expanding_quantile(table: DataFrame, column: str, share: float = 0.5, least: int = 1, by: str = "symbol", order: str = "ts", period: str = "day", block: int = BLOCK_ROWS) -> DataFrame:
    """``table`` with ``quantile`` of ``column`` over all rows of ``by`` before each one (linear between neighbours); null below ``least`` values.

    A history is cut at ends of periods into blocks of about ``block`` rows, or as many as it has
    distinct values if those are more. Each block starts with the number of times that each value
    came before it, and is then walked in order with a tree of counts: a task
    holds one block and its counts, and what is counted for all blocks is no more rows than the table has.
    """
    keyed = table.select(F.struct("*").alias("__row"), F.col(by).alias("__by"), F.col(order).alias("__at"), F.date_trunc(period, order).alias("__period"), F.col(column).cast("double").alias("__x"))
    codes = keyed.where("__x IS NOT NULL").select("__by", "__x").distinct()
    codes = codes.withColumn("__code", (F.row_number().over(Window.partitionBy("__by").orderBy("__x")) - 1).cast("long"))
    size = codes.groupBy("__by").agg(F.greatest(F.count(F.lit(1)), F.lit(block)).alias("__size"))
    along = Window.partitionBy("__by").orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)  # the periods of one history
    spans = keyed.groupBy("__by", "__period").agg(F.count(F.lit(1)).alias("__n")).join(size, "__by", "left")
    spans = spans.select("__by", "__period", F.floor(F.coalesce(F.sum("__n").over(along), F.lit(0)) / F.coalesce("__size", F.lit(block))).cast("int").alias("__block"))
    coded = _beside(_beside(keyed, spans, ["__by", "__period"]), codes, ["__by", "__x"])
    # what each block sees of the blocks before it: a row for each of its values and later blocks
    seen = coded.where("__code IS NOT NULL").groupBy("__by", "__code", "__block").agg(F.first("__x").alias("__x"), F.count(F.lit(1)).alias("__times"))
    later = spans.select("__by", F.col("__block").alias("__to")).distinct()
    starts = _beside(seen, later, ["__by"]).where("__to > __block").groupBy("__by", "__code", F.col("__to").alias("__block")).agg(F.first("__x").alias("__x"), F.sum("__times").alias("__times"))
    none = lambda c: F.lit(None).cast(keyed.schema[c].dataType).alias(c)
    rows = coded.select("__by", "__block", "__at", "__code", "__x", F.lit(None).cast("long").alias("__times"), "__row")
    rows = rows.unionByName(starts.select("__by", "__block", none("__at"), "__code", "__x", "__times", none("__row")))

    names = [*table.columns, "quantile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts = None
        for batch in batches:
            own, out = [], []
            kinds = zip(*(batch.column(c).to_pylist() for c in ("__by", "__block", "__code", "__x", "__times")))
            for k, (name, part, code, x, times) in enumerate(kinds):
                if counts is None or (name, part) != held:
                    held, counts = (name, part), Counts()
                if times is not None:
                    counts.add(code, x, times)
                    continue
                value = None
                if counts.n >= max(1, least):
                    pos = (counts.n - 1) * share
                    lo = math.floor(pos)
                    low = counts.kth(lo)
                    value = low + (counts.kth(math.ceil(pos)) - low) * (pos - lo)
                own.append(k)
                out.append(value)
                if code is not None:
                    counts.add(code, x)
            given = batch.column("__row").take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*given.flatten(), pa.array(out, pa.float64())], names=names)

    dealt = rows.repartition("__by", "__block").sortWithinPartitions("__by", "__block", F.col("__times").isNull(), "__at")
    return dealt.mapInArrow(run, StructType([*table.schema.fields, StructField("quantile", DoubleType())]))


def rolling_rank(table: DataFrame, column: str, rows: int, least: int = 1, by: str = "symbol", order: str = "ts") -> DataFrame:
    """``table`` with ``rank``: the share of the last ``rows`` rows' values that lie below the row's own, ties as their mean rank; null below ``least`` values or for null.

    The same descent as ``expanding_quantile``: at each digit of its own value's code a row
    counts the smaller next digits up to itself, and up to the row before its window; the
    difference is what the window holds. A row costs as many steps as codes have digits.
    """
    keyed = table.select(by, order, F.col(column).cast("double").alias("x"))
    keyed = keyed.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long"))
    codes = keyed.where("x IS NOT NULL").select(by, "x").distinct()
    codes = codes.withColumn("code", (F.row_number().over(Window.partitionBy(by).orderBy("x")) - 1).cast("long"))
    largest = codes.agg(F.max("code")).first()[0]
    digits = 1
    while largest is not None and RADIX**digits <= largest:
        digits += 1
    frame = Window.partitionBy(by).orderBy(order).rowsBetween(1 - rows, 0)
    coded = keyed.join(codes, [by, "x"], "left").withColumn("n", F.count("code").over(frame))
    have = coded.where("code IS NOT NULL").select(by, "rn", "code")
    # each row asks twice: up to itself (+1), and up to the row before its window (-1)
    asks = have.select(by, F.col("rn").alias("own"), "code", F.explode(F.array(F.struct(F.col("rn").alias("upto"), F.lit(1).alias("sign")), F.struct((F.col("rn") - rows).alias("upto"), F.lit(-1).alias("sign")))).alias("q")).select(by, "own", "code", "q.*").where("upto > 0")
    parts = []
    for d in range(digits):
        unit = RADIX**d
        at, digit = F.expr(f"code DIV {unit * RADIX}"), F.expr(f"(code DIV {unit}) % {RADIX}")
        values = have.select(by, at.alias("at"), F.col("rn").alias("upto"), digit.alias("digit"), F.lit(None).cast("long").alias("own"), F.lit(0).alias("sign"))
        both = values.unionByName(asks.select(by, at.alias("at"), "upto", digit.alias("digit"), "own", "sign"))
        upto = Window.partitionBy(by, "at").orderBy("upto").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        count = lambda c, more=None: F.count(F.when((F.col("sign") == 0) & (F.col("digit") == c), 1)).over(upto)  # noqa: B023, E731
        below = sum((F.when(F.col("digit") > c, count(c)).otherwise(0) for c in range(RADIX - 1)), F.lit(0))
        same = sum((F.when(F.col("digit") == c, count(c)).otherwise(0) for c in range(RADIX)), F.lit(0)) if d == 0 else F.lit(0)
        seen = both.select(by, "own", "sign", below.alias("below"), same.alias("same")).where("sign <> 0")
        parts.append(seen)
    sums = functools.reduce(DataFrame.unionByName, parts).groupBy(by, F.col("own").alias("rn")).agg(F.sum(F.col("sign") * F.col("below")).alias("below"), F.sum(F.col("sign") * F.col("same")).alias("same"))
    share = (F.col("below") + (F.col("same") + 1) / 2) / F.col("n")
    found = coded.join(sums, [by, "rn"], "left").select(by, order, F.when((F.col("n") >= max(1, least)) & F.col("code").isNotNull(), share).alias("rank"))
    return table.join(found, [by, order])


def _demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo's predictions of all symbols."""
    return evaluation.with_demo(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15))


def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, value) over all symbols together."""
    demo = _demo(spark, sf_dir)
    parts = [rank_metrics(demo, "pl", "y"), spearman(demo, "pl", "target_return").select("ic"), top_share(demo, "pl", "y", 0.1)]
    long = lambda t: t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), (F.round(F.col(c).cast("double"), 9) + 0.0).alias("value")) for c in t.columns])).alias("m")).select("m.*")
    return functools.reduce(DataFrame.unionByName, map(long, parts))


def _demo_sql() -> str:
    inner = f"SELECT *, {', '.join(f'{duck_text(e)} AS {a}' for a, e in evaluation.PREDS[0].items())} FROM ({bars_sql(15)}) b"
    return f"SELECT *, {', '.join(f'{duck_text(e)} AS {a}' for a, e in evaluation.PREDS[1].items())} FROM ({inner}) c"


GLOBAL_SQL = f"""WITH d AS (SELECT *, rank() OVER (ORDER BY pl) + (count(*) OVER (PARTITION BY pl) - 1) / 2e0 AS ra, rank() OVER (ORDER BY target_return) + (count(*) OVER (PARTITION BY target_return) - 1) / 2e0 AS rb,
 sum(y) OVER (ORDER BY pl DESC) AS tp, count(*) OVER (ORDER BY pl DESC) AS k FROM ({_demo_sql()}) x),
t AS (SELECT min(pl) AS threshold FROM (SELECT pl FROM d ORDER BY pl DESC LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM d)) z),
m AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((sum(ra * y) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))), 9) AS auc, round(sum(y * tp / (k * 1e0)) / sum(y), 9) AS average_precision,
 round(corr(ra, rb), 9) AS ic, max(threshold) AS threshold, count(*) FILTER (WHERE pl >= threshold) AS taken, round(avg(y) FILTER (WHERE pl >= threshold), 9) AS win_rate FROM d, t)
SELECT unnest(['n', 'positives', 'auc', 'average_precision', 'ic', 'threshold', 'taken', 'win_rate']) AS metric, unnest([CAST(n AS DOUBLE), positives, auc, average_precision, ic, threshold, taken, win_rate]) AS value FROM m"""


def median_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median volume of all earlier bars of a symbol, from 200 on, of minute bars."""
    out = expanding_quantile(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 1).select("symbol", "ts", "close"), "close", 0.5, 200)
    return out.select("symbol", "ts", F.round("quantile", 9).alias("median_close"))


MEDIAN_SQL = f"""SELECT symbol, ts, CASE WHEN count(close) OVER w >= 200 THEN round(median(close) OVER w, 9) END AS median_close FROM ({bars_sql(1)}) b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

RANK_ROWS, RANK_LEAST = 480, 60


def rank_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each bar's range lies among those of the symbol's last bars."""
    frame = bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15).select("symbol", "ts", F.floor((F.col("high") - F.col("low")) * 8).alias("range"))
    return rolling_rank(frame, "range", RANK_ROWS, RANK_LEAST).select("symbol", "ts", F.round("rank", 9).alias("rank"))


RANK_SQL = f"""WITH b AS (SELECT symbol, ts, floor((high - low) * 8) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars_sql(15)}) b)
SELECT a.symbol, a.ts, CASE WHEN count(c.x) >= {RANK_LEAST} THEN round((count(*) FILTER (WHERE c.x < a.x) + (count(*) FILTER (WHERE c.x = a.x) + 1) / 2e0) / count(c.x), 9) END AS rank
FROM b a JOIN b c ON c.symbol = a.symbol AND c.rn BETWEEN a.rn - {RANK_ROWS - 1} AND a.rn GROUP BY ALL"""

QUERIES = {"rolling_rank_range": rank_volume, "global_rank_metrics": global_ranks, "expanding_median_close": median_volume}
ORACLES = {"rolling_rank_range": RANK_SQL, "global_rank_metrics": GLOBAL_SQL, "expanding_median_close": MEDIAN_SQL}
