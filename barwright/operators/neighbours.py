"""Mutual information of columns and a discrete label by nearest neighbours, over all rows.

The estimator of Ross (2014): a row's radius is the distance to its k-th nearest row of
the same label, and the information falls with the number of rows of any label that are
nearer than that. Where the radius is zero, the row stands on a heap of equal values; as for
mixtures of discrete and continuous values (Gao and others, 2017), its own label's share of the heap
takes the place of k. No noise is added, so the result is the same in every run.

Values are whole numbers of ``unit``, so that distances and ties are exact. Rows fold into one
row a value and label first. A column's values are cut into ranges of about equal numbers of rows,
and a task sorts one range: neighbours beyond its ends come from the k outermost values of the
next ranges that have any, and counts start at the sum of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import audit
from barwright.operators.labels import ORACLES as LABELS_SQL

NEIGHBOURS = 3
PARTS = 64
UNIT = 1e-9
EXACT = 16  # whole numbers below this have their digamma as a sum, the others by its series
EULER = 0.5772156649015329

_small = [sum(1 / j for j in range(1, n)) - EULER for n in range(1, EXACT)]
DIGAMMA = f"""CASE WHEN {{n}} < {EXACT} THEN element_at(array({", ".join(f"CAST({v!r} AS DOUBLE)" for v in _small)}), CAST({{n}} AS INT))
 ELSE ln({{n}}) - 1 / (2e0 * {{n}}) - 1 / (12e0 * {{n}} * {{n}}) + 1 / (120e0 * power({{n}}, 4)) - 1 / (252e0 * power({{n}}, 6)) + 1 / (240e0 * power({{n}}, 8)) END"""


def digamma(name: str) -> F.Column:
    """The digamma function of a column of whole numbers from 1."""
    return F.expr(DIGAMMA.format(n=f"CAST({name} AS DOUBLE)"))


def _in_ranges(values: DataFrame, cuts: DataFrame, at: str) -> DataFrame:
    """``values`` with ``part``, the range of its column that ``at`` is in; cuts are one row a column."""
    return values.join(cuts, "feature").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(at)))).drop("cuts")


def _radii(folded: DataFrame, cuts: DataFrame, k: int) -> DataFrame:
    """(feature, y, q, c, label_n, k, r): the distance from each value to its k-th nearest row of its label; labels of one row are left out.

    More than k + 1 rows of one value and label need no more copies: their radius is zero.
    """
    label = folded.groupBy("feature", "y").agg(F.sum("c").alias("label_n"))
    rows = _in_ranges(folded, cuts, "q").select("*", F.explode(F.sequence(F.lit(1), F.least("c", F.lit(k + 1)).cast("int"))).alias("copy"))
    near = Window.partitionBy("feature", "y", "part").orderBy("q", "copy")
    far = Window.partitionBy("feature", "y", "part").orderBy(F.desc("q"), F.desc("copy"))
    aside = F.array(*[f("q", j).over(near) for f in (F.lag, F.lead) for j in range(1, k + 1)])
    rows = rows.withColumns({"aside": aside, "low": F.row_number().over(near), "high": F.row_number().over(far)})
    ends = rows.where((F.col("low") <= k) | (F.col("high") <= k)).groupBy("feature", "y", "part")
    ends = ends.agg(*[F.collect_list(F.when(F.col(e) <= k, F.col("q"))).alias(e) for e in ("low", "high")])  # at most k of each
    order = Window.partitionBy("feature", "y").orderBy("part")  # at most as many rows as ranges
    beyond = lambda e, first, last: F.flatten(F.collect_list(e).over(order.rowsBetween(first, last)))
    ends = ends.select("feature", "y", "part", F.concat(beyond("high", -k, -1), beyond("low", 1, k)).alias("beyond"))
    rows = rows.where("copy = 1").join(ends, ["feature", "y", "part"]).join(label.where("label_n > 1"), ["feature", "y"])
    apart = F.array_sort(F.transform(F.filter(F.concat("aside", "beyond"), lambda v: v.isNotNull()), lambda v: F.abs(v - F.col("q"))))
    rows = rows.withColumn("k", F.least(F.lit(k), F.col("label_n") - 1).cast("int"))
    return rows.select("feature", "y", "q", "c", "label_n", "k", F.element_at(apart, F.col("k")).alias("r"))


def _counts(radii: DataFrame, cuts: DataFrame) -> DataFrame:
    """``radii`` with ``m``, the rows of any label nearer than ``r``, a value's own among them."""
    reach = F.greatest("r", F.lit(1))
    ask = lambda at, sign: F.struct(at.alias("at"), F.lit(0).cast("long").alias("n"), F.lit(sign).alias("sign"))
    asks = F.array(F.struct(F.col("q").alias("at"), F.col("c").alias("n"), F.lit(0).alias("sign")), ask(F.col("q") + reach - 1, 1), ask(F.col("q") - reach, -1))
    points = _in_ranges(radii.select("*", F.inline(asks)), cuts, "at")
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    starts = points.groupBy("feature", "part").agg(F.sum("n").alias("n")).select("feature", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = points.withColumn("upto", upto).where("sign <> 0").join(starts, ["feature", "part"])
    return found.groupBy("feature", "y", "q", "c", "label_n", "k", "r").agg(F.sum(F.col("sign") * (F.col("start") + F.col("upto"))).alias("m"))


def neighbour_information(frame: DataFrame, columns: list[str], label: str, k: int = NEIGHBOURS, unit: float = UNIT, parts: int = PARTS) -> DataFrame:
    """(feature, n, mi, rank): mutual information, in nats and never below zero, of each column and ``label``, best first in ``rank``.

    Rows without a value or a label take no part in a column, nor do labels that only one row has.
    Columns left without rows have none in the result. Values beyond 9e18 units are an error.
    """
    rows = audit._long(frame, columns, F.col(label).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    folded = rows.groupBy("feature", F.round(F.col("x") / unit).cast("long").alias("q"), "y").agg(F.count(F.lit(1)).alias("c"))
    shares = F.array(*[F.lit(j / parts) for j in range(1, parts)]) if parts > 1 else F.array(F.lit(1.0))
    cuts = rows.groupBy("feature").agg(F.array_distinct(F.percentile_approx(F.round(F.col("x") / unit).cast("long"), shares)).alias("cuts"))
    # approximate shares may differ when they are computed again: all steps take the same ones, at most ``parts`` a column
    cuts = frame.sparkSession.createDataFrame(cuts.collect(), "feature string, cuts array<long>")
    each = _counts(_radii(folded, cuts, k), cuts)
    each = each.withColumn("own", F.when(F.col("r") == 0, F.col("c")).otherwise(F.col("k")))
    gain = digamma("own") - digamma("m") - digamma("label_n")
    out = each.groupBy("feature").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * gain) / F.sum("c")).alias("gain"))
    out = out.select("feature", "n", F.round(F.greatest(F.col("gain") + digamma("n"), F.lit(0.0)), 6).alias("mi"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")))  # one row a column


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_information(audit._labelled(spark, sf_dir), audit.COLUMNS, "long_tp")


def _sql(k: int = NEIGHBOURS) -> str:
    psi = lambda n: DIGAMMA.format(n=f"CAST({n} AS DOUBLE)").replace("element_at(array(", "list_extract(list_value(")
    around = ", ".join(f"abs(q - {f}(q, {j}) OVER w)" for f in ("lag", "lead") for j in range(1, k + 1))
    return f"""
WITH f AS ({audit.FEATURES.sql()}), t AS ({LABELS_SQL["triple_barrier_vol"]}), j AS (SELECT f.*, t.long_tp AS y FROM f JOIN t ON t.symbol = f.symbol AND t.ts = f.ts), l AS ({audit._each("j", ", y")}),
v AS (SELECT feature, y, CAST(round(x / {UNIT!r}) AS BIGINT) AS q FROM l WHERE x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL),
a AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny, count(*) OVER (PARTITION BY feature, y, q) AS c, [{around}] AS d FROM v WINDOW w AS (PARTITION BY feature, y ORDER BY q)),
r AS (SELECT feature, q, ny, c, least({k}, ny - 1) AS k, list_extract(list_sort(d, 'ASC', 'NULLS LAST'), least({k}, ny - 1)) AS r FROM a WHERE ny > 1),
u AS (SELECT feature, q AS at, max(upto) AS upto FROM (SELECT feature, q, count(*) OVER (PARTITION BY feature ORDER BY q) AS upto FROM r) x GROUP BY ALL),
m AS (SELECT r.*, CASE WHEN r = 0 THEN c ELSE k END AS own, hi.upto - coalesce(lo.upto, 0) AS m FROM r
 ASOF LEFT JOIN u hi ON hi.feature = r.feature AND hi.at <= r.q + greatest(r.r, 1) - 1 ASOF LEFT JOIN u lo ON lo.feature = r.feature AND lo.at <= r.q - greatest(r.r, 1)),
g AS (SELECT feature, count(*) AS n, avg({psi("own")} - {psi("m")} - {psi("ny")}) AS gain FROM m GROUP BY feature),
h AS (SELECT feature, n, round(greatest(gain + {psi("n")}, 0), 6) AS mi FROM g)
SELECT *, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM h"""


QUERIES = {"audit_neighbour_information": _query}
ORACLES = {"audit_neighbour_information": _sql()}
