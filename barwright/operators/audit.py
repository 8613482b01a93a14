"""Audits of feature columns: what is missing or constant, what repeats another column, what tells of a label.

Each is one pass of aggregates with partial sums, so only a few rows a feature are
shuffled. Nulls and NaN count as missing, take no part in a correlation, and are a bin of
their own in the mutual information. An empty frame gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators.families import PRIMITIVES
from barwright.operators.labels import ORACLES as LABELS_SQL
from barwright.operators.labels import QUERIES as LABELS

# The correlations from which a pair counts as redundant, and the deviation of a constant column.
REDUNDANT = (0.8, 0.9, 0.95)
CONSTANT = 1e-6
#: Bins of half a standard deviation, three deviations to either side; the outermost are open.
BINS = 6
MISSING_BIN = -99

FEATURES = PRIMITIVES["price_block_tf15"]
COLUMNS = list(FEATURES.out)


def _known(column: str) -> F.Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _long(frame: DataFrame, columns: list[str], *others: str) -> DataFrame:
    named = F.array(*[F.struct(F.lit(c).alias("feature"), _known(c).alias("x")) for c in columns])
    return frame.select(*others, F.inline(named))


def column_audit(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: counts, mean, deviation, range, and whether it is all missing, all zero or constant."""
    out = _long(frame, columns).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x").isNull()).alias("missing"),
        F.count_if(F.col("x") == 0).alias("zeros"),
        *[F.round(f("x"), 6).alias(a) for f, a in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "lo"), (F.max, "hi"))],
    )
    known = F.col("n") - F.col("missing")
    return out.withColumns({
        "all_missing": (known == 0).cast("int"),
        "all_zero": ((known > 0) & (F.col("zeros") == known)).cast("int"),
        "constant": F.coalesce(F.col("std") < CONSTANT, F.lit(True)).cast("int"),
    })


def redundancy(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's correlation of each pair of columns, and how many of the limits REDUNDANT it exceeds.

    One aggregate a pair in a single pass; hundreds of columns are better audited family by family.
    """
    pairs = list(combinations(columns, 2))
    sums = frame.agg(F.count(F.lit(1)).alias("n"), *[F.corr(_known(a), _known(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).where("n > 0")
    rows = F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), F.round(F.col(f"c{k}"), 6).alias("corr")) for k, (a, b) in enumerate(pairs)])
    passed = sum((F.coalesce(F.abs("corr") > x, F.lit(False)).cast("int") for x in REDUNDANT), F.lit(0))
    return sums.select(F.inline(rows)).withColumn("limits_passed", passed)


def mutual_information(frame: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Mutual information, in nats, of each binned column and a discrete label, best first in ``rank``; constant columns tell nothing."""
    rows = _long(frame, columns, F.col(label).alias("y"))
    scale = rows.groupBy("feature").agg(F.round(F.avg("x"), 6).alias("m"), F.round(F.stddev_samp("x"), 6).alias("s"))
    z = F.floor((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)) * 2)
    binned = rows.join(F.broadcast(scale), "feature")  # one row a column
    binned = binned.select("feature", "y", F.when(z.isNull(), MISSING_BIN).otherwise(F.least(F.greatest(z, F.lit(-BINS)), F.lit(BINS - 1))).alias("bin"))
    cells = binned.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    share = lambda *by: F.sum("c").over(Window.partitionBy("feature", *by))
    cells = cells.select("feature", "c", share().alias("n"), share("bin").alias("nb"), share("y").alias("ny"))
    out = cells.groupBy("feature").agg(F.round(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("nb") * F.col("ny")))), 6).alias("mi"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")))  # one row a column


# Shares of a column's values.
SHARES = {"p05": 0.05, "median": 0.5, "p95": 0.95}


def column_quantiles(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_distinct, p05, median, p95) of known values, linear between neighbours.

    Values fold into counts first, so a task orders the distinct values of one column.
    """
    each = _long(frame, columns).where("x IS NOT NULL").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy("feature").orderBy("x")
    each = each.select("feature", "x", "c", F.sum("c").over(along).alias("upto"), F.sum("c").over(Window.partitionBy("feature")).alias("n"))
    pos = lambda q: (F.col("n") - 1) * q
    at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.col("x")))
    ends = [e.alias(f"{n}_{s}") for n, q in SHARES.items() for s, e in (("lo", at(F.floor(pos(q)))), ("hi", at(F.ceil(pos(q)))))]
    out = each.groupBy("feature").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), *ends)
    return out.select("feature", "n", "n_distinct", *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (pos(q) - F.floor(pos(q)))).alias(n) for n, q in SHARES.items()])


def group_scores(scores: DataFrame, groups: dict[str, str]) -> DataFrame:
    """(group, n_cols, mean_mi, median_mi, max_mi, sum_mi, share, top_feature) of ``mutual_information`` by a column's time frame or family; other columns are a group of their own."""
    known = F.coalesce(*[F.when(F.col("feature") == c, F.lit(g)) for c, g in groups.items()], F.lit("other"))
    all_ = F.sum("sum_mi").over(Window.partitionBy())  # one row a group
    out = scores.withColumn("group", known).groupBy("group").agg(
        F.count(F.lit(1)).alias("n_cols"), F.avg("mi").alias("mean_mi"), F.median("mi").alias("median_mi"), F.max("mi").alias("max_mi"), F.sum("mi").alias("sum_mi"), F.min_by("feature", "rank").alias("top_feature")
    )
    return out.withColumn("share", F.try_divide("sum_mi", all_))


def timeframe_groups(columns: list[str]) -> dict[str, str]:
    """The time frame of each column of ``features.price_features``."""
    return {c: c.split("_")[0] for c in columns if c.startswith("tf") and c[2 : c.find("_")].isdigit()}


def probes(table: DataFrame, ordered: list[str], labels: list[str], drop: int = 50, tops: tuple[int, ...] = (50, 30, 20), trials: int = 5, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """(probe, label, n_cols, auc): how well linear models on parts of the columns, best first, tell the labels of the last ``holdout`` of the rows.

    Parts: all columns, all but the worst ``drop``, the best few, and ``trials`` times nine tenths drawn at random. Columns are
    scaled by the earlier rows. The fits run over partitions; the driver sees coefficients and areas.
    """
    import random

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from barwright.operators import order, training

    rng = random.Random(seed)
    parts = {"all": ordered} | ({f"without_last_{drop}": ordered[:-drop]} if len(ordered) > drop else {}) | {f"best_{k}": ordered[:k] for k in tops if k < len(ordered)}
    parts |= {f"dropout_{t}": sorted(rng.sample(ordered, max(1, int(len(ordered) * 0.9))), key=ordered.index) for t in range(trials)}
    known = table.select("ts", *ordered, *labels).na.drop("any")
    cut = training.tail_start(known, holdout)
    out = []
    if cut is not None:
        scaled = VectorAssembler(inputCols=ordered, outputCol="v").transform(known)
        early = scaled.where(F.col("ts") < F.lit(cut))
        if early.limit(1).count():
            scaled = StandardScaler(inputCol="v", outputCol="x", withMean=True).fit(early).transform(scaled).withColumn("x", vector_to_array("x")).select("ts", "x", *labels).persist()
            try:
                for name, columns in parts.items():
                    at = VectorAssembler(inputCols=[f"c{ordered.index(c)}" for c in columns], outputCol="given")
                    own = at.transform(scaled.select("ts", *labels, *[F.col("x")[ordered.index(c)].alias(f"c{ordered.index(c)}") for c in columns]))
                    for y in labels:
                        model = LogisticRegression(featuresCol="given", labelCol=y, regParam=1e-3, standardization=False, maxIter=100).fit(own.where(F.col("ts") < F.lit(cut)))
                        late = model.transform(own.where(F.col("ts") >= F.lit(cut))).select(vector_to_array("probability")[1].alias("p"), y)
                        out.append((name, y, len(columns), order.rank_metrics(late, "p", y).first()["auc"]))
            finally:
                scaled.unpersist()
    return table.sparkSession.createDataFrame(out, "probe string, label string, n_cols int, auc double")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FEATURES.run(spark, sf_dir)


def _rounded(out: DataFrame, digits: int = 9) -> DataFrame:
    return out.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


GROUPS = {"logret": "returns", "vnret": "returns", "body": "shape", "uwick": "shape", "lwick": "shape", "rangepct": "range", "rangez": "range", "rsi14": "rsi", "rsi5": "rsi"}


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).join(LABELS["triple_barrier_vol"](spark, sf_dir).select("symbol", "ts", "long_tp"), ["symbol", "ts"])


QUERIES = {
    "audit_columns": lambda spark, sf_dir: column_audit(_features(spark, sf_dir), COLUMNS),
    "audit_redundancy": lambda spark, sf_dir: redundancy(_features(spark, sf_dir), COLUMNS),
    "audit_quantiles": lambda spark, sf_dir: _rounded(column_quantiles(_features(spark, sf_dir), COLUMNS)),
    "audit_groups": lambda spark, sf_dir: _rounded(group_scores(mutual_information(_labelled(spark, sf_dir), COLUMNS, "long_tp"), GROUPS)),
    "audit_probes": lambda spark, sf_dir: probes(_labelled(spark, sf_dir), COLUMNS, ["long_tp"], drop=5, tops=(3,), trials=2),
    "audit_mutual_information": lambda spark, sf_dir: mutual_information(_labelled(spark, sf_dir), COLUMNS, "long_tp"),
}

_each = lambda source, others="": " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x{others} FROM {source}" for c in COLUMNS)
_corr = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}), 6) AS corr FROM f" for a, b in combinations(COLUMNS, 2))
_passed = " + ".join(f"CAST(abs(corr) > {x} AS INT)" for x in REDUNDANT)
ORACLES = {
    "audit_columns": f"""
WITH f AS ({FEATURES.sql()}), l AS ({_each("f")}),
a AS (SELECT feature, count(*) AS n, count(*) FILTER (x IS NULL OR isnan(x)) AS missing, count(*) FILTER (x = 0) AS zeros, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM l GROUP BY feature)
SELECT *, CAST(n = missing AS INT) AS all_missing, CAST(n > missing AND zeros = n - missing AS INT) AS all_zero, CAST(coalesce(std < {CONSTANT}, true) AS INT) AS constant FROM a""",
    "audit_redundancy": f"WITH f AS ({FEATURES.sql()}), c AS ({_corr}) SELECT *, coalesce({_passed}, 0) AS limits_passed FROM c",
    "audit_mutual_information": f"""
WITH f AS ({FEATURES.sql()}), t AS ({LABELS_SQL["triple_barrier_vol"]}), j AS (SELECT f.*, t.long_tp AS y FROM f JOIN t ON t.symbol = f.symbol AND t.ts = f.ts), l AS ({_each("j", ", y")}),
s AS (SELECT feature, round(avg(x), 6) AS m, round(stddev_samp(x), 6) AS s FROM l GROUP BY feature),
b AS (SELECT l.feature, y, CASE WHEN x IS NULL OR m IS NULL OR s IS NULL OR s = 0 THEN {MISSING_BIN} ELSE least(greatest(floor((x - m) / s * 2), -{BINS}), {BINS - 1}) END AS bin FROM l JOIN s ON s.feature = l.feature),
c AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS c FROM b GROUP BY ALL),
w AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nb, sum(c) OVER (PARTITION BY feature, y) AS ny FROM c),
g AS (SELECT feature, round(sum(c / n * ln(c * n / (nb * ny))), 6) AS mi FROM w GROUP BY feature)
SELECT *, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM g""",
}
_group = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in GROUPS.items()) + " ELSE 'other' END"
ORACLES |= {
    "audit_quantiles": f"""WITH f AS ({FEATURES.sql()}), l AS ({_each("f")})
SELECT feature, count(x) AS n, count(DISTINCT x) AS n_distinct, {", ".join(f"round(quantile_cont(x, {q}), 9) + 0.0 AS {n}" for n, q in SHARES.items())} FROM l WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY feature""",
    "audit_groups": f"""WITH m AS ({ORACLES["audit_mutual_information"]}), g AS (SELECT {_group} AS "group", count(*) AS n_cols, avg(mi) AS mean_mi, median(mi) AS median_mi, max(mi) AS max_mi, sum(mi) AS sum_mi, arg_min(feature, rank) AS top_feature FROM m GROUP BY 1)
SELECT "group", n_cols, round(mean_mi, 9) AS mean_mi, round(median_mi, 9) AS median_mi, round(max_mi, 9) AS max_mi, round(sum_mi, 9) AS sum_mi, top_feature, round(sum_mi / sum(sum_mi) OVER (), 9) AS share FROM g""",
}
