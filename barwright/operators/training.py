"""Models on Spark: the second layer with a calibrated tail, the first layer's heads over purged folds, embeddings of windows.

Fits are ``pyspark.ml`` fits over partitioned rows; what reaches the driver is bounded
by columns, folds and calibration steps, never by rows. Networks that need a GPU have
substitutes of the same role: a small perceptron for the second layer, linear heads on
one Gram matrix and logistic heads for the first, the main components of windows for
the encoder.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import BY
from barwright.operators import dataset, evaluation, families, features, labels, order
from barwright.plans import Plan, duck_text, spark_text
from barwright.sources import bars, bars_sql

# The calibration share and miscoverage of the second layer, its hidden units, bounds of calibrated probabilities, the trade threshold, the share of candidates.
TAIL, ALPHA, HIDDEN, LOWEST, THRESHOLD, CANDIDATES = 0.15, 0.10, (64, 64, 32), 1e-4, 0.55, 0.20
LEAST_TAIL = 50


# the second layer


class Probability(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The second entry of a vector of class probabilities, or a number, held within bounds."""

    lowest = Param(Params._dummy(), "lowest", "distance to 0 and 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, lowest: float = 0.0):
        super().__init__()
        self._setDefault(lowest=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        given = self.getInputCol()
        p = F.col(given) if df.schema[given].dataType.typeName() == "double" else vector_to_array(given)[1]
        low = self.getOrDefault(self.lowest)
        return df.withColumn(self.getOutputCol(), F.least(F.greatest(p, F.lit(low)), F.lit(1 - low)))


class ConformalGate(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the interval ``lower``, ``upper`` of a probability and whether to ``trade``: its lower end reaches the threshold."""

    q = Param(Params._dummy(), "q", "half width of the interval", TypeConverters.toFloat)
    threshold = Param(Params._dummy(), "threshold", "least lower end of a trade", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, q: float = 0.0, threshold: float = THRESHOLD):
        super().__init__()
        self._setDefault(q=0.0, threshold=THRESHOLD)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p, q = F.col(self.getInputCol()), self.getOrDefault(self.q)
        df = df.withColumns({"lower": F.greatest(p - q, F.lit(0.0)), "upper": F.least(p + q, F.lit(1.0))})
        return df.withColumn("trade", F.col("lower") >= self.getOrDefault(self.threshold))


def tail_start(table: DataFrame, share: float, time: str = "ts"):
    """The time from which the last ``share`` of the rows begin, at most: counts of days first, then those within one day."""
    n = table.count()
    left = int(n * share)
    days = table.groupBy(F.date_trunc("day", time).alias("day")).count().orderBy(F.desc("day")).collect()  # one row a day
    for d in days:
        if d["count"] > left:
            break
        left -= d["count"]
    else:
        return None
    start = d["day"] + pd.Timedelta(days=1)
    for r in table.where(F.date_trunc("day", time) == F.lit(d["day"])).groupBy(time).count().orderBy(F.desc(time)).collect():  # the times of a day
        if r["count"] > left:
            return start
        left -= r["count"]
        start = r[time]
    return start


class TailCalibrated(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``base`` (up to a vector column ``probability``) on the earlier rows and calibrates it on the last ones.

    ``fit`` gives a PipelineModel, to be saved and loaded like any other: the base model,
    ``raw_prob``, an isotonic ``prob`` fitted on the tail, and the conformal gate, whose
    width is the exact order statistic of the tail's errors.
    """

    tail = Param(Params._dummy(), "tail", "share of the rows to calibrate on", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "share of errors beyond the interval", TypeConverters.toFloat)
    timeCol = Param(Params._dummy(), "timeCol", "the column to cut by", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", tail: float = TAIL, alpha: float = ALPHA, timeCol: str = "ts"):
        super().__init__()
        self.base: Estimator | None = None
        self._setDefault(tail=TAIL, alpha=ALPHA, timeCol="ts")
        self._set(**self._input_kwargs)

    def setBase(self, base: Estimator) -> TailCalibrated:
        self.base = base
        return self

    def _fit(self, df: DataFrame) -> PipelineModel:
        if self.base is None:
            raise ValueError("no base estimator")
        time, label = self.getOrDefault(self.timeCol), self.getLabelCol()
        cut = tail_start(df, self.getOrDefault(self.tail), time)
        early, late = (df.where(F.col(time) < F.lit(cut)), df.where(F.col(time) >= F.lit(cut))) if cut is not None else (df, df.limit(0))
        raw = Pipeline(stages=[self.base, Probability(inputCol="probability", outputCol="raw_prob")]).fit(early)
        scored = raw.transform(late).select("raw_prob", F.col(label).cast("double").alias(label)).cache()
        try:
            n = scored.count()
            if n < LEAST_TAIL:
                raise ValueError(f"{n} rows are too few to calibrate on; {LEAST_TAIL} are needed")
            steps = IsotonicRegression(featuresCol="raw_prob", labelCol=label, predictionCol="step").fit(scored)
            held = Probability(inputCol="step", outputCol="prob", lowest=LOWEST)
            errors = held.transform(steps.transform(scored)).select(F.abs(F.col("prob") - F.col(label)).alias("e"))
            level = min(-(-(n + 1) * (1 - self.getOrDefault(self.alpha)) // 1) / n, 1.0)
            rank = 1 + int(np.ceil(round((n - 1) * level, 9)))
            gate = ConformalGate(inputCol="prob", q=order.kth_values(errors, "e", [min(n, rank)])[0])
        finally:
            scored.unpersist()
        return PipelineModel(stages=[*raw.stages, steps, held, gate])


def perceptron(columns: list[str], label: str = "label", hidden: tuple[int, ...] = HIDDEN, rounds: int = 100, seed: int = 1337) -> Pipeline:
    """Columns without nulls, brought to mean 0 and deviation 1 by the rows it is fitted on, into a small network."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="given"),
        StandardScaler(inputCol="given", outputCol="scaled", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[len(columns), *hidden, 2], maxIter=rounds, seed=seed),
    ])


def candidates(predictions: DataFrame, truths: DataFrame, share: float = CANDIDATES, cost: float = 0.0) -> DataFrame:
    """The bars with the largest margin between both sides, over all symbols: at least the best ``share``, ties included.

    (symbol, ts, direction, margin, label, pnl_points): the label tells whether the favoured side won, the points what its trade made.
    """
    beside = evaluation.outcomes(predictions, truths)
    beside = beside.withColumn("margin", F.round(F.abs(F.col("pl") - F.col("ps")), 9)).withColumn("direction", F.when(F.col("pl") >= F.col("ps"), 1).otherwise(-1))
    margins = beside.select("margin").where("margin IS NOT NULL").persist()  # a number a row: the search reads it some five times
    try:
        n = margins.count()
        least = order.kth_values(margins, "margin", [n - max(1, int(np.ceil(share * n))) + 1])[0] if n else None
    finally:
        margins.unpersist()
    points = lambda y, mfe, mae: F.when(F.col(y) == 1, F.col("win_points")).when(F.col(mae) >= F.col("loss_points"), -F.col("loss_points")).otherwise(F.col(mfe) - F.col(mae))
    long = F.col("direction") > 0
    best = beside.where(F.col("margin") >= F.lit(least))
    label = F.when(long, F.col("y")).otherwise(F.col("y2")).cast("int")
    return best.select("symbol", "ts", "direction", "margin", label.alias("label"), (F.when(long, points("y", "mfe_l", "mae_l")).otherwise(points("y2", "mfe_s", "mae_s")) - cost).alias("pnl_points"))


# What the derived signal columns of the second layer are.
DERIVED = {
    "derived_direction": "CASE WHEN long_tp_prob >= short_tp_prob THEN 1.0 ELSE -1.0 END",
    "derived_strength": "greatest(long_tp_prob, short_tp_prob)",
    "derived_margin": "abs(long_tp_prob - short_tp_prob)",
    "derived_entropy": "-(pl_ * ln(pl_) + ps_ * ln(ps_) + pn_ * ln(pn_))",
    "derived_expected_r": "CASE WHEN long_tp_prob >= short_tp_prob THEN mfe_long / (mae_long + 0.000000001) ELSE mfe_short / (mae_short + 0.000000001) END",
}
_SIMPLEX = {k: f"least(greatest({e}, 0.000000001), 1.0)" for k, e in (("pl_", "long_tp_prob"), ("ps_", "short_tp_prob"), ("pn_", "1.0 - long_tp_prob - short_tp_prob"))}


def second_layer_input(predictions: DataFrame, structural: DataFrame, columns: list[str]) -> DataFrame:
    """``dataset.second_layer`` with the derived signal columns."""
    signal = predictions.select("*", *[F.expr(spark_text(e)).alias(c) for c, e in _SIMPLEX.items()]).select("symbol", "ts", *[F.expr(spark_text(e)).cast("double").alias(c) for c, e in DERIVED.items()])
    return dataset.second_layer(predictions, structural, columns).join(signal, ["symbol", "ts"])


def train_second_layer(table: DataFrame, columns: list[str], rounds: int = 100, **params) -> PipelineModel:
    """The calibrated second layer on a table with ``columns``, ``label`` and ``ts``."""
    return TailCalibrated(labelCol="label", **params).setBase(perceptron(columns, rounds=rounds)).fit(table)


def cascade(scored: DataFrame, mode: str = "threshold", threshold: float = THRESHOLD, share: float = 0.20, stop: float = labels.POINTS) -> DataFrame:
    """One row: what keeping candidates (label, pnl_points, prob, lower) by ``threshold``, ``conformal`` or ``percentile`` does to win rate and points."""
    if mode == "percentile":
        n = scored.count()
        at = order.kth_values(scored, "prob", [n - max(1, int(np.ceil(share * n))) + 1])[0] if n else None
        kept = F.col("prob") >= F.lit(at)
    elif mode in ("threshold", "conformal"):
        kept = F.col("prob" if mode == "threshold" else "lower") >= threshold
    else:
        raise ValueError(f"unknown mode: {mode}")
    won, own = F.col("label").cast("double"), lambda c: F.when(kept, c)
    n, m = F.count(F.lit(1)), F.count(own(F.lit(1)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.agg(
        n.alias("n_candidates"), m.alias("n_kept"), zero(F.try_divide(m, n)).alias("retention"), F.avg(won).alias("win_rate_all"), F.avg(own(won)).alias("win_rate_kept"),
        zero(F.sum("pnl_points")).alias("points_all"), zero(F.sum(own(F.col("pnl_points")))).alias("points_kept"), zero(F.avg("pnl_points") / stop).alias("r_all"), zero(F.avg(own(F.col("pnl_points"))) / stop).alias("r_kept"),
    )


def summary(scored: DataFrame, label: str = "label") -> DataFrame:
    """(metric, value) of raw and calibrated probabilities: areas under the curve over all rows, Brier scores and the base rate."""
    areas = [order.rank_metrics(scored, c, label).select(F.lit(n).alias("metric"), F.col("auc").alias("value")) for n, c in (("auc_raw", "raw_prob"), ("auc_calibrated", "prob"))]
    y = F.col(label).cast("double")
    sums = scored.agg(F.avg((F.col("raw_prob") - y) ** 2).alias("brier_raw"), F.avg((F.col("prob") - y) ** 2).alias("brier_calibrated"), F.avg(y).alias("base_rate"))
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in sums.columns])).alias("m")).select("m.*")
    return functools.reduce(DataFrame.unionByName, [*areas, each])


# sums of products


def gram(table: DataFrame, columns: list[str], by: str | None = None) -> dict[object, np.ndarray]:
    """The matrix of sums of products of (1, columns) over the rows, for each value of ``by`` (few): summed in each task, then entry by entry.

    ``columns`` may be numbers or arrays of a fixed length. Rows with nulls are left out.
    """
    given = table.select((F.col(by) if by else F.lit(0)).cast("int").alias("g"), *columns).na.drop("any")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _matrix(part, columns)
                x = np.column_stack([np.ones(len(x)), x])
                g = part.column("g").to_numpy(zero_copy_only=False)
                for k in np.unique(g):
                    own = x[g == k]
                    sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        for k, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(i), k), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(m[i, j], pa.float64())})

    cells = given.mapInArrow(partial, "g int, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # columns squared, for each group
    out = {}
    for k, c in cells.groupby("g"):
        m = np.zeros((c["j"].max() + 1,) * 2)
        m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["v"]
        out[k] = m
    return out


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    parts = []
    for c in columns:
        a = batch.column(c)
        if pa.types.is_list(a.type):
            flat = a.flatten()
            parts.append((flat.flatten() if pa.types.is_list(flat.type) else flat).to_numpy(zero_copy_only=False).reshape(len(a), -1))
        else:
            parts.append(a.to_numpy(zero_copy_only=False).reshape(-1, 1))
    return np.column_stack(parts).astype(float) if parts else np.empty((batch.num_rows, 0))


# the first layer

#: The heads: their kind, and the label they learn.
HEADS = {
    "long_tp_prob": ("binary", "long_tp"), "short_tp_prob": ("binary", "short_tp"), "clears_level_prob": ("binary", "clears_up_first"), "inflection_prob": ("binary", "inflection_label"), "path_shape": ("classes", "path_shape_class"),
    "mfe_long": ("number", "mfe_long"), "mae_long": ("number", "mae_long"), "mfe_short": ("number", "mfe_short"), "mae_short": ("number", "mae_short"), "return_h15_pred": ("number", "return_h15"), "return_h60_pred": ("number", "return_h60"),
}
SHAPES = 3
RIDGE = 1e-2  # per row, on scaled columns
POSITIVE = {"mfe_long", "mae_long", "mfe_short", "mae_short"}


def out_of_fold(matrix: DataFrame, truths: DataFrame, folds: DataFrame, heads: list[str] | None = None, rounds: int = 30) -> DataFrame:
    """(symbol, ts, fold, outputs): every validation row of ``folds`` (fold, role, ts) predicted by models fitted on its fold's training rows alone.

    Number heads of all folds come from one pass: Gram matrices of the segments between
    the folds' bounds, added up as the folds grow. Classes take one logistic fit a head and fold.
    Only rows with labels in ``truths`` teach (leave out those that are not ``valid``); the others are predicted all the same.
    """
    heads = list(HEADS) if heads is None else heads
    columns = [c for c in matrix.columns if c not in ("symbol", "ts")]
    numbers = [h for h in heads if HEADS[h][0] == "number"]
    role = folds.groupBy("fold", "role").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()  # two rows a fold
    ends = {r["fold"]: r["hi"] for r in role if r["role"] == "train"}
    spans = {r["fold"]: (r["lo"], r["hi"]) for r in role if r["role"] == "val"}
    names = list(dict.fromkeys(HEADS[h][1] for h in heads))
    table = matrix.na.drop("any").join(truths.select("symbol", "ts", *[F.col(c).cast("double").alias(f"y_{c}") for c in names]), ["symbol", "ts"], "left")
    # the segment in which a row first is training data: 0 for the first fold
    order_ = sorted(ends)
    segment = F.coalesce(*[F.when(F.col("ts") <= F.lit(ends[k]), F.lit(i)) for i, k in enumerate(order_)])
    taught = table.withColumn("segment", segment).where("segment IS NOT NULL").na.drop("any", subset=[f"y_{c}" for c in names])
    targets = [f"y_{HEADS[h][1]}" for h in numbers]
    sums = gram(taught, [*columns, *targets], "segment")
    d, total, out = len(columns), 0, []
    for i, k in enumerate(order_):
        total = total + sums.get(i, 0)
        if k not in spans:
            continue
        if np.isscalar(total):
            raise ValueError(f"fold {k} has no training rows")
        n, mean = total[0, 0], total[0, 1 : d + 1] / total[0, 0]
        cross = total[1 : d + 1, 1 : d + 1] / n - np.outer(mean, mean)
        dev = np.sqrt(np.maximum(np.diag(cross), 1e-12))
        scaled = [(F.col(c) - float(mean[j])) / float(dev[j]) for j, c in enumerate(columns)]
        prepared = lambda df: df.withColumn("x", array_to_vector(F.array(*scaled)))  # noqa: B023, E731
        seen = prepared(table.where((F.col("ts") >= F.lit(spans[k][0])) & (F.col("ts") <= F.lit(spans[k][1]))).select("symbol", "ts", *columns))
        outputs = {}
        if numbers:
            ty = total[0, d + 1 :] / n
            cov = (total[1 : d + 1, d + 1 :] / n - np.outer(mean, ty)) / dev[:, None]
            weights = np.linalg.solve(cross / np.outer(dev, dev) + RIDGE * np.eye(d), cov)
            for j, h in enumerate(numbers):
                value = functools.reduce(lambda a, b: a + b, [s * float(w) for s, w in zip(scaled, weights[:, j])], F.lit(float(ty[j])))
                outputs[h] = F.greatest(value, F.lit(0.0)) if h in POSITIVE else value
        own = prepared(taught.where(F.col("segment") <= i)).select("x", *[f"y_{c}" for c in names]).cache()
        try:
            for h in heads:
                kind, label = HEADS[h]
                if kind == "number":
                    continue
                present = [r[0] for r in own.select(f"y_{label}").distinct().collect()]  # classes
                size = SHAPES if kind == "classes" else 2
                if len(present) < 2:
                    outputs |= {f"{h}_p{c}" if kind == "classes" else h: F.lit(float(c == present[0])) for c in ([1] if kind == "binary" else range(size))}
                    continue
                model = LogisticRegression(featuresCol="x", labelCol=f"y_{label}", family="multinomial" if kind == "classes" else "binomial", regParam=RIDGE, standardization=False, maxIter=rounds).fit(own)
                model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"p_{h}")
                seen = model.transform(seen)
                has = model.numClasses
                at = lambda c: vector_to_array(f"p_{h}")[c] if c < has else F.lit(0.0)  # noqa: B023, E731
                outputs |= {h: at(1)} if kind == "binary" else {f"{h}_p{c}": at(c) for c in range(size)}
        finally:
            own.unpersist()
        out.append(seen.select("symbol", "ts", F.lit(k).alias("fold"), *[v.alias(c) for c, v in outputs.items()]))
    return functools.reduce(DataFrame.unionByName, out)


def diagnostics(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(metric, value) of out-of-fold predictions over all rows: what tells forecasts from mere pacing.

    The sides' correlation, root mean square errors, rank correlations of returns, accuracy and recall of path shapes, the
    area of clearance; a metric whose outputs are not there, or that too few rows or one class leave open, is null or absent.
    """
    have, taken = set(predictions.columns), [c for _, c in HEADS.values()]
    both = predictions.join(truths.select("symbol", "ts", *[F.col(c).cast("double").alias(f"y_{c}") for c in taken if c in truths.columns]), ["symbol", "ts"]).persist()
    try:
        parts = {}
        if {"long_tp_prob", "short_tp_prob"} <= have:
            parts["side_corr"] = F.corr("long_tp_prob", "short_tp_prob")
        for h, (kind, y) in HEADS.items():
            if kind == "number" and h in have:
                parts[f"rmse_{h}"] = F.sqrt(F.avg((F.col(h) - F.col(f"y_{y}")) ** 2))
        if "path_shape_p0" in have:
            best = F.array_position(F.array(*[f"path_shape_p{c}" for c in range(SHAPES)]), F.greatest(*[f"path_shape_p{c}" for c in range(SHAPES)])) - 1
            right = (best == F.col("y_path_shape_class")).cast("double")
            parts["shape_accuracy"] = F.avg(right)
            parts |= {f"shape_recall_{c}": F.avg(F.when(F.col("y_path_shape_class") == c, right)) for c in range(SHAPES)}
        values = dict(both.agg(*[v.alias(k) for k, v in parts.items()]).first().asDict()) if parts else {}
        for h, name in (("return_h15_pred", "ic_15"), ("return_h60_pred", "ic_60")):
            if h in have:
                values[name] = order.spearman(both, h, f"y_{HEADS[h][1]}").first()["ic"]
        for h, (kind, y) in HEADS.items():
            if kind == "binary" and h in have:
                values["clear_auc" if h == "clears_level_prob" else f"auc_{y}"] = order.rank_metrics(both, h, f"y_{y}").first()["auc"]
    finally:
        both.unpersist()
    finite = [(k, float(v) if v is not None and np.isfinite(v) else None) for k, v in sorted(values.items())]
    return predictions.sparkSession.createDataFrame(finite, "metric string, value double")


def told(metrics: DataFrame) -> str:
    """The verdict of ``diagnostics``."""
    found = {r["metric"]: r["value"] for r in metrics.collect()}  # a few rows
    row = metrics.sparkSession.createDataFrame([tuple(found.get(c) for c in dataset.TIERS)], ", ".join(f"{c} double" for c in dataset.TIERS))
    return dataset.verdict(row).first()["verdict"]


# the encoder's substitute


def main_components(windows: DataFrame, size: int, column: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of windows (arrays of rows) as long vectors; the sign makes a component's largest entry positive."""
    flat = windows.select(F.flatten(column).alias("v"))
    sums = gram(flat, ["v"])
    if not sums:
        raise ValueError("no windows")
    m = sums[0]
    mean = m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    parts = vectors[:, np.argsort(-values, kind="stable")[:size]].T
    return mean, parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]


def embedded(windows: DataFrame, mean: np.ndarray, components: np.ndarray, prefix: str = "simmtm", column: str = "x") -> DataFrame:
    """(symbol, ts, prefix_000, ...): every window's place along the components, a cache that ``features.structural_features`` can read."""
    names = [f"{prefix}_{k:03d}" for k in range(len(components))]
    keys = ["symbol", "ts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                at = (_matrix(part, ["v"]) - mean) @ components.T
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], *[pa.array(at[:, j]) for j in range(len(names))]], names=[*keys, *names])

    flat = windows.select(*keys, F.flatten(column).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema}
    return flat.mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names]))


# demo queries: 15-minute bars, the flagship's columns and the momentum baseline

#: Families of the demo's second layer.
BESIDE = ("pclear", "scomp", "seod", "sweep")
INPUTS = [c for n in BESIDE for c in features.family_columns(n)]
_BASELINE = families.PRIMITIVES["momentum_baseline"]


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15)


def _predictions(frame: DataFrame) -> DataFrame:
    """The momentum baseline's, which forecasts no excursions: ranges of the bar before stand for them."""
    own = Plan([], {"mfe_long": "coalesce(lag(high - open) OVER w, 0.0)", "mae_long": "coalesce(lag(open - low) OVER w, 0.0)", "mfe_short": "coalesce(lag(open - low) OVER w, 0.0)", "mae_short": "coalesce(lag(high - open) OVER w, 0.0)"})
    own = replace(own, out={k: e.replace("OVER w", f"OVER ({BY})") for k, e in own.out.items()})
    return _BASELINE.apply(frame).withColumnsRenamed({"long_tp_pred": "long_tp_prob", "short_tp_pred": "short_tp_prob"}).join(own.apply(frame), ["symbol", "ts"])


def demo_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second layer's input of all bars."""
    frame = _bars(spark, sf_dir)
    structural = features.structural_features(frame, features.Spec(frozenset(BESIDE)))
    return second_layer_input(_predictions(frame), structural, INPUTS)


def demo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _bars(spark, sf_dir)
    return candidates(_predictions(frame), labels.barrier_labels(frame, 60, None, 15))


def demo_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Candidates with their second layer's input, and its columns."""
    x = demo_input(spark, sf_dir)
    columns = [c for c in x.columns if c not in ("symbol", "ts")]
    return demo_candidates(spark, sf_dir).join(x, ["symbol", "ts"]).na.fill(0.0, columns), columns


SPLIT = "2024-01-20"  # the demo trains on what comes before


def scored_candidates(spark: SparkSession, sf_dir: str, rounds: int = 30) -> DataFrame:
    """The later candidates of the demo, scored by a second layer trained and calibrated on the earlier ones.

    Both are rows of one table, which stays persisted (in memory or on disk) for as long as the session: the result reads it, and labels and features are computed once.
    """
    table, columns = demo_table(spark, sf_dir)
    table = table.persist()
    try:
        early, late = (table.where(f"ts {op} TIMESTAMP_NTZ '{SPLIT}'") for op in ("<", ">="))
        model = train_second_layer(early, columns, rounds)
    except BaseException:
        table.unpersist()
        raise
    return model.transform(late).select("symbol", "ts", "direction", "label", "pnl_points", "raw_prob", "prob", "lower", "upper", "trade")


def _rounded(out: DataFrame, digits: int = 9) -> DataFrame:
    return out.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def input_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(demo_input(spark, sf_dir), 6)


def candidate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(demo_candidates(spark, sf_dir))


def cascade_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode keeps of the demo's candidates by their margins; the gate's lower end is a tenth below."""
    scored = demo_candidates(spark, sf_dir).select("label", "pnl_points", F.col("margin").alias("prob"), F.round(F.col("margin") - 0.1, 9).alias("lower"))
    out = [cascade(scored, m).select(F.lit(m).alias("mode"), "*") for m in ("threshold", "conformal", "percentile")]
    return _rounded(functools.reduce(DataFrame.unionByName, out))


MATRIX = families.PRIMITIVES["price_block_tf15"]
FOLDS = 3


def demo_folds(spark: SparkSession, sf_dir: str, heads: list[str] | None = None) -> DataFrame:
    """Out-of-fold predictions of all heads for the demo's bars."""
    frame = _bars(spark, sf_dir)
    matrix = features.shifted(MATRIX.apply(frame))
    folds = labels.walk_forward(frame.select("ts").distinct(), FOLDS, 60, 0)
    return out_of_fold(matrix, labels.barrier_labels(frame, 60, None, 15), folds, heads)


def fold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, symbol, rows, first, last) of the out-of-fold predictions of one head of each kind that is solved in closed form."""
    out = demo_folds(spark, sf_dir, ["mfe_long", "return_h15_pred"])
    return out.groupBy("fold", "symbol").agg(F.count("mfe_long").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def product_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): sums of products of the demo's matrix."""
    sums = gram(features.shifted(MATRIX.apply(_bars(spark, sf_dir))), list(MATRIX.out))[0]
    cells = [(i, j, float(sums[i, j])) for i in range(len(sums)) for j in range(i, len(sums))]
    return spark.createDataFrame(cells, "i int, j int, v double").select("i", "j", F.round("v", 6).alias("v"))


COMPONENTS = 8


def window_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised windows of the demo's matrix along their main components."""
    frame = _bars(spark, sf_dir)
    matrix = features.shifted(MATRIX.apply(frame)).na.drop("any")
    truths = labels.at_index(labels.barrier_labels(frame, 60, None, 15), matrix)
    data = dataset.normalised(dataset.windows(matrix, truths, dataset.LENGTH), len(MATRIX.out)).select("symbol", "ts", "x").persist()
    try:
        return embedded(data, *main_components(data, COMPONENTS))
    finally:
        data.unpersist()


_FRAMES = bars_sql(15)
_GIVEN_SQL = f"""SELECT symbol, ts, long_tp_pred AS long_tp_prob, short_tp_pred AS short_tp_prob, round(coalesce(lag(high - open) OVER w, 0), 6) AS mfe_long, round(coalesce(lag(open - low) OVER w, 0), 6) AS mae_long,
 round(coalesce(lag(open - low) OVER w, 0), 6) AS mfe_short, round(coalesce(lag(high - open) OVER w, 0), 6) AS mae_short FROM ({_FRAMES}) b JOIN ({_BASELINE.sql()}) p USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""


def input_sql() -> str:
    names = {n: features.family_columns(n) for n in BESIDE}
    joins = " ".join(f"JOIN ({features.PLANS[n].sql()}) f_{n} USING (symbol, ts)" for n in names)
    lagged = ", ".join(f"round(coalesce(CAST(lag(f_{n}.{c}) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE), 0), 6) + 0.0 AS {c}" for n, cs in names.items() for c in cs)
    first = ", ".join(f"round({c}, 6) + 0.0 AS l1_{c}" for c in dataset.FIRST)
    neutral = ", ".join(f"round({v}e0, 6) + 0.0 AS l1_{c}" if isinstance(v, float) and v not in (1 / 3,) else f"round(1e0 / 3, 6) AS l1_{c}" for c, v in dataset.NEUTRAL.items())
    derived = ", ".join(f"round(CAST({duck_text(e)} AS DOUBLE), 6) + 0.0 AS {c}" for c, e in DERIVED.items())
    simplex = ", ".join(f"{duck_text(e)} AS {k}" for k, e in _SIMPLEX.items())
    time = "time_hour_sin, time_hour_cos, time_dow_sin, time_dow_cos"
    return f"""WITH g AS (SELECT *, {simplex} FROM ({_GIVEN_SQL}) z)
SELECT symbol, ts, {first}, {neutral}, {time}, {lagged}, {derived} FROM g JOIN ({families.FAMILIES["session"].sql()}) s USING (symbol, ts) {joins}"""


_POINTS = "CASE WHEN {y} = 1 THEN win_points WHEN {a} >= loss_points THEN -loss_points ELSE {f} - {a} END"
CANDIDATE_SQL = f"""WITH o AS (SELECT symbol, ts, round(abs(p.long_tp_pred - p.short_tp_pred), 9) AS margin, CASE WHEN p.long_tp_pred >= p.short_tp_pred THEN 1 ELSE -1 END AS direction,
 l.long_tp AS y, l.short_tp AS y2, l.mfe_long AS fl, l.mae_long AS al, l.mfe_short AS fs, l.mae_short AS ash, l.tp_points AS win_points, l.sl_points AS loss_points
 FROM ({_BASELINE.sql()}) p JOIN ({labels.labels_sql(60, None, 15)}) l USING (symbol, ts)),
t AS (SELECT min(margin) AS least FROM (SELECT margin FROM o ORDER BY margin DESC LIMIT (SELECT greatest(1, CAST(ceil({CANDIDATES} * count(*)) AS BIGINT)) FROM o)) z)
SELECT symbol, ts, direction, margin, CASE WHEN direction > 0 THEN y ELSE y2 END AS label, round(CASE WHEN direction > 0 THEN {_POINTS.format(y="y", a="al", f="fl")} ELSE {_POINTS.format(y="y2", a="ash", f="fs")} END, 9) + 0.0 AS pnl_points
FROM o, t WHERE margin >= least"""


def cascade_sql() -> str:
    kept = {"threshold": f"margin >= {THRESHOLD}", "conformal": f"round(margin - 0.1, 9) >= {THRESHOLD}", "percentile": "margin >= (SELECT min(margin) FROM (SELECT margin FROM c ORDER BY margin DESC LIMIT (SELECT greatest(1, CAST(ceil(0.2 * count(*)) AS BIGINT)) FROM c)) z)"}
    one = lambda m, k: f"""SELECT '{m}' AS mode, count(*) AS n_candidates, count(*) FILTER (WHERE {k}) AS n_kept, round(count(*) FILTER (WHERE {k}) * 1e0 / count(*), 9) AS retention, round(avg(label), 9) AS win_rate_all, round(avg(label) FILTER (WHERE {k}), 9) AS win_rate_kept,
 round(sum(pnl_points), 9) AS points_all, round(coalesce(sum(pnl_points) FILTER (WHERE {k}), 0), 9) AS points_kept, round(avg(pnl_points) / {labels.POINTS}, 9) AS r_all, round(coalesce(avg(pnl_points) FILTER (WHERE {k}), 0) / {labels.POINTS}, 9) AS r_kept FROM c"""  # noqa: E731
    return f"WITH c AS ({CANDIDATE_SQL}) " + " UNION ALL ".join(one(m, k) for m, k in kept.items())


_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in MATRIX.out)
_SHIFTED = f"SELECT symbol, ts, {', '.join(f'lag({c}) OVER (PARTITION BY symbol ORDER BY ts) AS {c}' for c in MATRIX.out)} FROM ({MATRIX.sql()}) m"
COVERAGE_SQL = f"""WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM (SELECT DISTINCT ts FROM ({_FRAMES}) b) d),
p AS (SELECT count(*) FILTER (WHERE ts < (SELECT CAST(max(ts) AS DATE) FROM t)) // {FOLDS + 1} AS c, count(*) FILTER (WHERE ts < (SELECT CAST(max(ts) AS DATE) FROM t)) AS dev FROM t)
SELECT CAST(fold AS INT) AS fold, symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT * FROM ({_SHIFTED}) s WHERE {_KNOWN}) x JOIN t USING (ts), p, range({FOLDS}) f(fold) WHERE rn >= c * (fold + 1) AND rn < least(c * (fold + 2), dev) GROUP BY 1, 2"""


def product_sql() -> str:
    names = ["1e0", *MATRIX.out]
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': sum({names[i]} * {names[j]})}}" for i in range(len(names)) for j in range(i, len(names)))
    return f"SELECT c.i::INT AS i, c.j::INT AS j, round(c.v, 6) AS v FROM (SELECT unnest([{cells}]) AS c FROM ({_SHIFTED}) s WHERE {_KNOWN}) x"


QUERIES = {"l2_input": input_query, "l2_candidates": candidate_query, "l2_scored": scored_candidates, "l2_cascade_modes": cascade_query, "l1_out_of_fold": demo_folds, "l1_fold_coverage": fold_coverage, "product_sums": product_sums, "window_embedding": window_embedding}
ORACLES = {"l2_input": input_sql(), "l2_candidates": CANDIDATE_SQL, "l2_cascade_modes": cascade_sql(), "l1_fold_coverage": COVERAGE_SQL, "product_sums": product_sql()}
