"""Models against dense algebra and SQL on their outputs; order over all rows against sorting."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from barwright.operators import order, training


def times(n, minutes=15):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes * k) for k in range(n)]


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(4)
    n = 3000
    a, b = rng.normal(size=n), rng.normal(size=n)
    p = 1 / (1 + np.exp(-(1.5 * a * np.sign(b) + 0.5 * b)))
    y = (rng.random(n) < p).astype(int)
    rows = [("s", t, float(x), float(z), 7.0, int(l), float(l) * 2 - 1) for t, x, z, l in zip(times(n), a, b, y)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, flat double, label int, pnl_points double")


def test_second_layer_trains_saves_and_predicts(spark, learnable, tmp_path):
    cut = times(3000)[2400]
    early, late = learnable.where(F.col("ts") < F.lit(cut)), learnable.where(F.col("ts") >= F.lit(cut))
    model = training.train_second_layer(early, ["a", "b", "flat"], rounds=60)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    cols = ["symbol", "ts", "label", "raw_prob", "prob", "lower", "upper", "trade", "pnl_points"]
    got, same = (m.transform(late).select(*cols).toPandas().sort_values("ts").reset_index(drop=True) for m in (model, again))
    assert (got == same).all().all()
    assert got["prob"].between(training.LOWEST, 1 - training.LOWEST).all() and got.sort_values("raw_prob")["prob"].is_monotonic_increasing
    # SQL on the predictions gives the same figures
    known = {r["metric"]: r["value"] for r in training.summary(model.transform(late)).collect()}
    sql = duckdb.sql("""SELECT (sum(r * label) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label))) AS auc, avg((prob - label) ** 2) AS brier, avg((raw_prob - label) ** 2) AS raw, avg(label) AS base
      FROM (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2e0 AS r FROM got)""").fetchall()[0]
    assert sql == pytest.approx((known["auc_calibrated"], known["brier_calibrated"], known["brier_raw"], known["base_rate"]), abs=1e-9)
    assert known["auc_raw"] > 0.7 and known["brier_calibrated"] < known["base_rate"] * (1 - known["base_rate"])
    # the gate's width is the order statistic of the errors on the tail, which no fit has seen
    start = training.tail_start(early, training.TAIL)
    tail = early.where(F.col("ts") >= F.lit(start))
    assert tail.count() == int(2400 * training.TAIL)
    e = np.sort(np.abs(np.array([r["prob"] - r["label"] for r in model.transform(tail).collect()])))
    level = min(np.ceil((len(e) + 1) * (1 - training.ALPHA)) / len(e), 1.0)
    assert model.stages[-1].getOrDefault("q") == pytest.approx(np.quantile(e, level, method="higher"), abs=1e-12)
    assert np.allclose(got["lower"], (got["prob"] - model.stages[-1].getOrDefault("q")).clip(0))


def test_tail_is_cut_by_time(spark):
    rows = [(t,) for t in times(10) for _ in range(10)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert training.tail_start(table, 0.25) == times(10)[8]  # ties are not torn apart
    assert training.tail_start(table, 0.2) == times(10)[8]
    days = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 1, 2, 3, 3, 4)], "ts timestamp_ntz")
    assert training.tail_start(days, 0.5) == dt.datetime(2024, 1, 3)
    with pytest.raises(ValueError):
        training.train_second_layer(spark.createDataFrame([(t, float(k % 3), k % 2) for k, t in enumerate(times(60))], "ts timestamp_ntz, a double, label int"), ["a"], rounds=2)


def test_cascade_of_nothing_and_modes(spark):
    schema = "label int, pnl_points double, prob double, lower double"
    none = training.cascade(spark.createDataFrame([], schema)).first()
    assert none["n_candidates"] == none["n_kept"] == 0 and none["win_rate_kept"] is None and none["points_kept"] == 0
    rows = [(k % 2, float(k), k / 10, k / 10 - 0.2) for k in range(10)]
    table = spark.createDataFrame(rows, schema)
    assert training.cascade(table).first()["n_kept"] == 4
    assert training.cascade(table, "conformal").first()["n_kept"] == 2
    assert training.cascade(table, "percentile", share=0.3).first()["points_kept"] == 7 + 8 + 9
    with pytest.raises(ValueError):
        training.cascade(table, "other")


def test_gram_and_components_equal_dense_algebra(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([("s", t, v.tolist()) for t, v in zip(times(400), x)], "symbol string, ts timestamp_ntz, x array<array<double>>").repartition(7)
    mean, parts = training.main_components(df, 5)
    flat = x.reshape(400, 12)
    _, _, v = np.linalg.svd(flat - flat.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, flat.mean(axis=0)) and np.allclose(np.abs(parts @ v[:5].T), np.eye(5), atol=1e-6)
    got = training.embedded(df, mean, parts, prefix="e").orderBy("ts").toPandas()
    assert list(got.columns) == ["symbol", "ts", *[f"e_{k:03d}" for k in range(5)]]
    assert np.allclose(got.iloc[:, 2:], (flat - mean) @ parts.T)
    table = spark.createDataFrame([(k % 2, float(k), None if k == 3 else float(k * k)) for k in range(20)], "g int, a double, b double")
    own = training.gram(table, ["a", "b"], "g")
    want = np.array([[1, k, k * k] for k in range(1, 20, 2) if k != 3], float)
    assert np.allclose(own[1], want.T @ want) and set(own) == {0, 1}
    assert training.gram(table.limit(0), ["a"]) == {}


def test_out_of_fold_sees_no_future(spark):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.normal(size=(n, 2))
    noise = rng.normal(size=n)
    at = times(n)
    matrix = spark.createDataFrame([("s", t, *map(float, v)) for t, v in zip(at, x)], "symbol string, ts timestamp_ntz, a double, b double")
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * noise
    up = (x[:, 0] + 0.3 * noise > 0).astype(int)
    shape = np.where(x[:, 1] > 0.5, 2, np.where(x[:, 1] < -0.5, 1, 0))

    def truths(change=0.0):
        late = np.arange(n) >= 390  # validation rows of fold 1 and what follows
        rows = [("s", t, int(u), 1 - int(u), int(s), float(v + change * late[k]), abs(float(v))) for k, (t, u, s, v) in enumerate(zip(at, up, shape, y))]
        return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, long_tp int, short_tp int, path_shape_class int, return_h15 double, mfe_long double")

    folds = spark.createDataFrame([(f, r, at[k]) for f, (a, b, c) in enumerate([(180, 200, 390), (370, 390, 600)]) for r, lo, hi in (("train", 0, a), ("val", b, c)) for k in range(lo, hi)], "fold int, role string, ts timestamp_ntz")
    heads = ["long_tp_prob", "path_shape", "mfe_long", "return_h15_pred"]
    got = training.out_of_fold(matrix, truths(), folds, heads).toPandas().sort_values("ts").reset_index(drop=True)
    assert list(got["ts"]) == at[200:] and list(got["fold"]) == [0] * 190 + [1] * 210
    for f, (end, lo, hi) in enumerate([(180, 0, 190), (370, 190, 400)]):
        m, d = x[:end].mean(axis=0), x[:end].std(axis=0)
        z = (x - m) / d
        w = np.linalg.solve(z[:end].T @ z[:end] / end + training.RIDGE * np.eye(2), z[:end].T @ (y[:end] - y[:end].mean()) / end)
        assert np.allclose(got["return_h15_pred"][lo:hi], (z @ w + y[:end].mean())[200 + lo : 200 + hi])
    assert (got["mfe_long"] >= 0).all()
    assert ((got["long_tp_prob"] > 0.5) == (up[200:] == 1)).mean() > 0.8
    probs = got[[f"path_shape_p{k}" for k in range(3)]].to_numpy()
    assert np.allclose(probs.sum(axis=1), 1) and (probs.argmax(axis=1) == shape[200:]).mean() > 0.8
    # labels from the last validation range on change nothing
    other = training.out_of_fold(matrix, truths(5.0), folds, heads).toPandas().sort_values("ts").reset_index(drop=True)
    assert np.allclose(got.drop(columns=["symbol", "ts"]), other.drop(columns=["symbol", "ts"]))


def test_diagnostics_of_forecasts(spark):
    rng = np.random.default_rng(9)
    n = 500
    y = rng.normal(size=n)
    up = (y > 0).astype(int)
    shape = rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-y - rng.normal(size=n)))
    rows = [("s", t, float(a), float(1 - a), float(v + 0.5), float(v * 2), *[0.8 if s == k else 0.1 for k in range(3)], float(a)) for t, a, v, s in zip(times(n), p, y, np.where(rng.random(n) < 0.6, shape, 0))]
    oof = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, long_tp_prob double, short_tp_prob double, mfe_long double, return_h60_pred double, path_shape_p0 double, path_shape_p1 double, path_shape_p2 double, clears_level_prob double")
    truths = spark.createDataFrame([("s", t, int(u), 1 - int(u), float(v), float(v), int(s), int(u)) for t, u, v, s in zip(times(n), up, y, shape)], "symbol string, ts timestamp_ntz, long_tp int, short_tp int, mfe_long double, return_h60 double, path_shape_class int, clears_up_first int")
    found = training.diagnostics(oof, truths)
    got = {r["metric"]: r["value"] for r in found.collect()}
    assert got["side_corr"] == pytest.approx(-1) and got["rmse_mfe_long"] == pytest.approx(0.5) and got["ic_60"] == pytest.approx(1)
    assert got["shape_accuracy"] == pytest.approx(np.mean([(r[6:9].index(0.8)) == s for r, s in zip(rows, shape)])) and got["shape_recall_0"] == 1
    area = (p[up == 1][:, None] > p[up == 0]).mean()
    assert got["clear_auc"] == got["auc_long_tp"] == pytest.approx(area) and "ic_15" not in got
    assert training.told(found) == "STRONG-PREDICTIVE"
    assert training.told(training.diagnostics(oof.limit(0), truths)) == "INCONCLUSIVE"


def test_one_class_gives_its_rate(spark):
    at = times(40)
    matrix = spark.createDataFrame([("s", t, float(k)) for k, t in enumerate(at)], "symbol string, ts timestamp_ntz, a double")
    truths = spark.createDataFrame([("s", t, 0, 1) for t in at], "symbol string, ts timestamp_ntz, long_tp int, path_shape_class int")
    folds = spark.createDataFrame([(0, "train" if k < 20 else "val", t) for k, t in enumerate(at)], "fold int, role string, ts timestamp_ntz")
    got = training.out_of_fold(matrix, truths, folds, ["long_tp_prob", "path_shape"]).collect()
    assert len(got) == 20 and {(r["long_tp_prob"], r["path_shape_p0"], r["path_shape_p1"], r["path_shape_p2"]) for r in got} == {(0.0, 0.0, 1.0, 0.0)}


# order


@pytest.mark.parametrize("kind", ["ties", "wide", "one", "near"])
def test_selection(spark, kind):
    rng = random.Random(7)
    x = {"ties": [rng.randrange(5) / 4 for _ in range(3000)], "wide": [rng.lognormvariate(0, 12) * rng.choice([-1, 1]) for _ in range(9000)], "one": [2.5], "near": [1.0 + k * 2.0**-52 for k in range(6000)]}[kind]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)] * 5, "x double").repartition(5)
    ranks = sorted({1, len(x), (len(x) + 1) // 2, max(1, len(x) // 10)})
    assert order.kth_values(df, "x", ranks) == [sorted(x)[r - 1] for r in ranks]
    with pytest.raises(ValueError):
        order.kth_values(df, "x", [len(x) + 1])


def test_rank_metrics_and_spearman(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 40, 2000) / 40, rng.integers(0, 2, 2000)
    z = p + rng.integers(0, 5, 2000) / 5
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(p, y, z)] + [(None, 1, 0.0), (0.5, None, None)], "p double, y int, z double")
    got = order.rank_metrics(df, "p", "y").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    ap = sum((y[p >= v].mean()) * (y[p == v].sum()) for v in np.unique(p)) / y.sum()
    assert (got["n"], got["positives"]) == (2000, y.sum()) and got["auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert order.spearman(df, "p", "z").first()["ic"] == pytest.approx(np.corrcoef(rank(p), rank(z))[0, 1])
    assert order.spearman(df.limit(20), "p", "z").first()["ic"] is None
    empty = order.rank_metrics(df.limit(0), "p", "y").first()
    assert empty["n"] == 0 and empty["auc"] is None
    top = order.top_share(df, "p", "y", 0.1).first()
    assert top["threshold"] == np.sort(p)[-200] and top["taken"] == (p >= top["threshold"]).sum()
    assert order.top_share(df.limit(0), "p", "y", 0.1).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    x = {rng.lognormvariate(0, 3): rng.randrange(100) for _ in range(3000)}
    got = order.running_sums(spark.createDataFrame(list(x.items()), "k double, v long"), "k", ["v"], parts=16).collect()
    acc = 0
    for r in sorted(got, key=lambda r: r["k"]):
        assert r["before_v"] == acc
        acc += r["v"]
    assert len(got) == len(x)


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_expanding_quantile(spark, share):
    rng = random.Random(6)
    rows, at = [], times(500)
    for s, n in (("a", 500), ("b", 40), ("c", 1)):
        rows += [(s, at[k], None if rng.random() < 0.1 else rng.choice([rng.random(), 0.5, 2.0])) for k in range(n)]
    got = {(r["symbol"], r["ts"]): r["quantile"] for r in order.expanding_quantile(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double"), "x", share, 5).collect()}
    assert len(got) == len(rows)
    seen = {}
    for s, t, v in rows:
        past = seen.setdefault(s, [])
        assert got[s, t] == (pytest.approx(np.quantile(past, share)) if len(past) >= 5 else None)
        if v is not None:
            past.append(v)


def test_expanding_quantile_over_blocks(spark):
    """Many blocks of one history, with nulls, a null symbol, and values that no later block has: the same as one walk."""
    rng = random.Random(7)
    rows, at = [], times(900)
    for s, n in (("a", 900), (None, 200)):
        rows += [(s, at[k], None if rng.random() < 0.1 else float(rng.choice([-1, 0, 3, k % 7, k // 100]))) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").repartition(7)
    got = order.expanding_quantile(df, "x", 0.4, 5, period="minute", block=30)
    assert got.columns == ["symbol", "ts", "x", "quantile"]
    got = {(r["symbol"], r["ts"]): r["quantile"] for r in got.collect()}
    seen = {}
    for s, t, v in rows:
        past = seen.setdefault(s, [])
        assert got[s, t] == (pytest.approx(np.quantile(past, 0.4)) if len(past) >= 5 else None)
        if v is not None:
            past.append(v)
    assert len(got) == len(rows)


def test_scored_candidates_are_computed_once(spark, sf_dir):
    """What is scored is read from the table that taught, and does not come from the events again."""
    out = training.scored_candidates(spark, sf_dir, rounds=1)
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and out.count()
    finally:
        spark.catalog.clearCache()
