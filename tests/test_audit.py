"""Audits on small frames whose answers are plain, and the sweeps' grids."""

import datetime as dt
import math

import numpy as np
import pytest

from barwright.operators import audit
from barwright.operators.evaluation import RR

KINDS = "a double, b double, z double, gone double, y int"


def rows(spark):
    return spark.createDataFrame([(float(i), -2.0 * i, 0.0, None, int(i >= 5)) for i in range(10)], KINDS)


def test_columns(spark):
    got = {r["feature"]: r for r in audit.column_audit(rows(spark), ["a", "z", "gone"]).collect()}
    assert (got["a"]["n"], got["a"]["missing"], got["a"]["mean"], got["a"]["lo"], got["a"]["hi"]) == (10, 0, 4.5, 0.0, 9.0)
    flags = {k: (r["all_missing"], r["all_zero"], r["constant"]) for k, r in got.items()}
    assert flags == {"a": (0, 0, 0), "z": (0, 1, 1), "gone": (1, 0, 1)}


def test_redundancy(spark):
    got = {(r["feature"], r["other"]): r for r in audit.redundancy(rows(spark), ["a", "b", "gone"]).collect()}
    assert got["a", "b"]["corr"] == -1 and got["a", "b"]["limits_passed"] == 3
    assert got["a", "gone"]["limits_passed"] == 0 and len(got) == 3


def test_mutual_information(spark):
    got = {r["feature"]: r for r in audit.mutual_information(rows(spark), ["a", "z", "gone"], "y").collect()}
    assert abs(got["a"]["mi"] - math.log(2)) < 1e-6 and got["a"]["rank"] == 1
    assert got["z"]["mi"] == got["gone"]["mi"] == 0


def test_missing_values_are_a_bin_of_their_own(spark):
    """An outlier shares the lowest bin with nothing, missing values least of all; NaN is missing too."""
    frame = spark.createDataFrame([(-1000.0, 0)] + [(float(i), 0) for i in range(30)] + [(None, 1)] * 20 + [(float("nan"), 1)] * 11, "a double, y int")
    assert abs(audit.mutual_information(frame, ["a"], "y").first()["mi"] - math.log(2)) < 1e-6
    got = audit.column_audit(frame, ["a"]).first()
    assert (got["n"], got["missing"], got["hi"]) == (62, 31, 29.0)


def test_empty(spark):
    none = rows(spark).where("false")
    assert not audit.column_audit(none, ["a"]).count() and not audit.redundancy(none, ["a", "b"]).count() and not audit.mutual_information(none, ["a"], "y").count()


def test_sweeps_cover_their_grids(spark, sf_dir):
    from barwright.plans import catalogue

    grid = catalogue.QUERIES["sim_threshold_sweep"](spark, sf_dir).where("symbol = 'click'").toPandas()
    assert len(grid) == 11 * 5 and grid.n_trades.is_monotonic_increasing is False
    rr = catalogue.QUERIES["rr_sweep"](spark, sf_dir).where("symbol = 'click'").toPandas()
    assert len(rr) == 4 * len(RR) and (rr.wins + rr.losses <= rr.n_trades).all()


def test_quantiles_of_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), None if k % 7 == 0 else float(b), float("nan")) for k, (a, b) in enumerate(zip(rng.integers(0, 6, 500), rng.normal(size=500)))]
    got = {r["feature"]: r for r in audit.column_quantiles(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b"}
    for j, n in enumerate("ab"):
        x = np.array([r[j] for r in rows if r[j] is not None])
        assert (got[n]["n"], got[n]["n_distinct"]) == (len(x), len(set(x)))
        assert [got[n][q] for q in audit.SHARES] == pytest.approx(list(np.quantile(x, list(audit.SHARES.values()))))


def test_scores_by_group(spark):
    scores = spark.createDataFrame([("tf5_a", 0.4, 1), ("tf5_b", 0.2, 2), ("tf15_a", 0.1, 3), ("vol", 0.1, 4)], "feature string, mi double, rank int")
    names = ["tf5_a", "tf5_b", "tf15_a", "vol", "tfx_a"]
    assert audit.timeframe_groups(names) == {"tf5_a": "tf5", "tf5_b": "tf5", "tf15_a": "tf15"}
    got = {r["group"]: r for r in audit.group_scores(scores, audit.timeframe_groups(names)).collect()}
    assert got["tf5"]["n_cols"] == 2 and got["tf5"]["mean_mi"] == pytest.approx(0.3) and got["tf5"]["top_feature"] == "tf5_a" and got["tf5"]["share"] == pytest.approx(0.75)
    assert got["other"]["sum_mi"] == pytest.approx(0.1)


def test_probes_tell_useful_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.normal(size=1500) > 0).astype(int)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), *map(float, v), int(t), int(1 - t)) for k, (v, t) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, c double, d double, y int, z int")
    got = {(r["probe"], r["label"]): r for r in audit.probes(table, ["a", "b", "c", "d"], ["y", "z"], drop=2, tops=(1,), trials=1).collect()}
    assert {p for p, _ in got} == {"all", "without_last_2", "best_1", "dropout_0"}
    assert got["all", "y"]["auc"] > 0.9 and got["without_last_2", "y"]["auc"] > 0.9 and got["all", "z"]["auc"] == pytest.approx(got["all", "y"]["auc"], abs=0.01)
    assert 0.8 < got["best_1", "y"]["auc"] < got["without_last_2", "y"]["auc"] and got["dropout_0", "y"]["n_cols"] == 3
    assert audit.probes(table.limit(0), ["a"], ["y"]).count() == 0
