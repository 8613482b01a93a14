"""Information by nearest neighbours against a brute-force count, on continuous values, heaps of ties and edges."""

import math
import random

import numpy as np
import pytest

from barwright.operators.neighbours import DIGAMMA, EXACT, neighbour_information


def psi(n):
    return sum(1 / j for j in range(1, n)) - 0.5772156649015329


def brute(pairs, k):
    """The estimate from all distances; pairs of whole numbers and labels."""
    sizes = {y: sum(b == y for _, b in pairs) for y in {b for _, b in pairs}}
    pairs = [(q, y) for q, y in pairs if sizes[y] > 1]
    q, y = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs])
    total = 0.0
    for i in range(len(q)):
        d = np.abs(q - q[i])
        own = min(k, sizes[int(y[i])] - 1)
        r = np.sort(d[y == y[i]])[own]  # its own zero comes first
        if r == 0:
            total += psi(int((d[y == y[i]] == 0).sum())) - psi(int((d == 0).sum()))
        else:
            total += psi(own) - psi(int((d < r).sum()))
        total -= psi(sizes[int(y[i])])
    return max(0.0, total / len(q) + psi(len(q)))


def frame(spark, pairs):
    return spark.createDataFrame([(None if q is None else q / 1000, y) for q, y in pairs], "a double, y int")


def cases():
    rng = random.Random(5)
    normal = [(round(rng.gauss(y, 1) * 1000), y) for y in (rng.randrange(3) for _ in range(2000))]
    heaps = [(rng.choice([0, 0, 0, 1, 2, 5000]) if rng.random() < 0.7 else rng.randrange(-40, 40), rng.randrange(2)) for _ in range(1500)]
    few = [(rng.randrange(50), y) for y in (0, 0, 1, 1, 1, 2)] + [(7, 3)]
    apart = [(1000 * i, 0) for i in range(300)] + [(1000 * i + 1, 1) for i in range(5)]
    return {"normal": normal, "heaps": heaps, "few": few, "apart": apart}


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("name", sorted(cases()))
def test_equals_brute_force(spark, name, parts):
    pairs = cases()[name]
    for k in (1, 3):
        got = neighbour_information(frame(spark, pairs), ["a"], "y", k=k, unit=1e-3, parts=parts).first()
        assert abs(got["mi"] - brute(pairs, k)) < 1e-6 and got["n"] == sum([b for _, b in pairs].count(y) > 1 for _, y in pairs)


def test_any_partitions_give_the_same(spark):
    """Columns so long that the ranges' ends are approximate, over many tasks."""
    table = spark.range(0, 60_000, 1, 40).selectExpr("CAST(hash(id) AS DOUBLE) / 1000 + id % 2 * 500000 AS a", "floor(sqrt(id * 7919 % 60000)) AS b", "CAST(id % 2 AS INT) AS y")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        got = [neighbour_information(table, ["a", "b"], "y", unit=1e-3, parts=parts).orderBy("feature").collect() for parts in (1, 64)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert got[0] == got[1] and got[0][0]["n"] == 60_000 and got[0][0]["mi"] > 0.01


def test_known_information(spark):
    rng = random.Random(6)
    rows = [(float(i % 2), rng.random(), 1.0, None if i % 3 else i % 2 + rng.random() / 2, i % 2) for i in range(1200)]
    table = spark.createDataFrame(rows, "same double, noise double, constant double, gaps double, y int")
    got = {r["feature"]: r for r in neighbour_information(table, ["same", "noise", "constant", "gaps"], "y").collect()}
    assert abs(got["same"]["mi"] - math.log(2)) < 0.01 and abs(got["gaps"]["mi"] - math.log(2)) < 0.01
    assert got["constant"]["mi"] < 1e-3 and got["noise"]["mi"] < 0.05 and got["gaps"]["n"] == 400
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4]


def test_nothing_to_compare(spark):
    pairs = [(None, 0), (None, 1)]
    assert not neighbour_information(frame(spark, pairs), ["a"], "y").count()
    assert not neighbour_information(frame(spark, [(1, 0), (2, 1)]), ["a"], "y").count()  # labels of one row
    assert not neighbour_information(frame(spark, []), ["a"], "y").count()
    odd = frame(spark, [(1, 0), (2, 0), (3, None)]).selectExpr("IF(a > 0.0015, double('NaN'), a) AS a", "y")
    assert not neighbour_information(odd, ["a"], "y").count()


def test_digamma(spark):
    got = spark.range(1, 200).selectExpr("id", DIGAMMA.format(n="CAST(id AS DOUBLE)") + " AS v").collect()
    assert all(abs(r["v"] - psi(r["id"])) < 1e-13 for r in got) and EXACT < 200
