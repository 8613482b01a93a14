"""What of the candidates for near copies reaches the full sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from barwright.llm import minhash_dedup
from barwright.llm.minhash_dedup import Sketcher, fine_words
from test_llm import brute_near


def family(size, seed=1, words=400, own=30):
    """Texts with 30 words of their own at different places of one text of 400: any two are alike by about 0.7."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    out = []
    for k in range(size):
        at = rng.randrange(words - own)
        out.append(" ".join([*base[:at], *(f"x{k}.{j}" for j in range(own)), *base[at + own :]]))
    return out


def test_families_below_the_threshold_stay_out_of_full_sets(spark, monkeypatch):
    texts = family(40)
    rows = [*enumerate(texts), *((100 + k, f"{t} more words") for k, t in enumerate(texts[:4])), (200, texts[5]), (201, None)]
    met, confirm = [], minhash_dedup._confirm

    def counted(pairs, *rest):
        met.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(minhash_dedup, "_confirm", counted)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).toPandas()
    sets, comp = brute_near(rows, 80)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == comp
    near = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and a and a != b)
    assert 0 < sum(met) <= near + 20  # the two sketch tests alone let hundreds of pairs pass


def test_fine_sketches_reject_no_pair_wrongly(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 2, 5, 60, 127, 128, 129, 400, 511, 512, 513, 3000, 9000):
        for apart in (0, 0.05, 0.11, 0.15, 0.2, 0.25, 0.3, 0.5, 0.8):
            for more in (0, 1, n // 5, n):  # the sizes differ, and with them the sketches' lengths
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[round(apart * n) :], rng.integers(0, 2**63, more, dtype=np.uint64)]))
                if len(b):
                    meet = len(np.intersect1d(a, b))
                    rows.append((n, meet / (len(a) + len(b) - meet), len(a), len(b), *(Sketcher.parity(x, fine_words(len(x))).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "n long, alike double, an long, bn long, ao array<long>, bo array<long>")
    for percent in (30, 50, 80, 85):
        got = df.withColumn("passes", minhash_dedup._fine(percent)).collect()
        assert all(r["passes"] for r in got if r["alike"] >= percent / 100)
        if percent >= 80:
            assert not any(r["passes"] for r in got if r["alike"] < percent / 100 - 0.08 and r["n"] >= 400)
    assert df.where(F.size("ao") != F.size("bo")).count() > 20
