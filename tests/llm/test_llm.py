"""Each operator against brute force, an exact round trip or held-out accuracy, and its defined edge cases."""

import bisect
import functools
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.llm import common, embedding_dedup, exact_dedup, license_scan, minhash_dedup, mixing, packing, sharding, substring_dedup, toxicity, warc
from barwright.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


EDGE = [(1, None, "s"), (2, "", "s"), (3, "   \n\t", None), (4, "One two.", "s"), (5, "one TWO.", "s"), (6, "word " * 30000 + "end.", "t"), (7, "ÄB", "t"), (8, "äB", "t"), (8, "äB", "t"), (None, "lost id", "t"), (9, "a b c d e f", "t")]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return df.withColumn("lang", F.lit("en")).withColumn("id", F.lit("x")).withColumn("h", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3))


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def components(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


# common


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components(edges, {n for e in edges for n in e})
    assert got == {n: c for n, c in want.items() if n in got}
    assert all(want[n] == n for n in want if n not in got)
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hubs_and_stars(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_EDGES", 50)
    monkeypatch.setattr(common, "HUBS", 5)
    rng = random.Random(8)
    edges = [(7, k) for k in range(1000, 1400)] + [(k, 9000 + k) for k in range(300)] + [(5000, k) for k in range(1300, 1700)] + [(rng.randrange(60000, 60040), rng.randrange(60000, 60300)) for _ in range(400)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components([e for e in edges if e[0] != e[1]], {n for e in edges if e[0] != e[1] for n in e})
    # a hub's edges keep the places that they are read at
    star = common.materialize(spark.range(0, 4000, 1, 8).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v")), "star")
    both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = common._with_least(both, 400).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in rows) == 8000 and max(r["count"] for r in rows) <= 2 * 8000 / 8


@pytest.mark.parametrize("bits", [1 << 6, 1 << 26])
def test_keep_rows_with_full_bitmaps(spark, monkeypatch, bits):
    """However many keys a bitmap holds wrongly, exactly the rows to go are gone."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    docs = clashing(spark, [(k if k % 5 else None, f"t{k % 90}", "s") for k in range(600)])
    rows = common.packed(docs, k1=F.col("doc_id"), k2=F.col("text"))
    gone = rows.where("k1 % 3 = 0 OR k2 = 't5'").select("k1", "k2").distinct()
    once = rows.groupBy("k1", "k2").count().where("count > 1 AND NOT (coalesce(k1, 1) % 3 = 0 OR k2 = 't5')").select("k1", "k2")
    got = common.keep_rows(rows, ["k1", "k2"], gone, once)
    want = {(k if k % 5 else None, f"t{k % 90}") for k in range(600) if not ((k % 5 and k % 3 == 0) or k % 90 == 5)}
    assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)


def test_dense_rank_has_no_gaps(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    got = common.dense_rank(df, ["k"], ["id"], "r", salts=7).toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g["r"]) == list(range(len(g)))


# 8 exact dedup


def brute_exact(rows):
    digest = lambda t: hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    return sorted((i, max((x for x in groups[digest(t)] if x is not None), default=None), len(groups[digest(t)]), digest(t)) for i, t in rows if i is not None)


@pytest.mark.parametrize("counters", [2, 512])
def test_exact_groups(spark, sf_dir, documents, counters):
    df = common.table(spark, sf_dir, "documents")
    got = exact_dedup.exact_groups(df, counters=counters).toPandas()
    want = brute_exact(list(zip(documents["doc_id"], documents["text"])))
    assert sorted(zip(got["doc_id"], got["keep_id"], got["group_size"], got["text_sha256"])) == want
    assert (got["kept"] == (got["doc_id"] == got["keep_id"])).all()


def test_exact_edges(edge, empty):
    got = exact_dedup.exact_groups(edge).toPandas()
    want = brute_exact([(i, t) for i, t, _ in EDGE])
    g = got[got["doc_id"].notna()]
    assert sorted(zip(g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"])) == want
    assert len(got) == len(EDGE) and exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [2, 3, 5, 6, 7, 8, 9]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["lost id"]


CLASH = ["__gone", "__bad", "__k", "__id", "__n", "__q", "row", "h", "k1", "k2", "copy", "whole", "keep_id", "text_sha256", "block", "ps"]


def clashing(spark, rows):
    """(doc_id, text, source) beside columns named like helpers, the row's number in each."""
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, nr int")
    return df.select("*", *[F.col("nr").alias(c) for c in CLASH])


#: null ids, an id with several texts, repeated rows, nulls and empty texts
ODD = [(5, "same text"), (None, "same text"), (None, "only here"), (None, "only here"), (7, "other"), (7, "same text"), (9, "same text"), (9, "same text"), (11, None), (12, ""), (None, None), (None, "a b c d e f g"), (13, "A B c d e f g"), (13, "nobody else says this")]


@pytest.mark.parametrize("counters", [2, 512])
def test_drop_copies_decides_by_row(spark, counters):
    df = clashing(spark, [(*r, "s") for r in ODD])
    for only in (df, df.where("nr < 6"), df.limit(0)):
        got = exact_dedup.drop_copies(only, counters=counters)
        assert got.columns == df.columns
        best = {}
        for r in only.collect():
            t = (r["text"] or "").lower()
            best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
        rows = got.collect()
        assert sorted(((r["text"] or "").lower(), -1 if r["doc_id"] is None else r["doc_id"]) for r in rows) == sorted(best.items())
        assert all((r["doc_id"], r["text"]) == ODD[r["nr"]] and {r[c] for c in CLASH} == {r["nr"]} for r in rows)


def test_drop_copies_with_hot_group(spark):
    rows = [(k if k % 3 else None, "hot" if k < 700 else f"own {k // 2}") for k in range(2000)]
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert sorted((t, -1 if i is None else i) for i, t in got) == sorted(best.items())


def test_misra_gries_keeps_frequent_values():
    rng = random.Random(1)
    values = ["hot"] * 400 + [f"v{rng.randrange(2000)}" for _ in range(800)]
    rng.shuffle(values)
    own = pd.Series(dtype="int64")
    for i in range(0, len(values), 100):
        own = exact_dedup.reduce_summary(own.add(pd.Series(values[i : i + 100]).value_counts(), fill_value=0), 4)
    assert len(own) <= 4 and "hot" in own.index


# 5 minhash


def brute_near(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    meet = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    edges = [(a, b) for (a, b), m in meet.items() if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m)]
    return sets, components(edges, set(sets))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, sf_dir, documents, percent):
    got = minhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), percent=percent).toPandas()
    sets, comp = brute_near(list(zip(documents["doc_id"], documents["text"])), percent)
    assert len(got) == len(documents)
    assert dict(zip(got["doc_id"], got["n_shingles"])) == {i: len(s) for i, s in sets.items()}
    assert dict(zip(got["doc_id"], got["component_id"])) == comp
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()


def test_near_chain_and_group(spark):
    """A chain of which only neighbours are linked, and copies of one text that are not all linked to each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(12):
        words = [*base]
        words[: 6 * k] = [f"c{j}" for j in range(6 * k)]
        rows.append((k, " ".join(words)))
    for k in range(60):
        words = [*base[::-1]]
        for _ in range(5):
            words[rng.randrange(400)] = f"z{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).toPandas()
    assert dict(zip(got["doc_id"], got["component_id"])) == brute_near(rows, 85)[1]


def test_near_edges(edge, empty):
    got = minhash_dedup.near_duplicates(edge, percent=85).toPandas()
    assert len(got) == len(EDGE) and minhash_dedup.near_duplicates(empty).count() == 0
    by = got[got["doc_id"].notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[[1, 2, 3], "n_shingles"].tolist() == [0, 0, 0] and by.loc[[1, 2, 3], "component_id"].tolist() == [1, 2, 3]
    assert by.loc[5, "component_id"] == 4 and by.loc[8, "component_id"] == 8 and by.loc[9, "n_shingles"] == 1
    lost = got[got["doc_id"].isna()].iloc[0]
    assert not lost["kept"] and pd.isna(lost["component_id"])
    assert minhash_dedup.drop_near_copies(edge).columns == edge.columns


def test_drop_near_copies_decides_by_row(spark):
    words = [f"w{k}" for k in range(100)]
    near = " ".join(["x" if k in (30, 60) else w for k, w in enumerate(words)])
    rows = [*ODD, (20, " ".join(words)), (20, "quite another text with the same id"), (21, near), (None, near), (None, near), (22, "short"), (None, "null ids alone say this here"), (None, "null ids alone say this here")]
    df = clashing(spark, [(*r, "s") for r in rows])
    sets, comp = brute_near([(k, t) for k, (_, t) in enumerate(rows)], 80)
    best = {}
    for k, (i, _) in enumerate(rows):
        c = comp[k] if sets[k] else ("empty", k)
        best.setdefault(c, []).append((i is None, i or 0))
    want = sorted(min(v) for v in best.values())
    got = minhash_dedup.drop_near_copies(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == want
    assert all((r["doc_id"], r["text"]) == rows[r["nr"]] for r in kept)
    each = minhash_dedup.near_duplicates(df, percent=80).collect()
    low = {c: min(v)[1] if not min(v)[0] else None for c, v in best.items()}
    named = sorted((str(rows[k][0]), len(sets[k]), str(low[comp[k] if sets[k] else ("empty", k)])) for k in range(len(rows)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in each) == named
    assert minhash_dedup.drop_near_copies(df.limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    bands, rows = minhash_dedup.band_plan(0.85)
    sk = minhash_dedup.Sketcher(bands, rows)
    rng = np.random.default_rng(0)
    limit = minhash_dedup.sketch_limit(0.85, bands * rows)
    for _ in range(30):
        both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = both[:925], both[75:]  # similarity 0.85
        x, y = (sk.odd_sketch(sk.samples(v)) for v in (a, b))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= limit
    far = sk.odd_sketch(sk.samples(rng.integers(0, 2**63, 900, dtype=np.uint64)))
    assert int(np.bitwise_count((x ^ far).view(np.uint64)).sum()) > limit


# 9 embeddings


def brute_vectors(rows, threshold):
    ok = {}
    for i, v, l in rows:
        if l is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        x = np.asarray(v, np.float64)
        ok[i] = (l, x / np.linalg.norm(x))
    edges, n = [], Counter()
    ids = list(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (la, x), (lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and float(x @ y) >= threshold:
                edges.append((a, b))
                n[a] += 1
                n[b] += 1
    comp = components(edges, {i for i, _, _ in rows})
    return sorted((i, n[i], comp[i]) for i, _, _ in rows)


def test_vectors(spark, sf_dir):
    df = common.table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = embedding_dedup.near_duplicate_vectors(df, threshold=0.98).toPandas()
    assert sorted(zip(got["vec_id"], got["n_links"], got["component_id"])) == brute_vectors(rows, 0.98)


def test_vector_groups_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 8, 1), (3, [1.0, None, *[0.0] * 6], 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (6, [1.0] * 8, None), (7, [1.0] * 8, 1), (8, [2.0] * 8, 1), (9, [1.0] * 8, 2), (10, [1.0] * 7, 1)]
    centre = rng.standard_normal(8)
    rows += [(100 + k, (centre + 0.045 * rng.standard_normal(8) * np.linalg.norm(centre)).tolist(), 1) for k in range(150)]
    rows += [(400 + k, centre.tolist(), 1) for k in range(30)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("x", F.lit(1))
    got = embedding_dedup.near_duplicate_vectors(df, threshold=0.98).toPandas()
    assert sorted(zip(got["vec_id"], got["n_links"], got["component_id"])) == brute_vectors(rows, 0.98)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_without_ids_and_other_labels(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.1]
    rows = [(None, v, 1), (None, w, 1), (3, v, 1), (5, w, 1), (5, [9.0, 1.0, 1.0, 1.0], 1), (6, v, 2), (None, [0.0, 0.0, 1.0, 0.0], 3), (None, [0.0, 0.0, 1.0, 0.01], 3), (7, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == sorted([("None", 3, "3", False)] * 2 + [("3", 3, "3", True), ("5", 3, "3", False), ("5", 0, "5", True), ("6", 0, "6", True), ("7", 0, "7", True)] + [("None", 1, "None", False)] * 2)


def test_codes_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    shape = embedding_dedup.Shape(64, *embedding_dedup.band_plan(10_000, 0.98))
    limit, lost = embedding_dedup.bit_limit(shape.rotations * 64, 0.98), 0
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    turn = embedding_dedup.rotations(64, shape.rotations)
    (a, f), (b, _) = (embedding_dedup.encode(v, turn) for v in (x, y))
    words, factors = shape.unpack(shape.pack(a, f))
    assert (shape.signs(words) == a).all() and np.abs(factors - f).max() < 1e-3
    assert ((a != b).sum(axis=1) <= limit).all() and limit < 64 * shape.rotations * 0.3
    parts = f.shape[1]
    estimate = (np.where(a, 1, -1) / np.repeat(f, 64, axis=1) * (y @ turn.T)).sum(axis=1) / (8 * parts)
    assert abs(estimate.mean() - 0.98) < 0.005  # unbiased
    bound = embedding_dedup.upper_bounds(a[:300], f[:300], (y @ turn.T)[:300], 64)
    assert (np.diag(bound) >= 0.98).all()


def test_pairs_within_groups():
    cuts = np.array([0, 1, 4, 4, 9, 11])
    want = [(i, j) for lo, hi in zip(cuts[:-1], cuts[1:]) for i in range(lo, hi) for j in range(i + 1, hi)]
    for most in (1, 3, 7, 100):
        assert [p for i, j in embedding_dedup.pairs_within(cuts, most) for p in zip(i.tolist(), j.tolist())] == want


# 1 substring


def brute_spans(rows):
    first, later = {}, defaultdict(set)
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for a, b, *h in substring_dedup.runs(substring_dedup.sentences(t)):
            if first.setdefault(tuple(h), (i, a)) != (i, a):
                later[i].update(range(a, b + 1))
    return later


def test_substring(spark, sf_dir, documents):
    got = substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents")).toPandas().set_index("doc_id")
    later = brute_spans(list(zip(documents["doc_id"], documents["text"])))
    for i, t in zip(documents["doc_id"], documents["text"]):
        parts = substring_dedup.sentences(t)
        assert "".join(parts) == t
        assert got.loc[i, "text"] == "".join(p for k, p in enumerate(parts) if k not in later[i])
        assert got.loc[i, "n_removed"] == len(later[i])


def test_passage_inside_sentences_is_found(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = ". ".join(say(12) for _ in range(5)) + ". "
    rows = [(k, f"{say(20)}. {say(4)} {passage}{say(5)}. {say(9)}.") for k in range(5)] + [(10, f"{say(12)}. {say(12)}. {say(12)}.")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.loc[0, "n_removed"] == 0 and got.loc[10, "n_removed"] == 0
    assert (got.loc[[1, 2, 3, 4], "n_removed"] >= 4).all()


def brute_repeats(rows):
    """(id, place) of sentences in any sequence of two or more sentences with MIN_WORDS words, of any length, of which an earlier copy exists; rows of (id, sentences)."""
    first, later = {}, set()
    for i, said in sorted(rows):
        for a in range(len(said)):
            for b in range(a + 1, len(said)):  # several sentences
                n = [len(x.split()) for x in said[a : b + 1]]
                if sum(n) >= substring_dedup.MIN_WORDS and first.setdefault(tuple(said[a : b + 1]), (i, a)) != (i, a):
                    later |= {(i, k) for k in range(a, b + 1)}
    return later


def test_substring_against_all_sequences(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    pool = [say(rng.choice([1, 2, 4, 6, 11, 12, 20, 23, 30, 53])) for _ in range(40)]
    rows = [(0, [say(9), say(53), say(6), say(9)])]
    rows.append((1, [say(8), *rows[0][1][1:3], say(8)]))
    for i in range(2, 60):
        at = [rng.randrange(40) for _ in range(3)]
        rows.append((i, [x for k in at for x in [*pool[k : k + rng.randrange(1, 6)], say(5)]]))
    later = brute_repeats(rows)
    assert {(1, 1), (1, 2)} <= later
    df = spark.createDataFrame([(i, " ".join(said)) for i, said in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {i: " ".join(x for k, x in enumerate(said) if (i, k) not in later).split() for i, said in rows}


def test_one_long_sentence_is_no_run(spark):
    long = " ".join(f"w{k}" for k in range(40)) + "."
    assert substring_dedup.runs([long]) == [] and substring_dedup.runs([long, long])[0][:2] == (0, 1)
    rows = [(1, f"First says this. {long} Then that."), (2, f"Second says other. {long} And so on.")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got["n_removed"].tolist() == [0, 0]


def test_two_short_sentences_are_a_run(spark):
    said = "One two three four five six. Seven eight nine ten eleven twelve. "
    rows = [(1, f"Some start. {said}Some end."), (2, f"Other start. {said}Other end."), (3, "Yes. No. Maybe so."), (4, "Yes. No. Or not.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {**dict(rows), 2: "Other start. Other end."}
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(df, min_words=1).collect()}
    assert got == {**dict(rows), 2: "Other start. Other end.", 4: "Or not."}


def test_substring_decides_by_row(spark):
    """An id with two texts: the copy loses its sentences, the other text nothing; null ids come last."""
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen."
    other = "Nobody else says these words here. They stand in one text only now. And they stay there for good."
    rows = [(1, passage), (3, f"Own start. {passage}"), (3, other), (None, f"{passage} Own end."), (None, None), (9, f"{passage} Twice."), (9, f"{passage} Twice.")]
    df = clashing(spark, [(*r, "s") for r in rows])
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect())
    assert got == Counter([(1, passage, 0), (3, "Own start. ", 3), (3, other, 0), (None, "Own end.", 3), (None, None, 0), (9, "Twice.", 3), (9, "Twice.", 3)])


def test_substring_edges(edge, empty):
    got = substring_dedup.substring_dedup(edge).toPandas()
    assert len(got) == len(EDGE) and substring_dedup.substring_dedup(empty).count() == 0
    assert got[got["doc_id"] == 1]["text"].isna().all()
    assert got[got["doc_id"].isna()]["text"].tolist() == ["lost id"]


# 3 toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.toxicity(common.table(spark, d, "documents"), common.table(spark, d, "labels")).toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    truth = common.table(spark, d, "labels").toPandas().set_index("doc_id")["toxic"]
    held = got[got["held_out"] & got["doc_id"].isin(truth.index)]
    y = truth.loc[held["doc_id"]].to_numpy()
    rank = held["score"].rank().to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93
    assert (held["predicted"].to_numpy() == y).mean() > 0.93


def test_toxicity_ignores_held_out_labels(spark, edge, empty):
    base = spark.createDataFrame([(k, "calm words here" if k % 3 else "rude words here", "s") for k in range(60)], "doc_id long, text string, source string")
    labels = base.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.fold_of("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(base, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert a["score"].tolist() == b["score"].tolist()
    got = toxicity.toxicity(edge, labels).toPandas()
    assert len(got) == len(EDGE) and got["score"].between(0, 1).all()
    none = toxicity.toxicity(edge, labels.limit(0)).toPandas()
    assert none["score"].between(0, 0.01).all()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.drop_toxic(edge, labels).columns == edge.columns


def test_toxicity_order_does_not_fall_with_size(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = [(k, " ".join("".join(rng.choices(letters, k=40)) for _ in range(50)), k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    seen, _, order = model["tables"].value
    assert order == toxicity.ORDER == 5 and seen[0].count("\n") > 500_000


def brute_word(counts, order, w):
    """log p(w | toxic) - log p(w | ordinary) by the definition, from counts {word: (ordinary, toxic)}; every sum is taken anew."""
    d, seen = 0.75, [Counter(), Counter()]
    for x, n in counts.items():
        s = f"^{x}$"
        for j in range(1, len(s)):
            for c in (0, 1):
                seen[c][s[max(0, j - order + 1) : j], s[j]] += n[c]
    types = {order: {k for c in (0, 1) for k in seen[c]}}
    for n in range(order - 1, 0, -1):  # contexts of n - 1 characters; shorter ones are whole beginnings and stay
        types[n] = {(h[-(n - 1) :] if n > 1 else "", x) if len(h) > n - 1 else (h, x) for h, x in types[n + 1]}
    letters = len({x for _, x in types[order]}) + 1

    def low(h, x, n):
        if n < 1:
            return 1 / letters
        short = h[-(n - 1) :] if n > 1 else ""
        ways = lambda hh, xx: len({g for g, y in types[n + 1] if y == xx and len(g) > n - 1 and (g[-(n - 1) :] if n > 1 else "") == hh})
        follow = {y for g, y in types[n + 1] if len(g) > n - 1 and (g[-(n - 1) :] if n > 1 else "") == short}
        below = low(short[1:] if len(short) == n - 1 else short, x, n - 1)
        total = sum(ways(short, y) for y in follow)
        if not total:
            return below
        return max(ways(short, x) - d, 0) / total + d * len(follow) / total * below

    out = 0.0
    s = f"^{w}$"
    for j in range(1, len(s)):
        h, x = s[max(0, j - order + 1) : j], s[j]
        p, lower = [], low(h, x, order - 1)
        for c in (0, 1):
            total = sum(v for (g, _), v in seen[c].items() if g == h)
            kinds = sum(v > 0 for (g, _), v in seen[c].items() if g == h)
            p.append(max(seen[c][h, x] - d, 0) / total + d * kinds / total * lower if total else lower)
        out += math.log(p[1] / p[0])
    return out


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    mild, rude = [["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(25)] for _ in range(2)]
    rows = [(k, " ".join(rng.choice(rude if k % 2 and rng.random() < 0.4 else mild) for _ in range(12)), k % 2) for k in range(150)]
    rows += [(1000, "", 0), (1001, "dadada qqq ab", 0), (1002, "...", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 1000").select("doc_id", "toxic"))
    counts = defaultdict(lambda: [0, 0])
    for i, t, y in rows:
        if i < 1000 and 0 < zlib.crc32(str(i).encode()) % 5 < 4:
            for w in t.split():
                counts[w][y] += 1
    each = {w: brute_word(counts, toxicity.ORDER, w) for w in {w for _, t, _ in rows for w in re.findall(r"\w+", t)}}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for i, t, _ in rows:
        v = [each[w] for w in re.findall(r"\w+", t)] or [0.0]
        x = [1, max(-5, min(5, sum(v) / len(v))), math.log1p(50 * sum(max(0, z - 1) for z in v) / len(v)), min(5, sum(max(0, z - 1) for z in v) / len(v))]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model["weights"])))), abs=1e-9)


def test_drop_toxic_decides_by_row(spark):
    rows = [(k, "calm words here" if k % 3 else "rude nasty stuff", "s") for k in range(120)]
    labels = spark.createDataFrame([(i, int("rude" in t)) for i, t, _ in rows], "doc_id long, toxic int")
    more = [(None, "rude nasty stuff", "s"), (None, "calm words here", "s"), (4, "rude nasty stuff", "s"), (3, "calm words here", "s"), (200, None, "s"), (201, "", "s")]
    df = clashing(spark, [*rows, *more])
    got = toxicity.drop_toxic(df, labels)
    assert got.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter((i, t) for i, t, _ in [*rows, *more] if "rude" not in (t or ""))
    assert toxicity.drop_toxic(df.limit(0), labels).count() == 0


def test_toxicity_model_is_bounded(spark, monkeypatch):
    """The sample of labelled rows is halved until its n-grams fit."""
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(12))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    usual = len(toxicity.unflat(toxicity.train(docs, labels)["tables"].value[0]))
    monkeypatch.setattr(toxicity, "GRAMS", usual // 3)
    few = len(toxicity.unflat(toxicity.train(docs, labels)["tables"].value[0]))
    assert 0 < few <= usual // 3 and toxicity.toxicity(docs, labels).count() == 300


def test_kneser_ney_probabilities_sum_to_one():
    """Over all characters after a context, both classes' probabilities sum to 1: checked through the ratio tables."""
    grams = pd.DataFrame([("^a", 5, 1), ("^b", 3, 3), ("^ab", 4, 0), ("^aa", 1, 1), ("ab$", 4, 1)], columns=["gram", "o", "t"])
    seen, unseen = toxicity.log_ratios(grams, 3)
    assert set(seen) == set(grams["gram"]) and seen["^ab"] < 0 < seen["^b"]
    assert unseen["^"] == pytest.approx(math.log((0.75 * 2 / 4) / (0.75 * 2 / 8)))


# 4 packing


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


def brute_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(got, rows):
    lengths = defaultdict(dict)
    for r in got.itertuples():
        lengths[r.doc_id][r.piece] = r
    for i, t in rows:
        ids = brute_ids(t)
        for p, at in enumerate(range(0, len(ids), 4096)):
            r, part = lengths[i][p], ids[at : at + 4096]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096


def test_packing(spark, sf_dir, documents):
    got = packing.pack(common.table(spark, sf_dir, "documents"), packing.tokenizer_file()).toPandas()
    check_packing(got, list(zip(documents["doc_id"], documents["text"])))
    least = -(-got["length"].sum() // 4096)
    assert got["sequence_id"].nunique() <= math.ceil(least * 1.02)


def test_packing_edges(spark, edge, empty):
    got = packing.pack(edge, packing.tokenizer_file(), keep_ids=True).toPandas()
    one = got[got["doc_id"].notna() & (got["doc_id"] != 8)]
    check_packing(one.assign(sequence_id=range(len(one)), offset=0), [(i, t) for i, t, _ in EDGE if i not in (None, 8)])
    assert len(got[got["doc_id"] == 8]) == 2 and len(got[got["doc_id"].isna()]) == 1
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    assert packing.pack(empty, packing.tokenizer_file()).count() == 0


def test_encoder_equals_tokenizer():
    enc = packing.worker_encoder(packing.tokenizer_file())
    assert enc is packing.worker_encoder(packing.tokenizer_file())
    rng = random.Random(4)
    pool = ["don't", "I'll", "''s", "re'rely", "a1b22", "½²", "ÀÉß", "µm", "ªº", "<|endoftext|>", "%%'s", " ", "\x85", "漢字", "İI", "é", "ﬁ", " ", "x\t\x0by", "__init__", "ÿ×÷", "'S 'T"]
    for _ in range(400):
        t = "".join(rng.choice([*pool, " ", "\n", "the", chr(rng.randrange(32, 0x250))]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == brute_ids(t)[:-1]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    hist = Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(3000))
    hist[4096] += 500 * seed
    places, sequences = packing.plan(dict(hist))
    used, took = defaultdict(list), Counter()
    for length, lo, n, first, offset in places:
        assert lo == took[length]
        took[length] += n
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert took == hist and len(used) == sequences
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(k * v for k, v in hist.items()) // 4096)
    assert sequences <= least * 1.02 + 2
    assert packing.plan({}) == ([], 0)


def best_fit(histogram, capacity=4096):
    """Sequences that best fit takes, longest first, one piece at a time."""
    rooms, used = [], 0
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        used += room == capacity
        if room > length:
            bisect.insort(rooms, room - length)
    return used


@pytest.mark.parametrize("seed", range(4))
def test_plan_takes_no_more_than_best_fit(seed):
    rng = random.Random(seed)
    kinds = [
        [rng.randrange(1, 4097) for _ in range(1500)],
        [rng.randrange(900, 2600) for _ in range(1500)],
        [max(1, min(4096, int(rng.gauss(1500, 200)))) for _ in range(4000)],
        [min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(2000)],
        [x for x in rng.sample(range(800, 3000), 5) for _ in range(rng.randrange(1, 400))],
        [1], [4096, 4096, 1], [2048] * 7, [1366] * 10,
    ]
    better = 0
    for lengths in kinds:
        took, alone = packing.plan(dict(Counter(lengths)))[1], best_fit(Counter(lengths))
        assert took <= alone
        better += took < alone
    assert better >= 2


def test_packing_against_best_fit_of_documents(documents):
    lengths = [n for t in documents["text"] for n in [len(brute_ids(t))]]
    pieces = Counter(min(4096, n - at) for n in lengths for at in range(0, n, 4096))
    assert packing.plan(dict(pieces))[1] <= best_fit(pieces)


# 6 warc


def test_warc_round_trip(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    more = spark.createDataFrame([(-1, "u\r\nv", None), (-2, None, ""), (-3, "x", "ä" * 100000), (-4, "y", "ä" * 100000), (-5, None, "\x1f\u008b\x08")], "page_id long, url string, html string")
    rows = pages.unionByName(more).withColumn("h", F.lit(1)).withColumn("id", F.lit("z"))
    got = warc.round_trip(rows).toPandas().set_index("page_id")
    want = {r["page_id"]: (r["html"] or "").encode() for r in rows.collect()}
    last = {}
    for i in sorted(want):
        last[want[i]] = i
    assert len(got) == len(want)
    for i, body in want.items():
        r = got.loc[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), warc.sha1_base32(body))
        assert r["record_type"] == ("response" if last[body] == i else "revisit")
        assert pd.isna(r["refers_to"]) if last[body] == i else r["refers_to"] == last[body]
    assert got["digest_verified"].all()
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_warc_null_and_repeated_ids(spark):
    rows = [(None, "u", "one"), (4, "u", "one"), (4, "v", "two"), (9, "w", "one"), (9, "w", "one"), (None, None, "lost"), (None, None, "lost"), (2**60 + 1, "b", "two")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    one, two, lost = ((len(t), warc.sha1_base32(t.encode())) for t in ("one", "two", "lost"))
    big = 2**60 + 1
    assert got == Counter([(None, *one, "revisit", 9), (4, *one, "revisit", 9), (4, *two, "revisit", big), (9, *one, "response", None), (9, *one, "response", None), (None, *lost, "response", None), (None, *lost, "response", None), (big, *two, "response", None)])


def test_every_range_size_reads_each_record_once():
    rng = random.Random(0)
    trap = bytes(rng.randrange(256) for _ in range(500)) + warc.MAGIC * 20
    blocks = [b"", b"a" * 5000, trap, rng.randbytes(9000), b"WARC/1.1"]
    data = b"".join(warc.record("response", f"urn:page:{k}", "u", "D", b) for k, b in enumerate(blocks * 3))
    broken = data[:200] + b"\0" * 30 + data[230:]
    for text, n in ((data, 15), (data + b"junk" + warc.MAGIC, 15)):
        for size in (1, 7, 100, 4096, 10**6):
            got = [h["warc-record-id"] for lo in range(0, len(text), size) for _, h, _ in warc.records_in(io.BytesIO(text), len(text), lo, lo + size)]
            assert len(got) == n and got == [f"<urn:page:{k}>" for k in range(15)], size
    assert len(list(warc.records_in(io.BytesIO(broken), len(broken), 0, len(broken)))) in (13, 14)


# 7 sharding


def test_sharding(spark, sf_dir, documents):
    got = sharding.balanced_shards(common.table(spark, sf_dir, "documents")).toPandas()
    n = got.groupby("shard")["doc_id"].count().reindex(range(24), fill_value=0)
    assert n.max() - n.min() <= 1 and len(got) == len(documents)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = documents.set_index("doc_id")["text"]
    for r in got.itertuples():
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(b) + 8, zlib.crc32(b))
    shard = got.set_index("doc_id")["shard"]
    groups = documents.groupby("text")["doc_id"].apply(list)
    groups = [g for g in groups if 1 < len(g) <= 20]
    assert sum(len(set(shard[g])) == 1 for g in groups) >= 0.95 * len(groups)


def test_sharding_hot_group_and_edges(spark, edge, empty):
    rows = [(k, "same" if k < 900 else f"own {k}") for k in range(2000)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    n = got.groupby("shard")["doc_id"].count()
    assert len(n) == 24 and n.max() - n.min() <= 1
    assert got[got["doc_id"] < 900]["shard"].nunique() < 24
    got = sharding.balanced_shards(edge).toPandas()
    assert len(got) == len(EDGE) and (got[got["doc_id"] == 1]["size"] == 8).all() and (got["slot"] == 0).all()
    assert sharding.balanced_shards(empty).count() == 0


def test_groups_that_fit_a_shard_stay_whole(spark):
    rows, sizes = [], {}
    for g, n in enumerate([60, 55, 70, 83] + [3] * 100):
        sizes[f"group {g}"] = n
        rows += [(len(rows) + k, f"group {g}") for k in range(n)]
    rows += [(k, f"own {k}") for k in range(len(rows), 2000)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    n = got.groupby("shard").size()
    assert len(n) == 24 and n.max() - n.min() <= 1
    at = defaultdict(set)
    for k, t in rows:
        at[t].add(got.loc[k, "shard"])
    assert all(len(at[t]) == 1 for t in sizes)


def test_propagation_moves_documents_under_quotas(spark):
    hubs = spark.createDataFrame([(bytes([k // 256, k % 256]), 0, 4 + k % 3) for k in range(400)], "h binary, p int, n long")
    total = sum(4 + k % 3 for k in range(400))
    quotas = [total // 8 + (s < total % 8) for s in range(8)]
    begun = common.materialize(sharding.start_apart(hubs, total, quotas), "test")
    spread = lambda df: (df.toPandas().groupby("h")["shard"].nunique() == 1).mean()
    count = lambda df: df.toPandas().groupby("shard")["n"].sum().reindex(range(8), fill_value=0).tolist()
    assert count(begun) == quotas and spread(begun) < 0.05
    done = sharding.propagate(begun, quotas)
    assert count(done) == quotas and spread(done) > 0.85
    assert sharding.flows([[0, 5], [2, 0]], [10, 10], [10, 11]) == [[0, 3], [2, 0]]


def test_cut_edges_fall_round_by_round(spark):
    hubs = spark.createDataFrame([(bytes([k // 256, k % 256]), 0, 3 + k % 5) for k in range(300)], "h binary, p int, n long")
    total = sum(3 + k % 5 for k in range(300))
    quotas = [total // 6 + (s < total % 6) for s in range(6)]
    begun = common.materialize(sharding.start_apart(hubs, total, quotas), "test")
    cut = lambda df: sum(int(g.sum() - g.max()) for _, g in df.toPandas().groupby("h")["n"])  # noqa: E731  documents apart from their hub's most
    cuts = [cut(begun), *[cut(sharding.propagate(begun, quotas, r)) for r in (1, 2, 4, 8)]]
    assert all(b < a for a, b in zip(cuts, cuts[1:])) and cuts[-1] < cuts[0] / 5


# 10 mixing


def test_alpha():
    tokens = [900, 80, 20]
    shares = [t / 1000 for t in tokens]
    a = mixing.fit_alpha(tokens, 1000, 0.8, 1e9)
    assert mixing.entropy(mixing.weights_at(shares, a)) == pytest.approx(0.8, abs=1e-9)
    b = mixing.fit_alpha(tokens, 1000, 0.8, 2.0)
    assert b > a and max(w * 1000 / t for w, t in zip(mixing.weights_at(shares, b), tokens)) <= 2.0 + 1e-9
    assert mixing.fit_alpha(tokens, 1000, None, 5) == 1.0 and mixing.fit_alpha(tokens, 9000, 0.8, 2.0) == 1.0
    assert mixing.fit_alpha(tokens, 1000, 9.0, 1e9) == 0.0


def brute_mix(got, rows):
    """Quotas, whole epochs and the last epoch's prefix, from the emitted order."""
    tokens = defaultdict(dict)
    for k, (i, t, s) in enumerate(rows):
        tokens[s][k] = (i, max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))))
    totals = sorted(((s, sum(n for _, n in d.values())) for s, d in tokens.items()), key=lambda r: (r[0] is not None, r[0] or ""))
    for source, total, weight, quota, whole, rest, alpha in mixing.source_plan(totals, None, 0.5, 4.0):
        own = got[got["source"].isna()] if source is None else got[got["source"] == source]
        ids = sorted((str(i), n) for i, n in tokens[source].values())
        for e in range(whole):
            part = own[own["epoch"] == e]
            assert sorted((str(None if pd.isna(i) else int(i)), n) for i, n in zip(part["doc_id"], part["n_tokens"])) == ids
        last = own[own["epoch"] == whole].sort_values(["block_order", "block", "doc_order"])
        assert last["n_tokens"].sum() <= rest
        assert len(own) == whole * len(ids) + len(last)
        missing = [n for _, n in ids]
        for n in last["n_tokens"]:
            missing.remove(n)
        # within a block the prefix stops at the first document that would pass the quota
        assert not missing or last["n_tokens"].sum() + max(missing) > rest
        assert np.allclose(own["weight"], weight) and np.allclose(own["alpha"], alpha)


def test_mixing(spark, sf_dir, documents):
    got = mixing.mix(common.table(spark, sf_dir, "documents")).toPandas()
    brute_mix(got, list(zip(documents["doc_id"], documents["text"], documents["source"])))


def test_mixing_edges(spark, edge, empty):
    got = mixing.mix(edge).toPandas()
    brute_mix(got, EDGE)
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    rows = mixing.mix_documents(edge)
    assert rows.columns == edge.columns and rows.count() == len(got)


def test_mixing_with_few_parts_and_small_budgets(spark, sf_dir, documents):
    """Every quota ends at the document that would pass it, wherever blocks and parts lie."""
    rows = [(k, "word " * (1 + k % 7), f"s{k % 3 if k % 4 else 0}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget, blocks in ((1, 256), (50, 2), (700, 8), (5000, 1)):
        got = mixing.mix(df, budget=budget, blocks=blocks).toPandas()
        totals = sorted((s, sum(1 + k % 7 for k, _, x in rows if x == s)) for s in ("s0", "s1", "s2"))
        for source, total, weight, quota, whole, rest, alpha in mixing.source_plan(totals, budget, 0.5, 4.0):
            own = got[got["source"] == source]
            assert own["n_tokens"].sum() <= quota and own["n_tokens"].sum() + 7 > quota
            last = own[own["epoch"] == whole]
            order = sorted((r for r in rows if r[2] == source), key=lambda r: r[0])
            assert (own.groupby("doc_id").size() >= whole).all() and len(own) == whole * len(order) + len(last)


def test_mix_documents_gives_each_row_its_copies(spark):
    rng = random.Random(8)
    rows = [*[(i, t, "s") for i, t in ODD], *[(k % 40 if k % 5 else None, "word " * rng.randrange(1, 9), f"s{k % 3}") for k in range(300)]]
    df = clashing(spark, rows)
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    copies, want = Counter(r["nr"] for r in got.collect()), Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["n_tokens"], r["source"]] += 1
    have = Counter()
    for k, n in copies.items():
        i, t, s = rows[k]
        have[i, max(1, len((t or "").split())), s] += n
    assert have == want
    same = defaultdict(set)
    for k, r in enumerate(rows):
        same[r].add(copies[k])
    assert all(len(v) == 1 for v in same.values())


# 2 license scan


def brute_license(rows, threshold=license_scan.THRESHOLD):
    """Own licences of (path, text): lines, windows and blocks of lines with terms, and whole texts, all against all templates."""
    lines = [license_scan.terms(x) for _, t in rows if t is not None for x in t.split("\n")]
    lines = [x for x in lines if x]
    df = Counter(t for x in lines for t in x)
    weights = license_scan.template_weights(df, len(lines), license_scan.TEMPLATES)
    size = {}
    out = {}
    for path, text in rows:
        said = [license_scan.terms(x) for x in (text or "").split("\n")]
        filled = [x for x in said if x]
        units = [*filled, sum(filled, Counter()), *[sum(filled[k : k + n], Counter()) for n in license_scan.WINDOWS for k in range(max(1, len(filled) - n + 1))]]
        block = Counter()
        for x in [*said, Counter()]:
            if not x and block:
                units.append(block)
            block = block + x if x else Counter()
        best = None
        for unit in units:
            w = {t: n * size.setdefault(t, license_scan.idf(df[t], len(lines))) for t, n in unit.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for (name, _), tw in weights.items():
                dot = sum(x * tw[t] for t, x in w.items() if t in tw) if not w.keys().isdisjoint(tw) else 0
                if norm and dot / norm >= threshold and (best is None or (-round(dot / norm, 9), name) < best):
                    best = (-round(dot / norm, 9), name)
        if best:
            out[path] = (best[1], pytest.approx(-best[0], abs=1e-8))
    return out


def test_license_own(spark, documents):
    rows = [(str(i), t) for i, t in zip(documents["doc_id"], documents["text"])]
    got = license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).toPandas()
    own = got[got["origin"].isin(["header", "file"])]
    assert {r.path: (r.license, r.score) for r in own.itertuples()} == brute_license(rows)
    assert len(own) > 10


def test_license_weighs_common_words_by_their_frequency(spark):
    rows = [(f"t/{k}", f"the team says hello by x{k}") for k in range(200)] + [("c/x.c", "Released under the MIT License, by team says hello")]
    lines = [set(re.findall("[a-z0-9]+", t.lower())) for _, t in rows]
    weigh = lambda t: math.log((1 + len(lines)) / (1 + sum(t in x for x in lines))) + 1
    size = lambda x: sum(weigh(t) ** 2 for t in x)
    want = math.sqrt(size(["released", "under", "the", "mit", "license"]) / size(lines[-1]))
    got = license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).where("license IS NOT NULL").collect()
    assert [(r["path"], r["license"], r["score"]) for r in got] == [("c/x.c", "MIT", pytest.approx(want, abs=1e-8))]


def test_license_of_long_files(spark):
    """A file of 10,000 lines with a notice in every tenth, and one of 3,000 lines of notices without an empty one, against brute force."""
    rng = random.Random(4)
    notice = ["SPDX-License-Identifier: MIT", "// Licensed under the Apache License, Version 2.0 (the License);", "released under the terms of the GNU General Public License"]
    line = lambda: " ".join(rng.choice(["int", "x", "return", "value", "the", "for", "under"]) for _ in range(rng.randrange(6)))
    long = "\n".join(rng.choice(notice) if k % 10 == 3 else line() for k in range(10_000))
    dense = "\n".join(rng.choice(notice) for _ in range(3000))
    rows = [("a/long.c", long), ("b/dense.c", dense), ("b/other.c", "nothing here")]
    got = license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).toPandas()
    own = got[got["origin"].isin(["header", "file"])]
    assert {r.path: (r.license, r.score) for r in own.itertuples()} == brute_license(rows)


def test_license_inheritance_and_edges(spark):
    t = license_scan.TEMPLATES
    rows = [("LICENSE", t["MIT"][0]), ("a/x.c", "int x;"), ("a/b/COPYING", t["GPL-3.0"][0] + ".\nmore of it"), ("a/b/c/y.c", "int y;"), ("a/b/z.c", "# " + t["Apache-2.0"][0]), ("n/empty", ""), ("n/null", None), (None, "x"), ("a/x.c", "int x;"), ("d/long", "word " * 50000)]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("term", F.lit(1)).withColumn("name", F.lit(2))
    got = {r["path"]: (r["license"], r["origin"], r["from_path"]) for r in license_scan.license_scan(df).collect()}
    assert got == {
        "LICENSE": ("MIT", "file", "LICENSE"), "a/x.c": ("MIT", "inherited", "LICENSE"), "a/b/COPYING": ("GPL-3.0", "file", "a/b/COPYING"), "a/b/c/y.c": ("GPL-3.0", "inherited", "a/b/COPYING"),
        "a/b/z.c": ("Apache-2.0", "file", "a/b/z.c"), "n/empty": ("MIT", "inherited", "LICENSE"), "n/null": ("MIT", "inherited", "LICENSE"), None: (None, "none", None), "d/long": ("MIT", "inherited", "LICENSE"),
    }
    assert license_scan.license_scan(df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
HEADER = """#!/usr/bin/env python
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os


def names(folder):
    found = []
    for entry in sorted(os.listdir(folder)):
        path = os.path.join(folder, entry)
        if os.path.isdir(path):
            found.extend(names(path))
        elif entry.endswith(".py"):
            found.append(path)
    return found
"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""


def test_license_files_and_wrapped_headers(spark):
    rows = [("m/LICENSE", MIT), ("m/deep/er/x.c", "int x;"), ("g/COPYING", GPL), ("g/y.c", "int y;"), ("h/run.py", HEADER), ("a/LICENSE.txt", APACHE), ("s/t.c", "// SPDX-License-Identifier: GPL-2.0-only\nint t;"), ("o/LICENSE", "All rights are ours and you may not have any.")]
    rows += [(f"p/{k}.txt", f"some words of this {k} and the rest of it, to be used by you or not") for k in range(200)]
    got = {r["path"]: (r["license"], r["origin"], r["from_path"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["m/LICENSE"] == ("MIT", "file", "m/LICENSE") and got["m/deep/er/x.c"] == ("MIT", "inherited", "m/LICENSE")
    assert got["g/COPYING"] == ("GPL-3.0", "file", "g/COPYING") and got["g/y.c"] == ("GPL-3.0", "inherited", "g/COPYING")
    assert got["h/run.py"][:2] == ("GPL-3.0", "header") and got["a/LICENSE.txt"][0] == "Apache-2.0" and got["s/t.c"][0] == "GPL-2.0"
    assert got["o/LICENSE"][0] is None and all(got[f"p/{k}.txt"][0] is None for k in range(200))


def test_license_of_files_without_a_path(spark, tmp_path):
    t = license_scan.TEMPLATES
    rows = [(None, t["MIT"][0]), (None, "no licence"), (None, None), ("a/x", None), ("LICENSE", t["GPL-3.0"][0])]
    got = Counter((r["path"], r["license"], r["origin"], r["from_path"]) for r in license_scan.license_scan(clash_paths(spark, rows)).collect())
    assert got == Counter([(None, "MIT", "header", None), (None, None, "none", None), (None, None, "none", None), ("a/x", "GPL-3.0", "inherited", "LICENSE"), ("LICENSE", "GPL-3.0", "file", "LICENSE")])
    docs = spark.createDataFrame([(None, t["MIT"][0], "s", None), (3, "x", None, "en"), (3, t["MIT"][0], None, "en")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["license"]) for r in license_scan.op2_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, "MIT"), (3, "MIT")], key=str)


def clash_paths(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("file", "row", "kind", "unit", "term", "name", "k", "at", "said", "filled", "rank")])


# the pipeline and the queries


def test_pipeline_against_its_stages_brute_force(spark, sf_dir):
    import corpus_pipeline as cp

    docs = common.table(spark, sf_dir, "documents")
    for name, stage in cp.STAGES:
        before = docs.toPandas()
        out = common.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        after = out.toPandas()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "exact_dedup":
            assert sorted(after["doc_id"]) == sorted({k for _, k, _, _ in brute_exact(list(zip(before["doc_id"], before["text"])))})
        if name == "near_dedup":
            comp = brute_near(list(zip(before["doc_id"], before["text"])), 80)[1]
            assert sorted(after["doc_id"]) == sorted(set(comp.values()))
        if name == "mixing":
            brute = mixing.mix(docs).toPandas()
            assert Counter(after["doc_id"]) == Counter(brute["doc_id"])
        if name == "packing":
            seq = after.groupby("sequence_id")["length"].sum()
            assert seq.max() <= 4096 and after["length"].sum() == sum(len(brute_ids(t)) for t in before["text"])
        docs = out


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Null and repeated ids, repeated rows, empty texts, other columns with helpers' names; and no rows at all."""
    import corpus_pipeline as cp

    long = [(None, " ".join(f"w{k}" for k in range(30))), (40, " ".join(f"w{k}" for k in range(29))), (41, " ".join(f"w{k}" for k in range(30)))]
    df = clashing(spark, [(*r, "s") for r in ODD + long])
    common.table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    for k, only in enumerate((df, df.limit(0))):
        docs = only
        for name, stage in cp.STAGES:
            out = common.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert out.columns == df.columns
                assert all(r["nr"] == r[c] for r in out.collect() for c in CLASH)
            if name == "exact_dedup":
                assert sorted((r["text"] or "").lower() for r in out.collect()) == sorted({(r["text"] or "").lower() for r in docs.collect()})
            if name == "near_dedup":
                left = Counter(r["text"] for r in out.collect())
                assert max(left.values(), default=1) == 1 and sum(left[t] for _, t in long) == (1 if not k else 0)
            docs = out
        only.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        common.table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        whole = cp.run(spark, f"{tmp_path}/{k}")
        assert whole.columns == docs.columns and whole.count() == docs.count() and (docs.count() > 0) == (k == 0)


def test_pipeline_drops_near_copies_from_80_percent(spark, sf_dir):
    import corpus_pipeline as cp

    words = [f"w{k}" for k in range(100)]
    changed = lambda at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # each word changed costs 5 of 96 shingles: Jaccard 86/106 = 0.81 and 81/111 = 0.73
    df = spark.createDataFrame([(1, changed([])), (2, changed([30, 60])), (3, changed([20, 40, 80]))], "doc_id long, text string")
    for out in (cp.near(spark, df, sf_dir), minhash_dedup.drop_near_copies(df)):
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


@pytest.mark.parametrize("name", ["op2_license_scan", "op6_warc"])
def test_queries_return_whole_tables(spark, sf_dir, name, documents):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) == (len(documents) if "license" in name else common.table(spark, sf_dir, "pages").count())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, spark.createDataFrame(want.select(*columns).fetchall(), got.select(columns).schema).collect()))
