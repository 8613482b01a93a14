"""Decontamination, the filter audit and fill-in-the-middle against brute force over rows, their SQL and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from barwright.llm import decontamination, fill_in_middle, filter_audit
from barwright.llm.queries import ORACLES, QUERIES

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
LOWER = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

#: null ids, an id with several texts, repeated rows, nulls, empty texts, only white space, letters beyond ASCII and beyond 16 bits
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two."), (4, "one TWO."), (5, "Ä b\x0bc d"), (5, "Ä b\x0bc d"), (None, "lost id one two three"), (None, "lost id one two three"), (None, None), (6, "a <P> mark inside"), (7, "\U0001f600 smile\U0001f600 " * 30), (8, "tail   "), (9, "  head"), (10, "X" * 200)]


def clashing(spark, rows):
    """(doc_id, text, source) beside columns named like helpers, the row's number in each."""
    df = spark.createDataFrame([(i, t, "s" if k % 3 else None, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, nr int")
    names = ["id", "row", "h", "h1", "h2", "key", "salt", "task", "words", "n", "part", "at", "l", "k", "units", "head", "rest", "given", "form", "lo", "hi", "spans", "items", "hid", "hkey", "copies"]
    return df.select("*", *[F.col("nr").alias(c) for c in names])


def plain(row):
    return tuple(int(v) if isinstance(v, (bool, float)) and v == v else v for v in row)


def rows_of(df):
    return Counter(plain(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def sql_equals(spark, tmp_path, name, docs, **tables):
    """The registered query over given tables against its SQL."""
    con = duckdb.connect()
    for k, v in {"documents": docs, **tables}.items():
        v.write.parquet(f"{tmp_path}/{k}.parquet")
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{tmp_path}/{k}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({ORACLES[name]}) x").fetchall()
    assert rows_of(got) == Counter(map(plain, want))


# 11 decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOWER(text))


def brute_hits(docs, items, span):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - span + 1)) if w else []:
            windows[tuple(w[k : k + span])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                if (x := tuple(w[k : k + length])) in windows:
                    hit.update(range(k, k + length))
                    found |= windows[x]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def mixed(seed, n=60, m=12):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "é", "x1", "delta", "it's"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(k % 9, say(rng.choice([0, 1, 3, 5, 8, 20]))) for k in range(m)] + [(None, say(6)), (77, None), (78, "!!")]
    docs = [(k, say(rng.randrange(60)) + " " + (rng.choice(items)[1] or "").upper() + ", " + say(3)) for k in range(n)]
    return docs + ODD, items


@pytest.mark.parametrize("span,limit", [(4, 1 << 27), (10, 1 << 27), (4, 700)])
def test_contamination_is_brute_force(spark, span, limit):
    rng_docs, items = mixed(1)
    docs = clashing(spark, rng_docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench, span=span, broadcast_bytes=limit)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == brute_hits(rng_docs, items, span)


def test_blocks_do_not_hide_hits(spark):
    own = [f"w{k}" for k in range(3 * decontamination.BLOCK)]
    item = " ".join(f"q{k}" for k in range(10))
    docs = []
    for at in (0, 1, decontamination.BLOCK - 10, decontamination.BLOCK - 5, decontamination.BLOCK - 1, decontamination.BLOCK, 2 * decontamination.BLOCK - 3, len(own)):
        docs.append((at, " ".join(own[:at] + [item] + own[at:])))
    docs.append((99_999, " ".join(own[: decontamination.BLOCK])))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["n_hit"]) for r in got} == {(i, 10 if i != 99_999 else 0) for i, _ in docs}
    assert all(r["spans"][0]["lo"] == r["doc_id"] for r in got if r["n_hit"])


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "Keep this, " + item.upper() + "! and that."), (2, "clean"), (None, item), (None, None), (3, f"{item} x {item} eleven"), (3, "x"), (1, "Keep this, " + item.upper() + "! and that.")]
    docs, bench = clashing(spark, rows), spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["nr"] for r in kept.collect()) == [1, 3, 5]
    cut = decontamination.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert {r["nr"]: r["text"] for r in cut.collect()} == {0: "Keep this, and that.", 1: "clean", 2: "", 3: None, 4: "x eleven", 5: "x", 6: "Keep this, and that."}
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, bench, remove="all")


def test_contamination_without_items_or_documents(spark):
    docs, bench = clashing(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert len(got) == len(ODD) and all(r["n_hit"] == 0 and r["items"] == [] for r in got)
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_contamination_sql(spark, tmp_path):
    docs, items = mixed(4)
    sql_equals(spark, tmp_path, "op11_decontamination", clashing(spark, docs), benchmark=spark.createDataFrame([x for x in items if x[0] is not None], "item_id long, text string"))


# 12 filter audit


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[source or ""].append((i, {f for f, x in fails.items() if x}))
    out = []
    for part, docs in parts.items():
        removed = {(o, s): [(i, f) for i, f in docs if o[s] in f and not f & set(o[:s])] for o in permutations("ABCDE") for s in range(5)}
        shapley = Counter()
        for (o, s), gone in removed.items():
            shapley[o[s]] += len(gone)
        for (o, s), gone in removed.items():
            out.append((part, "".join(o), s + 1, sum(not f & set(o[: s + 1]) for _, f in docs), len(gone), sum(o[s] in f for _, f in docs) - len(gone), sum(f == {o[s]} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[o[s]]))
    return Counter(out)


def audited(seed):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 30, 49, 50, 51, 120]))) + rng.choice(["", " A#", " CAPITALS HERE AND THERE"]) for _ in range(40)]
    rows = [(k if k % 7 else k // 2, rng.choice(texts), rng.choice(["a", "b", None, ""])) for k in range(150)]
    rows += [(i, t, "odd") for i, t in ODD] + [(None, texts[0], "a")] * 3
    labels = [(rng.randrange(150), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    return rows, labels


def test_audit_is_brute_force(spark):
    rows, labels = audited(1)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(5)
    df = df.select("*", *[F.col("n").alias(c) for c in ("id", "part", "failed", "words", "word", "task", "h1", "A", "good", "copies")])
    got = filter_audit.audit(filter_audit.failure_sets(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Counter(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_sets(df), labels).count() == 0
    one = filter_audit.audit(filter_audit.failure_sets(spark.createDataFrame([(1, None, None)], df.schema)), labels)
    assert one.count() == 600 and {r["removed"] for r in one.where("filter_order LIKE 'A%' AND step = 1").collect()} == {1}


def test_audit_sql(spark, tmp_path):
    rows, labels = audited(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sql_equals(spark, tmp_path, "op12_filter_audit", docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


# 13 fill in the middle


def brute_fim(i, text):
    t = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    d = SHA(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, len(u), "plain", None, None, t, text
    lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:lo], u[lo:hi], u[hi:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, len(u), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def pieces(seed):
    rng = random.Random(seed)
    return ODD + [(k, "".join(rng.choice(["a", "<", "P", ">", " ", "\n", "é", "\U0001f600", "xy "]) for _ in range(rng.randrange(80)))) for k in range(300)] + [(k, "one two") for k in range(40)]


def test_fim_is_brute_force(spark):
    docs = pieces(3)
    df = clashing(spark, docs)
    got = fill_in_middle.transform(df)
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "given"]
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(brute_fim(i, t) for i, t in docs)
    assert got.where(~fill_in_middle.restore(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("given", F.lit("")))).count() == 0
    done = fill_in_middle.transform_documents(df)
    assert done.columns == df.columns
    assert {r["nr"]: (r["doc_id"], r["text"]) for r in done.collect()} == {k: (i, brute_fim(i, t)[5]) for k, (i, t) in enumerate(docs)}
    assert fill_in_middle.transform(df.limit(0)).count() == 0


def test_fim_percentages(spark):
    df = spark.createDataFrame([(k, "some words to move around") for k in range(400)], "doc_id long, text string")
    forms = lambda **o: Counter(r["form"] for r in fill_in_middle.transform(df, **o).select("form").collect())
    assert forms(fim_percent=0) == {"plain": 400} and forms(fim_percent=100, spm_percent=0) == {"psm": 400}
    usual = forms()
    assert 150 < usual["plain"] < 250 and usual["spm"] > 2 * usual["psm"] > 0


def test_fim_sql(spark, tmp_path):
    sql_equals(spark, tmp_path, "op13_fill_in_middle", clashing(spark, pieces(5)).select("doc_id", "text", "source"))


# all of them on a very long text


def test_texts_of_megabytes(spark):
    rng = random.Random(1)
    long = " ".join(f"word{rng.randrange(5000)}" for _ in range(400_000))
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    docs = spark.createDataFrame([(k, f"{long} {item} {k}") for k in range(10)], "doc_id long, text string")
    hit = decontamination.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["n_words"], r["n_hit"], len(r["spans"])) for r in hit} == {(400_012, 11, 1)}
    sets = filter_audit.failure_sets(docs.withColumn("source", F.lit("s"))).collect()
    assert {r["failed"] for r in sets} == {2}
    fim = fill_in_middle.transform(docs, fim_percent=100)
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["h"]) for r in fim.withColumn("h", F.sha2("output", 256)).drop("output", "rest", "given").collect()}
    for k in range(10):
        d = SHA(f"42:{k}")
        n = 400_012
        lo, hi = sorted(int(d[8 * j : 8 * j + 8], 16) % (n + 1) for j in range(2))
        u = re.findall(r"\s*\S+", f"{long} {item} {k}")
        assert (got[k][0], got[k][2], got[k][3]) == (n, len("".join(u[:lo])), len("".join(u[lo:hi])))
