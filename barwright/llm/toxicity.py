"""Toxicity from two class-conditional Kneser-Ney models.

The models run over the characters of words, so a rare expression is judged by
its stem. Each class has its own n-gram counts of the highest order and backs
off to lower orders of continuation counts that both classes share. A
document's evidence is its toxic minus its ordinary log-likelihood per word,
together with the part of it above one nat per word, which short outbursts in
long texts need. A logistic curve, fitted on labelled rows whose counts the
models have not seen, turns both into a score.

For an n-gram that no class has seen, both classes back off to the same lower
order, which cancels in the difference: only the contexts' back-off masses stay.
So the tables of the highest order are all that scoring needs. The order is fixed
and no n-gram is left out: the tables are as large as the n-grams of the rows
learned from, whose number TRAINING bounds.

Rows learned from: labelled (0 or 1), known text, and crc32(id) mod 5 not 0, at
most TRAINING of them, those with the lowest hashes. The bound makes the ids and
labels a table small enough to broadcast, so that no text is shuffled. Of these
rows, remainders 1 to 3 give counts and remainder 4 fits the curve, on at most
CALIBRATION rows.

Defined cases: a null or empty text, or one without letters and digits, has no
evidence and gets the curve's value at zero; without labelled rows of both
classes every score is the share of toxic rows, or 0 if there are none; a null
id counts as the text "" for its fold, is never learned from, and is scored and
dropped by its text like any other; label rows that repeat an id count as one,
toxic if any of them is; repeated rows are scored alike, and of rows that repeat an
id each is judged by its own text; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import TEXT_ROWS, give_back, keep_rows, materialize, packed, slices, table

ORDER = 5
DISCOUNT = 0.75
TRAINING = 200_000
GRAMS = 2_000_000  # n-grams of the model at most; the sample of labelled rows is halved until it has no more
CALIBRATION = 20_000
WORD_CACHE = 300_000
WORD_PATTERN = r"[^\W_]+"


def _lowest(hash_col: str, rows: int, most: int) -> F.Column:
    """Whether a 64-bit hash is in the lowest part that holds about ``most`` of ``rows`` rows; all if there are no more."""
    return F.lit(True) if rows <= most else F.col(hash_col) < F.lit(int(-(2**63) + 2**64 * (most / rows)))


def fold_of(id_col) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)).cast("int")


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): counts of every word in all rows of (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD_PATTERN).findall
        for part in slices(batches):
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(part["text"], part["y"]):
                for w in find((text or "").lower()):
                    seen[w][y] += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "o": pa.array([n[0] for n in seen.values()], pa.int64()), "t": pa.array([n[1] for n in seen.values()], pa.int64())})
        give_back()

    rows = train.select("text", "y").mapInArrow(count, "word string, o long, t long")
    return rows.groupBy("word").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def _ngram_counts(words: DataFrame, order: int) -> DataFrame:
    """(gram, o, t): gram is a context of up to order-1 characters and the next one; ^ opens and $ closes a word."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for w, o, t in zip(pdf["word"], pdf["o"], pdf["t"]):
                s = f"^{w}$"
                for j in range(1, len(s)):
                    n = seen[s[max(0, j - order + 1) : j + 1]]
                    n[0] += o
                    n[1] += t
            yield pd.DataFrame([(g, *n) for g, n in seen.items()], columns=["gram", "o", "t"])

    rows = words.mapInPandas(cut, "gram string, o long, t long")
    return rows.groupBy("gram").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def shared_backoff(grams: list[str], order: int) -> list[tuple[dict, dict, dict]]:
    """For orders order-1 down to 1: continuation counts of (context+char), their sums and their types by context."""
    levels = []
    current = set(grams)
    for n in range(order - 1, 0, -1):
        counts: dict[str, int] = defaultdict(int)
        kept = set()
        for g in current:
            if len(g) > n:
                counts[g[-n:]] += 1
            else:
                kept.add(g)
        total: dict[str, int] = defaultdict(int)
        types: dict[str, int] = defaultdict(int)
        for g, k in counts.items():
            total[g[:-1]] += k
            types[g[:-1]] += 1
        levels.append((dict(counts), dict(total), dict(types)))
        current = kept | set(counts)
    return levels


def log_ratios(grams: pd.DataFrame, order: int) -> tuple[dict[str, float], dict[str, float]]:
    """log p(char | context, toxic) - log p(char | context, ordinary) of seen n-grams, and of unseen ones by context."""
    names = grams["gram"].tolist()
    levels = shared_backoff(names, order)
    alphabet = len({g[-1] for g in names}) + 1
    memo: dict[str, float] = {}

    def low(g: str, k: int = 0) -> float:
        """The shared probability of the last character of g; level k has contexts of order-2-k characters."""
        n = order - 1 - k
        if n < 1:
            return 1.0 / alphabet
        g = g[-n:]
        if (p := memo.get((k, g))) is None:
            counts, total, types = levels[k]
            h = g[:-1]
            below = low(g[1:] if len(g) == n else g, k + 1)
            p = below if h not in total else max(counts.get(g, 0) - DISCOUNT, 0) / total[h] + DISCOUNT * types[h] / total[h] * below
            memo[(k, g)] = p
        return p

    sums: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    cols = grams[["o", "t"]].to_numpy()
    for g, (o, t) in zip(names, cols):
        s = sums[g[:-1]]
        s[0] += o
        s[1] += t
        s[2] += o > 0
        s[3] += t > 0

    def mass(s: list[float], c: int) -> float:
        return DISCOUNT * s[2 + c] / s[c] if s[c] else 1.0

    unseen = {h: math.log(mass(s, 1) / mass(s, 0)) for h, s in sums.items()}
    seen = {}
    for g, (o, t) in zip(names, cols):
        s, p = sums[g[:-1]], low(g)
        each = [(max(n - DISCOUNT, 0) / s[c] if s[c] else 0.0) + mass(s, c) * p for c, n in ((0, o), (1, t))]
        seen[g] = math.log(each[1] / each[0])
    return seen, unseen


def flat(table: dict[str, float]) -> tuple[str, np.ndarray]:
    """A table as one string and one array: workers keep what is broadcast, and the dictionaries only for a task."""
    return "\n".join(table), np.array(list(table.values()), float)


def unflat(parts: tuple[str, np.ndarray]) -> dict[str, float]:
    return dict(zip(parts[0].split("\n"), parts[1].tolist()))


class WordScorer:
    """Log-likelihood difference of words, remembered up to WORD_CACHE words."""

    @classmethod
    def of(cls, tables: tuple) -> WordScorer:
        return cls(unflat(tables[0]), unflat(tables[1]), tables[2])

    def __init__(self, seen: dict[str, float], unseen: dict[str, float], order: int) -> None:
        self.seen, self.unseen, self.order, self.memo = seen, unseen, order, {}
        self.find = re.compile(WORD_PATTERN).findall

    def word(self, w: str) -> float:
        r = self.memo.get(w)
        if r is None:
            s, n, r = f"^{w}$", self.order, 0.0
            for j in range(1, len(s)):
                g = s[max(0, j - n + 1) : j + 1]
                x = self.seen.get(g)
                r += self.unseen.get(g[:-1], 0.0) if x is None else x
            if len(self.memo) >= WORD_CACHE:
                self.memo.clear()
            self.memo[w] = r
        return r

    def features(self, text: str | None) -> tuple[float, float]:
        memo, word = self.memo, self.word
        values = [memo[w] if w in memo else word(w) for w in self.find((text or "").lower())]
        if not values:
            return 0.0, 0.0
        return math.fsum(values) / len(values), math.fsum(v - 1.0 for v in values if v > 1.0) / len(values)


def design(x: np.ndarray) -> np.ndarray:
    """The curve's inputs: both features, and the excess on a log scale."""
    return np.column_stack([np.ones(len(x)), np.clip(x[:, 0], -5, 5), np.log1p(50 * x[:, 1]), np.minimum(x[:, 1], 5)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the intercept is free."""
    a = design(x)
    w = np.zeros(a.shape[1])
    pen = np.full(len(w), ridge)
    pen[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, a.T @ (p - y) + pen * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model: the broadcast tables (seen and unseen, flat, and the order) and the curve's weights."""
    said = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold_of(id_col) > 0)).withColumn("__k", F.xxhash64(id_col))
    known = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold_of(id_col).alias("fold"))
    size, most, order = said.count(), TRAINING, ORDER
    while True:
        truth = said.where(_lowest("__k", size, most)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
        rows = known.where("fold > 0").join(F.broadcast(truth), "id")  # about TRAINING rows at most
        words = materialize(_word_counts(rows.where("fold < 4")), "words", TEXT_ROWS)
        grams = materialize(_ngram_counts(words, order), "grams")
        if grams.count() <= GRAMS or most <= 1:
            break
        most = min(most, size) // 2
    local = grams.toPandas()  # at most GRAMS n-grams
    seen, unseen = log_ratios(local, order) if len(local) else ({}, {})
    tables = docs.sparkSession.sparkContext.broadcast((flat(seen), flat(unseen), order))
    del local, seen, unseen

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = WordScorer.of(tables.value)
        for pdf in batches:
            x = [scorer.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "y": pdf["y"].to_numpy()})

    held = rows.where("fold = 4").withColumn("k", F.xxhash64("id", F.lit(1)))
    held = held.where(_lowest("k", rows.where("fold = 4").count(), CALIBRATION))
    fit = held.select("text", "y").mapInPandas(measure, "a double, b double, y int").toPandas()
    y = fit["y"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        weights = fit_logistic(fit[["a", "b"]].to_numpy(float), y)
    else:
        share = y.mean() if len(y) else 0.0
        weights = np.array([math.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0])
    return {"tables": tables, "weights": weights}


def predict(scorer: WordScorer, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The scores of an Arrow column of texts, of which few are Python strings at a time."""
    parts = (texts.slice(lo, 500).to_pylist() for lo in range(0, len(texts), 500))
    scored = [scorer.features(t) for part in parts for t in part]
    return 1 / (1 + np.exp(-np.clip(design(np.array(scored, float).reshape(-1, 2)) @ weights, -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Reads the id and the text only."""
    shared, weights = model["tables"], model["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScorer.of(shared.value)
        for batch in batches:
            p = predict(scorer, batch.column(2), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype("int32"))], names=["id", "held_out", "score", "predicted"])
        del scorer
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), (fold_of(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, each judged by its own text; columns unchanged."""
    model = train(docs, labels, id_col, text_col)
    shared, weights = model["tables"], model["weights"]
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64())])
    i, t = F.col(id_col), F.col(text_col)
    keys = {"k1": F.xxhash64(i, t), "k2": F.xxhash64(t, i, F.lit(1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScorer.of(shared.value)
        for batch in batches:
            bad = pa.array(predict(scorer, batch.column(2), weights) >= 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(bad) for k in (0, 1)], schema=kinds)
        del scorer
        give_back()

    found = docs.select(*[c.alias(k) for k, c in keys.items()], t.alias("text")).mapInArrow(run, "k1 long, k2 long").distinct()
    return keep_rows(packed(docs, **keys), list(keys), materialize(found, "toxic", TEXT_ROWS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
