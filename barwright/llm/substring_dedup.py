"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? before white space, and at line
breaks). At every sentence one run starts and one ends: the shortest sequences of at
least ``min_sentences`` consecutive sentences with ``min_words`` words together. These
runs cover every longer one: a sentence of it has enough from there to its end, or from
its start to there, or else lies in the run that starts with it. Runs are hashed (128
bits) and joined globally; sentences that lie in a run of which an earlier copy exists
(smaller id, then earlier place) are removed. The first copy stays.

A sentence's identity is its words, A-Z lowered, so white space does not matter.

The hashes' first places are a minimum combined map-side; only runs that occur
more than once are joined back, so a passage shared by very many documents is
split like any skewed join and never gathered.

Defined cases: null and blank texts have no sentences and come back as they are;
a text with no whole run is kept whole; a null id comes after all others; rows that
repeat an id are documents of their own, in the order of their texts' hashes; rows
that repeat id and text are one document, judged by its places and all cut alike;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import TEXT_ROWS, materialize, slices, table

MIN_SENTENCES = 2
MIN_WORDS = 6
SENTENCE = r"[^\n]*?[.!?](?=\s|$)\s*|[^\n]+\n?|\n+"


def sentences(text: str) -> list[str]:
    """The text in pieces whose concatenation is the text."""
    return re.findall(SENTENCE, text)


def runs(parts: list[str], min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> list[tuple[int, int, int, int]]:
    """(first sentence, last sentence, two hashes) of every run. Blank pieces belong to no run's ends and count for nothing."""
    words = [(i, w) for i, p in enumerate(parts) if (w := p.encode("utf-8", "surrogatepass").lower().split())]
    size = [len(w) for _, w in words]
    each = [xxhash.xxh3_128_digest(b" ".join(w)) for _, w in words]
    found, count, first = set(), 0, 0
    enough = lambda n, c: n >= min_sentences and c >= min_words
    for last in range(len(words)):
        count += size[last]
        while enough(last - first + 1, count):  # the shortest runs of the starts whose first end this is
            found.add((first, last))
            count -= size[first]
            first += 1
        if first:  # the run that ends here may start before the next start
            k, c = first, count
            while not enough(last - k + 1, c):
                k -= 1
                c += size[k]
            found.add((k, last))
    out = []
    for k, last in sorted(found):
        d = xxhash.xxh3_128_intdigest(b"".join(each[k : last + 1]))
        out.append((words[k][0], words[last][0], (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63))
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(id, k, spans): runs of (id, k, text) of which an earlier copy exists, as (first, last) sentence numbers."""

    kinds = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(i, k, *r) for i, k, t in zip(part["id"], part["k"], part["text"]) if t for r in runs(sentences(t), min_words, min_sentences)]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [()] * 6, kinds.types)], schema=kinds)

    placed = docs.select("id", "k", "text").mapInArrow(cut, "id long, k long, a int, b int, h1 long, h2 long")
    placed = materialize(placed, "runs", TEXT_ROWS)
    first = placed.groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "k", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("h1", "h2", F.col("first.id").alias("fid"), F.col("first.k").alias("fk"), F.col("first.a").alias("fa"))
    first = materialize(first, "repeats")  # so that the join can split a hot run
    later = placed.join(first, ["h1", "h2"]).where("NOT (id <=> fid) OR k <> fk OR a <> fa")
    return later.groupBy("id", "k").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """One row per input row: id, n_sentences, n_removed, text without the repeats, removed spans (sentence numbers)."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("k", F.xxhash64("text"))
    spans = repeated_spans(plain, min_words, min_sentences)

    kinds = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("r", pa.int32()), ("text", pa.string())])

    def erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for i, t, sp in zip(part["id"], part["text"], part["spans"]):
                parts = sentences(t or "")
                gone = {k for s in sp or () for k in range(s["a"], s["b"] + 1)}
                out.append((i, len(parts), len(gone), "".join(p for k, p in enumerate(parts) if k not in gone) if gone else t))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), kinds.types)], schema=kinds)

    found = materialize(spans.select(F.col("id").alias("sid"), F.col("k").alias("sk"), "spans"), "spans")
    both = plain.join(found, F.col("id").eqNullSafe(F.col("sid")) & (F.col("k") == F.col("sk")), "left")
    done = materialize(both.select("id", "text", "spans").mapInArrow(erase, "id long, n int, r int, text string"), "cut", TEXT_ROWS)
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_sentences"), F.col("r").alias("n_removed"), F.col("text").alias(text_col))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
