"""Best-fit packing with patterns from non-negative least squares.

Documents become pieces of at most CAPACITY tokens; only longer documents are
cut. The plan is made on the histogram of piece lengths, at most CAPACITY
numbers whatever the corpus: patterns of up to three lengths that fill a
sequence are enumerated over BINS classes of lengths, repeat counts are fitted to
the histogram by non-negative least squares and rounded down, and what is left
goes, longest first, to the fullest sequence that still has room, patterns'
sequences included. Then every piece is numbered within its length and takes the
place that the plan has for that number. Tokens never move: the plan is a
broadcast table of a size that CAPACITY bounds.

Defined cases: a null text is empty and makes one piece, the end token alone;
an empty table makes no pieces; a null id and rows that repeat an id are packed
as documents of their own; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import sys
import types
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import TEXT_ROWS, dense_rank, materialize, rank_parts, table

CAPACITY = 4096
END_ID = 1
BINS = 256
SLACK = 8  # tokens that a pattern's sequence may leave free
WORD_CACHE = 600_000
GROUP_CHARS = 1 << 20

#: Characters for which Python's and the tokenizer's normalisation agree without looking: ASCII and Latin-1 letters and signs.
PLAIN = "".join(map(chr, [*range(9, 14), *range(32, 127), *range(0xA1, 0x100)]))


class PieceEncoder:
    """Token ids as little-endian bytes; remembers the ids of words, as long as only plain characters occur."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        names = self.tok.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        letters = "".join(c for c in PLAIN.lower() if unicodedata.category(c)[0] == "L")
        digits = "".join(c for c in PLAIN if unicodedata.category(c)[0] == "N")
        self.find = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^\\x09-\\x0d {letters}{digits}]+").findall
        self.odd = re.compile(f"[^{re.escape(PLAIN)}]|<\\|").search

    def _learn(self, words: set[str]) -> None:
        """Encodes the words as one text; the tokens that end words part it again."""
        for part in batched(words, 5_000):
            ids = np.asarray(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                self.memo.update((w, data[lo:hi]) for w, lo, hi in zip(part, [0, *cuts], cuts))
            else:
                self.memo.update((w, np.asarray(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in part)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids. Texts go in groups of about GROUP_CHARS, whose new words are learnt in one call."""
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        words = [None if self.odd(t) else self.find(t.lower()) for t in texts]
        new = set().union(*(w for w in words if w)) - self.memo.keys()
        if new:
            if len(self.memo) + len(new) > WORD_CACHE:
                self.memo.clear()
                new = set().union(*(w for w in words if w))
            self._learn(new)
        memo = self.memo
        for t, w in zip(texts, words):
            if w is None:
                yield np.asarray(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(memo.__getitem__, w))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker: later tasks go on with what it has loaded and learnt."""
    state = sys.modules.setdefault("barwright_worker_state", types.ModuleType("barwright_worker_state"))
    known = state.__dict__.setdefault("encoders", {})
    if path not in known:
        known[path] = PieceEncoder(path)
    return known[path]


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient."""
    x = np.zeros(a.shape[1])
    if not a.size:
        return x
    rate = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    z, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z - rate * (a.T @ (a @ z - b)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Up to three classes (1..bins), descending, that fill a sequence of ``bins`` exactly."""
    out: list[tuple[int, ...]] = [(bins,)]
    for i in range(1, bins):
        if 2 * i >= bins:
            out.append((i, bins - i))
        for j in range(1, i + 1):
            if 1 <= (k := bins - i - j) <= j:
                out.append((i, j, k))
    return out


class Layout:
    """Places given to pieces of each length, and the room left in sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.left = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.left)
        self.taken: dict[int, int] = defaultdict(int)
        self.out: list[tuple[int, int, int, int, int]] = []
        self.spaces: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, sequences)]
        self.rooms: list[int] = []

    def put(self, length: int, n: int, first: int, room: int) -> None:
        self.out.append((length, self.taken[length], n, first, self.capacity - room))
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def free(self, room: int, first: int, n: int) -> None:
        if room and n:
            if not self.spaces[room]:
                insort(self.rooms, room)
            self.spaces[room].append((first, n))

    def longest(self, lo: int, hi: int, used: tuple = ()) -> int | None:
        """The longest length in (lo, hi] of which a piece is left beside the used ones."""
        k = bisect_right(self.lengths, hi) - 1
        while k >= 0 and self.lengths[k] > lo:
            if self.left[self.lengths[k]] > used.count(self.lengths[k]):
                return self.lengths[k]
            k -= 1
        return None

    def lay(self, pattern: tuple[int, ...], times: int, step: int, slack: int) -> None:
        """Up to ``times`` sequences of the pattern: the longest pieces of its classes, the last one the longest that fits; at most ``slack`` stays free."""
        while times > 0:
            picks: list[int] = []
            for c in pattern[:-1]:
                x = self.longest((c - 1) * step, c * step, tuple(picks))
                if x is None:
                    return
                picks.append(x)
            room = self.capacity - sum(picks)
            x = self.longest(max(0, room - slack - 1), room, tuple(picks))
            if x is None:
                return
            picks.append(x)
            n = min([times, *(self.left[y] // picks.count(y) for y in picks)])
            room = self.capacity
            for y in picks:
                self.put(y, n, self.sequences, room)
                room -= y
            self.free(room, self.sequences, n)
            self.sequences += n
            times -= n

    def best_fit(self) -> None:
        """What is left, longest first, each to the fullest sequence that has room."""
        for length in sorted(self.left, reverse=True):
            while (n := self.left.get(length, 0)) > 0:
                at = bisect_left(self.rooms, length)
                if at < len(self.rooms):
                    room = self.rooms[at]
                    first, have = self.spaces[room].pop()
                    if not self.spaces[room]:
                        self.rooms.pop(at)
                    m = min(n, have)
                    self.free(room, first + m, have - m)
                else:
                    room, first, m = self.capacity, self.sequences, -(-n // (self.capacity // length))
                    self.sequences += m
                self.put(length, m, first, room)
                self.free(room - length, first, m)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, ranks, first sequence, offset)], sequences): places for all pieces of each length.

    Ranks of a length from the first rank go to as many sequences from the first
    sequence, one each, at the offset. The patterns' repeat counts are halved
    as long as best fit without any pattern would take fewer sequences.
    """
    step = -(-capacity // bins)
    bins = -(-capacity // step)
    names = patterns(bins)
    count = np.zeros(bins)
    for length, n in histogram.items():
        if n > 0:
            count[-(-length // step) - 1] += n
    if not count.any():
        return [], 0
    a = np.zeros((bins, len(names)))
    for j, p in enumerate(names):
        for c in p:
            a[c - 1, j] += 1
    weight = 1.0 / np.sqrt(np.maximum(count, 1.0))  # relative misfit, so that rare lengths matter too
    times = nnls(a * weight[:, None], count * weight)
    order = sorted((j for j in range(len(names)) if times[j] > 1e-3), key=lambda j: (-times[j], names[j]))

    def laid(share: float) -> Layout:
        out = Layout(histogram, capacity)
        if share:
            for j in order:
                out.lay(names[j], math.ceil(times[j] * share), step, SLACK)
        out.best_fit()
        return out

    plain, share = laid(0.0), 1.0
    while (tried := laid(share)).sequences > plain.sequences and share > 1 / 64:
        share /= 2
    best = tried if tried.sequences <= plain.sequences else plain
    return best.out, best.sequences


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): a document is its ids and the end token, cut at ``capacity``."""
    kind = docs.schema["id"].dataType.simpleString()

    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    types_ = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tokenizer_path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXT_ROWS):
                at, texts, rows = batch.column(0).slice(lo, TEXT_ROWS), batch.column(1).slice(lo, TEXT_ROWS).to_pylist(), []
                for i, body in enumerate(enc.encode_all([t or "" for t in texts])):
                    ids = body + end
                    for p, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((i, p, start // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                cols = list(zip(*rows))
                out = [at.take(pa.array(cols[0])), *[pa.array(c, k) for c, k in zip(cols[1:], types_)]]
                out = out if keep_ids else out[:-1]
                yield pa.RecordBatch.from_arrays(out, names=names[: len(out)])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = materialize(pieces(plain, tokenizer_path, capacity, keep_ids), "pieces", TEXT_ROWS)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    places, _ = plan(counts, capacity)
    frame = pd.DataFrame(places, columns=["length", "lo", "n", "first", "offset"]).astype("int64")
    by_length = {k: g[["lo", "first", "offset"]].to_numpy() for k, g in frame.sort_values(["length", "lo"]).groupby("length")}
    shared = spark.sparkContext.broadcast(by_length)
    ranked = dense_rank(cut.withColumn("__id", F.coalesce(F.col("id").cast("string"), F.lit(""))), ["length"], ["__id", "piece", "ids_crc32"], "rank", rank_parts(sum(counts.values())))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = shared.value
        for pdf in batches:
            seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for length, rows in pdf.groupby("length").indices.items():
                segs, rank = by[length], pdf["rank"].to_numpy()[rows]
                at = np.searchsorted(segs[:, 0], rank, "right") - 1
                seq[rows] = segs[at, 1] + rank - segs[at, 0]
                off[rows] = segs[at, 2]
            yield pdf.drop(columns=["rank", "__id"]).assign(sequence_id=seq, offset=off)

    own = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema]
    ranked = ranked.select(*cut.columns, "__id", "rank")
    out = ranked.mapInPandas(place, ", ".join([*own, "sequence_id long", "offset long"]))
    return out.withColumnRenamed("id", id_col)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())
