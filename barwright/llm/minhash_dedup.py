"""Near-duplicate documents by MinHash bands, odd sketches and full sets.

1. Each text becomes a set of hashed 5-word shingles, MinHash samples in bands,
   and an odd sketch: every sample flips one bit of a parity bitmap, so the XOR
   of two sketches has one bit for each sample in which they differ (up to
   collisions). Its population count estimates high similarities closely.
2. Documents with equal sets fold into one class, which gets a number.
3. Classes that share a band form a bucket. A bucket's leader, the member with
   most bucket mates overall, is compared with all the others: one candidate for
   each member, not one for each pair. Confirmed links join components.
4. Members of a bucket that are then in different components are compared with
   each other. What already hangs together needs no more candidates, so a group
   of thousands of copies costs as many candidates as it has members; pairs that
   could still join two components are all tested.
Two rounds of leaders run, the second with members drawn by hash. Candidates pass
two sketch tests: the odd sketch of the samples (SIGMAS standard deviations below
the threshold), and one of the whole set, whose differing bits can never be more
than the sets' differing shingles, so that it rejects nothing wrongly. Sets are computed
again from one text of each class that candidates name, found by a bitmap of bounded
size, and written where they are read, beside a fine sketch of two bits or more for
each shingle. It is tested like the other sketch of the whole set, but does not fill up
on long texts, so few pairs below the threshold are left: only sets of the others are
shuffled, to be confirmed in full. Bands are chosen so that a pair at the threshold misses all of
them with a probability below MISS.

Rows are told apart by hashes of id and text together, so nulls and repeated ids
take part like any others.

Words are the ASCII-whitespace separated parts of the text with A-Z lowered.
Defined cases: null, empty or blank texts have no shingles and no links; fewer
than five words make one shingle of the whole sequence; a null id names no
component: its row has the smallest id that it hangs together with, or null, and is
not ``kept``; rows that repeat an id are judged by their own texts each; other columns are
ignored, whatever their names. ``drop_near_copies`` keeps exactly one row of each
component, that with the smallest id (null last, then by hash), and all rows
without shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import TEXT_ROWS, connected_components, flagged, give_back, keep_rows, materialize, packed, slices, table

WORDS = 5
MISS = 1e-6
SIGMAS = 5.0
SKETCH_WORDS = 4
SEED = 20240607
FILTER_BITS = 1 << 26  # the most bits of the bitmap of wanted ids: 8 MB


def band_plan(threshold: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows a band) with a miss probability below MISS at the threshold."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)), rows


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending. bytes.lower and bytes.split know ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    mix = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        mix = (mix ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    if k < size:
        mix = mix ^ np.uint64(0xD6E8FEB86659FD93 * (size - k) & (2**64 - 1))
    return np.unique(mix)


class Sketcher:
    """MinHash bands and odd sketches; the same for every process."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(SEED)
        k = bands * rows
        self.mul = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, k, dtype=np.uint64)
        self.bands, self.rows = bands, rows
        self.salt = np.arange(k, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), np.uint64(2**64 - 1))
        for i in range(0, len(hashes), 2048):
            low = np.minimum(low, (hashes[i : i + 2048, None] * self.mul + self.add).min(axis=0))
        return low

    def band_keys(self, low: np.ndarray) -> np.ndarray:
        part = low.reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            key = (key ^ part[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)

    def odd_sketch(self, low: np.ndarray) -> np.ndarray:
        return self.parity(low ^ self.salt)

    @staticmethod
    def parity(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
        """A bitmap of 64 * ``words`` bits in which each value flips one bit. That of half the words is the XOR of its halves, where they are a power of two."""
        mixed = values * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        bit = (mixed % np.uint64(64 * words)).astype(np.int64)
        parity = np.bincount(bit, minlength=64 * words) & 1
        return np.packbits(parity.astype(np.uint8)).view(np.int64)


def fine_words(n: int) -> int:
    """64-bit words of the fine sketch of a set of ``n`` shingles: a power of two with two bits or more for each."""
    return max(SKETCH_WORDS, (1 << max(0, 2 * n - 1).bit_length()) // 64)


def sketch_limit(threshold: float, k: int) -> int:
    """The most differing sketch bits that a pair at the threshold shows, SIGMAS deviations out."""
    n = 64 * SKETCH_WORDS
    worst = k * (1 - threshold) + SIGMAS * math.sqrt(k * threshold * (1 - threshold))
    expected = n / 2 * (1 - (1 - 2 / n) ** (2 * min(worst, k)))
    return min(n, math.ceil(expected + SIGMAS * math.sqrt(n) / 4))


def _sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    own = ["id", "k1", "k2", "n", "d1", "d2"]
    kinds = pa.schema([*[(c, pa.int64()) for c in own], ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(bands, rows)
        for part in slices(batches):
            out = []
            for t in part["text"]:
                h = shingle_hashes(t)
                if len(h):
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    low = sk.samples(h)
                    out.append((len(h), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, sk.band_keys(low), np.concatenate([sk.odd_sketch(low), sk.parity(h)])))
                else:
                    out.append((0, 0, 0, np.empty(0, np.int64), np.zeros(2 * SKETCH_WORDS, np.int64)))
            cols = [part["id"], part["k1"], part["k2"], *zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.types)], schema=kinds)
        give_back()

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in own) + ", bands array<long>, odd array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets (nr, k1, k2, fine, h) of the rows of the classes (c, k1, k2, n) in ``wanted``, and (c, nr, n, fine) of each class.

    Sets are not shuffled: they are written where their texts are read. Rows that the bitmap lets pass
    wrongly, and all but one of those that repeat id and text, are among them but have no class's ``nr``.
    """
    bits = min(FILTER_BITS, 1 << max(16, (64 * wanted.count()).bit_length()))
    place = F.pmod("k1", F.lit(bits))
    words = wanted.select(place.alias("at")).selectExpr("int(at div 64) AS w", "shiftleft(1L, int(at % 64)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[rows["w"].to_numpy("int64")] = rows["b"].to_numpy("int64")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("fine", pa.list_(pa.int64())), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches):
            at = np.array(part["at"], np.int64)
            hits = np.flatnonzero((own[at // 64] >> (at % 64)) & 1 == 1)
            sets = [shingle_hashes(part["text"][j]) for j in hits]
            cols = [[part["k1"][j] for j in hits], [part["k2"][j] for j in hits], [Sketcher.parity(h, fine_words(len(h))) for h in sets], [h.view(np.int64) for h in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.types)], schema=kinds)
        give_back()

    found = docs.select("k1", "k2", "text", place.alias("at")).mapInArrow(run, "k1 long, k2 long, fine array<long>, h array<long>")
    sets = materialize(found.select(F.monotonically_increasing_id().alias("nr"), "*"), "sets", TEXT_ROWS)
    known = sets.select("nr", "k1", "k2", "fine").join(wanted, ["k1", "k2"]).groupBy("c").agg(F.min(F.struct("nr", "n", "fine")).alias("row"))
    return sets, materialize(known.select("c", "row.*"), "known")


def _alike(percent: int) -> F.Column:
    """Whether sets of an and bn shingles can be a pair at the threshold by their sizes."""
    return 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")


def _few(differ: F.Column, percent: int) -> F.Column:
    """Whether sets of an and bn shingles of which at least ``differ`` are in one only can be a pair at the threshold."""
    # intersection >= percent/100 * union means difference <= (100-percent)/(100+percent) * (an + bn)
    return differ * (100 + percent) <= (100 - percent) * (F.col("an") + F.col("bn"))


def _near(limit: int, percent: int) -> F.Column:
    """Whether the sketches ao and bo of sets of an and bn shingles may belong to a pair at the threshold."""
    differ = lambda i: F.bit_count(F.col("ao")[i].bitwiseXOR(F.col("bo")[i]))
    part = lambda lo: sum((differ(i) for i in range(lo, lo + SKETCH_WORDS)), F.lit(0))
    return _alike(percent) & (part(0) <= limit) & _few(part(SKETCH_WORDS), percent)


def _fine(percent: int) -> F.Column:
    """The same of the fine sketches ao and bo. The longer is folded to the length of the other; one more than twice as long rejects nothing."""
    words = F.least(F.size("ao"), F.size("bo"))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda c: F.when(F.size(c) > words, F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), xor)).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(fold("ao"), fold("bo"), xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    return _alike(percent) & ((F.greatest(F.size("ao"), F.size("bo")) > 2 * words) | _few(differ, percent))


def _close(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that pass the test of the fine sketches, with the numbers ur and vr of their sets."""
    one = known.select(F.col("c").alias("u"), F.col("nr").alias("ur"), F.col("n").alias("an"), F.col("fine").alias("ao"))
    two = known.select(F.col("c").alias("v"), F.col("nr").alias("vr"), F.col("n").alias("bn"), F.col("fine").alias("bo"))
    return pairs.join(one, "u").join(two, "v").where(_fine(percent)).select("u", "v", "ur", "vr")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union of the full sets ur and vr."""
    named = pairs.select(F.explode(F.array("ur", "vr")).alias("nr")).distinct()
    sets = flagged(sets.select("nr", "h"), ["nr"], named).where("hit")
    own = sets.select(F.col("nr").alias("ur"), F.col("h").alias("uh"))
    other = sets.select(F.col("nr").alias("vr"), F.col("h").alias("vh"))
    both = pairs.join(own, "ur").join(other, "vr")
    meet = F.size(F.array_intersect("uh", "vh"))
    union = F.size("uh") + F.size("vh") - F.col("meet")
    return both.withColumn("meet", meet).where(F.lit(100) * F.col("meet") >= F.lit(percent) * union).select("u", "v")


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per input row: id, k1, k2, n, comp (the component's number, null without shingles) and low, its smallest id."""
    bands, rows = band_plan(percent / 100)
    limit = sketch_limit(percent / 100, bands * rows)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain = plain.select("*", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(SEED)).alias("k2"))
    base = materialize(_sketches(plain, bands, rows), "sketches", TEXT_ROWS)

    # documents with equal sets are one class; the numbers hold once they are written
    full = base.where("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.min(F.struct("k1", "k2")).alias("row"), *[F.first(c).alias(c) for c in ("n", "odd", "bands")])
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), "d1", "d2", "low", "row.k1", "row.k2", "n", "odd", "bands"), "classes")
    member = full.select("id", "k1", "k2", "n", "d1", "d2").join(classes.select("d1", "d2", "c", "low"), ["d1", "d2"]).drop("d1", "d2")
    member = materialize(member, "members")
    sketch = classes.select("c", "n", "odd")

    # buckets of at least two classes; tables that meet by bucket are written first, so that hot buckets can be split
    held = materialize(classes.select("c", F.explode("bands").alias("key")), "held")
    sizes = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = flagged(held, ["key"], sizes).where("hit").drop("hit")  # most keys are of one class: a bitmap passes them over where they are read
    buckets = materialize(shared.join(sizes, "key"), "buckets")

    def sketched(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that pass the sketch tests."""
        one = sketch.select(F.col("c").alias("u"), F.col("n").alias("an"), F.col("odd").alias("ao"))
        two = sketch.select(F.col("c").alias("v"), F.col("n").alias("bn"), F.col("odd").alias("bo"))
        return pairs.join(one, "u").join(two, "v").where(_near(limit, percent)).select("u", "v")

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct().join(classes.select("c", "k1", "k2", "n"), "c")
        sets, known = _sets(plain, materialize(wanted, "wanted"))
        return _confirm(materialize(_close(pairs, known, percent), "close"), sets, percent)

    links = comp = tried = None
    live = buckets.withColumn("comp", F.col("c"))
    for turn in range(2):
        if turn:
            ranked = live.withColumn("score", F.xxhash64("c", F.lit(turn)))
        else:
            ranked = live.join(materialize(live.groupBy("c").agg(F.sum("size").alias("score")), "mates"), "c")
        leaders = ranked.groupBy("key").agg(F.max_by(F.struct("c", "comp"), F.struct(F.col("score"), -F.col("c"))).alias("lead"))
        leaders = materialize(leaders.select("key", F.col("lead.c").alias("lead"), F.col("lead.comp").alias("lead_comp")), "leaders")
        # what hangs together already needs no further link
        star = live.join(leaders, "key").where("comp <> lead_comp").select(F.least("c", "lead").alias("u"), F.greatest("c", "lead").alias("v")).distinct()
        if tried is not None:
            star = star.join(tried, ["u", "v"], "left_anti")
        star = materialize(sketched(star), "star")
        tried = star if tried is None else tried.union(star)
        found = confirmed(star)
        links = materialize(found if links is None else links.union(found), "links")
        comp = materialize(connected_components(links), "components")
        # members of one bucket in different components remain
        placed = buckets.join(comp, buckets["c"] == comp["node"], "left").select("key", "c", "size", F.coalesce("component", "c").alias("comp"))
        placed = materialize(placed, "placed")
        apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        live = materialize(placed.join(materialize(apart, "apart"), "key", "left_semi"), "open")

    left = materialize(live.join(sketch, "c"), "left")
    a = left.select("key", F.col("c").alias("u"), F.col("n").alias("an"), F.col("odd").alias("ao"), F.col("comp").alias("uc"))
    b = left.select("key", F.col("c").alias("v"), F.col("n").alias("bn"), F.col("odd").alias("bo"), F.col("comp").alias("vc"))
    cross = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (F.col("uc") != F.col("vc")) & _near(limit, percent))
    cross = materialize(cross.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"), "cross")
    more = materialize(confirmed(cross), "links")
    if more.limit(1).count():
        comp = materialize(connected_components(links.union(more)), "components")

    # back to the rows, with the smallest id of each component
    named = materialize(comp.join(classes.select(F.col("c").alias("node"), "low"), "node"), "named")
    lows = materialize(named.groupBy("component").agg(F.min("low").alias("least")), "lows")
    found = named.join(lows, "component").select(F.col("node").alias("c"), "component", "least")
    rows = member.join(materialize(found, "found"), "c", "left")
    rows = rows.select("id", "k1", "k2", "n", F.coalesce("component", "c").alias("comp"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("low"))
    return rows.unionByName(base.where("n = 0").select("id", "k1", "k2", "n", F.lit(None).cast("long").alias("comp"), F.col("id").alias("low")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    return _placed(docs, id_col, text_col, percent).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("low").alias("component_id"),
        F.coalesce(F.col("id") == F.col("low"), F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component; columns unchanged."""
    rows = _placed(docs, id_col, text_col, percent).where("comp IS NOT NULL").groupBy("k1", "k2").agg(F.first("comp").alias("comp"), F.first("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    rows = materialize(rows, "rows")
    stays = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "k1", "k2")).alias("stay"), F.sum("rows").alias("all")).where("all > 1")
    judged = materialize(rows.join(materialize(stays, "stays"), "comp").select("k1", "k2", "rows", ((F.col("k1") == F.col("stay.k1")) & (F.col("k2") == F.col("stay.k2"))).alias("stays")), "judged")
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    each = packed(docs, k1=F.xxhash64(i, t), k2=F.xxhash64(t, i, F.lit(SEED)))
    return keep_rows(each, ["k1", "k2"], judged.where("NOT stays").select("k1", "k2"), judged.where("stays AND rows > 1").select("k1", "k2"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: The same by joining all documents that share a shingle; only for tables as small as the tests'.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE [array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM m JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT u AS doc_id, v AS seen FROM e UNION SELECT v, u FROM e UNION SELECT r.doc_id, CASE WHEN e.u = r.seen THEN e.v ELSE e.u END FROM r JOIN e ON e.u = r.seen OR e.v = r.seen),
c AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
