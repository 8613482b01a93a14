"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is rotated by fixed random orthogonal matrices and kept as the signs of
its coordinates, with a correction factor for each rotation: the inner product of
the rotated unit vector with its own sign code. Code inner product over factor
estimates a cosine without bias, and the factor bounds the error.

1. Candidates share a band of code bits. Bits a band grow with the logarithm of
   the rows, the number of bands follows from the wanted miss probability, so
   buckets keep their size at every input. Only numbers, codes and factors are
   dealt to buckets.
2. In a bucket, pairs whose codes differ in more bits than a pair at the threshold
   does (but for the miss probability) are out. Vectors with a pair left are joined
   back, those only.
3. Their pairs are bounded by code, factor and the other's rotated vector; where
   the upper confidence bound reaches the threshold, the cosine is computed again in
   double precision.

Buckets over BLOCK members are cut into blocks and each pair of blocks is a task of
its own. Tasks return a count of links for each vector and a spanning forest of the
links they found, never the links themselves; a pair in several buckets counts in
the first only. Equal vectors of one label fold into one class beforehand.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, have no links; vectors of different
lengths are never linked; rows that repeat an id count as vectors of their own;
a null id takes part in links like any other but names no component; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import connected_components, materialize, table

MISS = 1e-6
EPSILON = 5.0
BLOCK = 512
BUCKET = 16
SEED = 977


def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices stacked: (count * dim, dim)."""
    out = []
    for i in range(count):
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, i]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.vstack(out)


def band_plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits a band, bands): buckets of about BUCKET unrelated rows, a miss below MISS at the threshold."""
    bits = int(np.clip(math.ceil(math.log2(max(rows, 1) / BUCKET + 1)), 4, 30))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree**bits)))


def bit_limit(bits: int, threshold: float) -> int:
    """A pair at the threshold differs in more of ``bits`` code bits with a probability below MISS."""
    p = math.acos(threshold) / math.pi
    below, term = 0.0, (1 - p) ** bits
    for k in range(bits):
        below += term
        if below >= 1 - MISS:
            return k
        term *= (bits - k) / (k + 1) * p / (1 - p)
    return bits


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (n, bits) and correction factors (n, rotations) of the rows of x, which have unit length."""
    y = x @ turn.T
    dim = x.shape[1]
    factor = np.abs(y).reshape(len(x), -1, dim).sum(axis=2) / math.sqrt(dim)
    return y >= 0, factor


def upper_bounds(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, dim: int) -> np.ndarray:
    """Upper confidence bounds of the cosines between coded rows and rotated unit rows."""
    s = np.where(signs, 1.0, -1.0).astype(np.float32) / np.repeat(factor, dim, axis=1).astype(np.float32)
    parts = factor.shape[1]
    estimate = s @ turned.astype(np.float32).T / (math.sqrt(dim) * parts)
    spread = np.sqrt(((1 - factor**2).clip(0) / factor**2).sum(axis=1)) / parts
    return estimate + (EPSILON * spread / math.sqrt(max(dim - 1, 1)))[:, None] + 1e-5


class Shape:
    """How codes of one length of vectors are kept: bits, then a half-precision factor for each rotation."""

    def __init__(self, dim: int, bits: int, bands: int) -> None:
        self.dim, self.bits, self.bands = dim, bits, bands
        self.rotations = math.ceil(bits * bands / dim)
        self.width = 8 * math.ceil(self.rotations * dim / 64)

    def pack(self, signs: np.ndarray, factor: np.ndarray) -> list[bytes]:
        code = np.packbits(signs, axis=1)
        code = np.pad(code, ((0, 0), (0, self.width - code.shape[1])))
        return [c.tobytes() + f.tobytes() for c, f in zip(code, factor.astype("<f2"))]

    def unpack(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words (n, width / 8), factors (n, rotations))."""
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        return np.ascontiguousarray(raw[:, : self.width]).view(np.uint64), np.ascontiguousarray(raw[:, self.width :]).view("<f2").astype(np.float64)

    def signs(self, words: np.ndarray) -> np.ndarray:
        return np.unpackbits(words.view(np.uint8), axis=1)[:, : self.rotations * self.dim].astype(bool)

    def band_codes(self, signs: np.ndarray) -> np.ndarray:
        return signs[:, : self.bits * self.bands].reshape(len(signs), self.bands, self.bits) @ (1 << np.arange(self.bits)).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := up.get(v, v)) != v:
            up[v] = up.get(p, p)
            v = p
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def in_groups(columns: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]):
    """A mapInPandas function over rows sorted by ``columns``: ``work`` gets whole groups and where they start and end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ks = pdf[columns].to_numpy()
            cuts = np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            if last:
                yield work(pdf.iloc[:last], np.concatenate([[0], cuts]))
            rest = pdf.iloc[last:]
        if rest is not None and len(rest):
            yield work(rest, np.array([0, len(rest)]))

    return run


def pairs_within(cuts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of rows of the same group, about ``most`` pairs at a time."""
    ends = np.repeat(cuts[1:], np.diff(cuts))
    after = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < len(after):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        n = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, i + 1 + np.arange(n.sum()) - np.repeat(total[lo:hi] - total[lo], n)
        lo = hi


KEYS = ["key", "bi", "bj"]  # a pair of blocks of a bucket


def close_codes(shape: Shape, threshold: float):
    """Keeps the rows (key, bi, bj, b, t, rep, code) that have a pair within the bit limit in their group."""
    limit = bit_limit(shape.rotations * shape.dim, threshold)

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        words, _ = shape.unpack(pdf["code"].to_list())
        block, crossed = pdf["b"].to_numpy(), (pdf["bi"] != pdf["bj"]).to_numpy()
        wanted = np.zeros(len(pdf), bool)
        for i, j in pairs_within(cuts):
            ok = (block[i] != block[j]) | ~crossed[i]
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= limit
            wanted[i[ok]] = wanted[j[ok]] = True
        return pdf[wanted]

    return in_groups(KEYS, work)


def link_groups(shape: Shape, threshold: float, numbers: str):
    """Links among the rows (key, bi, bj, b, t, rep, code, label, x, copies) of each group: counts and a forest."""

    def links(g: dict, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        blk = g["b"][lo:hi]
        own = np.flatnonzero(blk == g["bi"][lo])
        other = own if g["bi"][lo] == g["bj"][lo] else np.flatnonzero(blk == g["bj"][lo])
        if not len(own) or not len(other):
            return own[:0], own[:0]
        bound = upper_bounds(g["s"][lo:hi][own], g["f"][lo:hi][own], g["y"][lo:hi][other], shape.dim)
        i, j = np.nonzero(bound >= threshold)
        i, j = own[i] + lo, other[j] + lo
        ok = g["l"][i] == g["l"][j]
        if own is other:
            ok &= i < j
        i, j = i[ok], j[ok]
        x, keep = g["x"], np.zeros(len(i), bool)
        for k in range(0, len(i), 65536):
            keep[k : k + 65536] = (x[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(axis=1) >= threshold
        i, j = i[keep], j[keep]
        t = g["t"][lo]
        first = ~(g["c"][i, :t] == g["c"][j, :t]).any(axis=1)
        return i[first], j[first]

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["x"]), numbers).reshape(len(pdf), shape.dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        words, f = shape.unpack(pdf["code"].to_list())
        s = shape.signs(words)
        g = {"x": x, "y": x @ rotations(shape.dim, shape.rotations).T, "s": s, "f": f, "c": shape.band_codes(s), "l": pdf["label"].to_numpy(), **{k: pdf[k].to_numpy() for k in ("t", "b", "bi", "bj")}}
        pairs = [p for lo, hi in zip(cuts[:-1], cuts[1:]) if hi - lo > 1 for p in [links(g, lo, hi)] if len(p[0])]
        if not pairs:
            return pd.DataFrame({"u": [], "v": [], "n": []}).astype({"u": "int64", "v": "Int64", "n": "int64"})
        i = np.concatenate([p[0] for p in pairs])
        j = np.concatenate([p[1] for p in pairs])
        ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        counts = pd.DataFrame({"u": np.concatenate([ids[i], ids[j]]), "n": np.concatenate([copies[j], copies[i]])}).groupby("u", as_index=False)["n"].sum()
        counts["v"] = pd.NA
        tree = pd.DataFrame(forest(ids[i], ids[j]), columns=["u", "v"]).assign(n=0)
        return pd.concat([d[["u", "v", "n"]].astype({"v": "Int64"}) for d in (counts, tree)], ignore_index=True)

    return in_groups(KEYS, work)


def _checked(vectors: DataFrame, numbers: str) -> DataFrame:
    """(id, label, dim, h1, h2, x) of (id, label, x): x as bytes and its digest, all null where the vector has no links."""
    kind = vectors.schema["id"].dataType.simpleString()
    names = ["id", "label", "dim", "h1", "h2", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, label = batch.column(2), batch.column(1)
            values = pa.concat_arrays([col.flatten()]).to_numpy(zero_copy_only=False).astype(numbers) + 0.0  # nulls are NaN, no negative zeros
            size = np.array(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
            odd, some = total(~np.isfinite(values)), total(values != 0)
            ok = (size > 0) & (odd[at[1:]] == odd[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & label.is_valid().to_numpy(zero_copy_only=False)
            data = [values[a:b].tobytes() if k else None for a, b, k in zip(at[:-1], at[1:], ok)]
            digest = [(None, None) if d is None else divmod(xxhash.xxh3_128_intdigest(d), 2**64) for d in data]
            cols = [pa.array([None if h[k] is None else h[k] - 2**63 for h in digest], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array(size, pa.int32()), *cols, pa.array(data, pa.binary())], names=names)

    return vectors.mapInArrow(run, f"id {kind}, label string, dim int, h1 long, h2 long, x binary")


def _coded(vectors: DataFrame, shape: Shape, numbers: str) -> DataFrame:
    """(rep, label, code, bands): the packed code and the value of every band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotations(shape.dim, shape.rotations)
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["x"]), numbers).reshape(len(pdf), shape.dim).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                signs, f = encode(x, turn)
                yield pd.DataFrame({"rep": pdf["rep"], "label": pdf["label"], "code": shape.pack(signs, f), "bands": list(shape.band_codes(signs))})

    return vectors.select("rep", "label", "x").mapInPandas(run, "rep long, label string, code binary, bands array<long>")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    kind = vectors.schema[id_col].dataType.simpleString()
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    numbers = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>" if element == "float" else "array<double>").alias("x"))
    base = materialize(_checked(rows, numbers), "vectors")
    full = base.where("x IS NOT NULL")
    same = ["label", "dim", "h1", "h2"]
    # the numbers of classes hold once they are written
    classes = full.groupBy(*same).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    member = full.select("id", *same).join(classes.select(*same, "rep", "low", "copies"), same).select("id", "rep", "low", "copies")
    without = base.where("x IS NULL").select("id", F.lit(None).cast("long").alias("rep"), F.col("id").alias("low"), F.lit(1).cast("long").alias("copies"))
    member = materialize(member.unionByName(without), "members")
    largest = {r["dim"]: r["n"] for r in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}
    found = None
    for dim, n in sorted(largest.items()):  # lengths of vectors: a model has one
        shape = Shape(dim, *band_plan(n, threshold))
        own = classes.where(F.col("dim") == dim)
        coded = materialize(_coded(own, shape, numbers), "codes")
        keyed = coded.select("rep", "code", F.posexplode("bands").alias("t", "band"), "label").select(F.xxhash64("label", "t", "band").alias("key"), "t", "rep", "code")
        sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sizes")
        cut = keyed.join(sizes, "key").withColumn("g", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "t", "rep", "code")
        cut = cut.repartition(*KEYS).sortWithinPartitions(*KEYS)
        near = materialize(cut.mapInPandas(close_codes(shape, threshold), "key long, bi int, bj int, b int, t int, rep long, code binary"), "near")
        near = near.join(own.select("rep", "label", "x", "copies"), "rep").repartition(*KEYS).sortWithinPartitions(*KEYS)
        near = near.select(*KEYS, "b", "t", "rep", "code", "label", "x", "copies")
        part = near.mapInPandas(link_groups(shape, threshold, numbers), "u long, v long, n long")
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "u long, v long, n long")
    found = materialize(found, "links")
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    comp = materialize(connected_components(found.where("v IS NOT NULL").select("u", "v")), "components")
    named = materialize(comp.join(classes.select(F.col("rep").alias("node"), "low"), "node"), "named")
    lows = materialize(named.groupBy("component").agg(F.min("low").alias("least")), "lows")
    about = named.join(lows, "component").select(F.col("node").alias("rep"), "least").join(counts.withColumnRenamed("u", "rep"), "rep")
    out = member.join(materialize(about, "about"), "rep", "left")
    place = F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("least"))
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        place.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == place, F.lit(False)).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


#: The same by comparing all vectors of a label; only for tables as small as the tests'.
ORACLE = """
WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT u AS vec_id, v AS seen FROM b UNION SELECT r.vec_id, b.v FROM r JOIN b ON b.u = r.seen),
c AS (SELECT vec_id, min(seen) AS low FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n FROM b GROUP BY u)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(c.low, d.vec_id)) AS component_id, d.vec_id <= coalesce(c.low, d.vec_id) AS kept
FROM embeddings d LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
