"""What the operators of this folder share: scratch tables, ranks without hot tasks, components.

Scratch tables live in the folder named by ``spark.checkpoint.dir``, which all
executors see, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000  # rows of an Arrow batch that carries whole texts
FILTER_BITS = 1 << 26  # of a broadcast bitmap at most
HUBS = 1000  # nodes at most whose minima are broadcast
HUB_EDGES = 10_000  # edges of a hub at least
PART_ROWS = 100_000  # rows that one task of a rank sorts, about
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Writes ``df`` to a shared scratch table and reads it back: the lineage ends there.

    ``batch_rows`` holds the Arrow batches of this write to as many rows, for Python stages that read long texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    usual = spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, usual)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[dict[str, list]]:
    """Arrow batches in parts, as lists by column: only one part's texts are Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows).to_pydict()


def give_back() -> None:
    """Returns a Python worker's free memory to the system, where the C library can: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rank_parts(rows: int) -> int:
    """Hash parts of a key for ``dense_rank``: even a key of all ``rows`` has about PART_ROWS in each."""
    return max(256, -(-rows // PART_ROWS))


def dense_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int) -> DataFrame:
    """Numbers the rows of every key from 0 without gaps.

    A key's rows are ranked within ``salts`` hash parts and each part starts
    where the parts before it end, so no task holds all rows of a hot key. The
    number depends on the rows alone, so a recomputed task repeats it.
    ``keys`` must not be null and take a bounded number of values.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    parted = df.withColumn("__part", part)
    within = Window.partitionBy(*keys, "__part").orderBy(*order)
    sizes = parted.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = parted.withColumn("__rank", F.row_number().over(within))
    return (
        ranked.join(starts, [*keys, "__part"])
        .withColumn(out, F.col("__start") + F.col("__rank") - 1)
        .drop("__part", "__rank", "__start")
    )


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``row`` beside key columns: no name of theirs can clash with a helper's."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys, nulls included."""
    return functools.reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def flagged(rows: DataFrame, names: list[str], keys: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` with ``hit``: whether a bitmap of the hashes of ``keys`` may hold theirs. False for no row whose key is there.

    The bitmap is a broadcast table of 64-bit words, of at most FILTER_BITS / 64 rows.
    """
    bits = min(FILTER_BITS, 1 << max(16, (64 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(bits))
    words = keys.select(place.alias("at")).selectExpr("at div 64 AS w", "shiftleft(1L, int(at % 64)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    placed = rows.withColumn("at", place).withColumn("w", F.expr("at div 64"))
    held = placed.join(F.broadcast(words), "w", "left").withColumn("hit", F.expr("coalesce((b & shiftleft(1L, int(at % 64))) <> 0, false)"))
    return held.select(*rows.columns, "hit")


def keep_rows(rows: DataFrame, names: list[str], gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The packed rows without those whose keys are in ``gone``, and with one row for each of the keys in ``once``.

    Both tables have the key columns, each key once, and grow with the rows. Rows are
    judged where they are read: a bitmap of the keys to go passes most of the others,
    and the keys (not the rows) that it holds wrongly are found by a join. Only rows
    that a bitmap of those holds are moved, so what is shuffled of whole rows is a
    share of them that the bitmaps' sizes set, whether few rows go or most.
    Of the rows with a key in ``once`` the one with the lowest hash stays: a minimum combined map-side.
    """
    first = flagged(rows, names, gone)
    suspect = first.where("hit").select(*names).distinct()
    wrong = materialize(suspect.join(gone, same(suspect, gone, names), "left_anti"), "wrong")
    back = flagged(first.where("hit").drop("hit"), names, wrong, 1).where("hit").drop("hit")
    rows = first.where("NOT hit").drop("hit").unionByName(back.join(wrong, same(back, wrong, names), "left_semi"))
    if once is None or not once.limit(1).count():
        return rows.select("row.*")
    held = flagged(rows, names, once, 2)
    maybe = held.where("hit").drop("hit")
    several = maybe.join(once, same(maybe, once, names), "left_semi").groupBy(*names).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    other = maybe.join(once, same(maybe, once, names), "left_anti").select("row")
    return held.where("NOT hit").select("row").unionByName(other).unionByName(several.select("row")).select("row.*")


def _edge_state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of their u. Nodes with more than ``most`` edges get it by a broadcast: their edges stay where they are."""
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc")
    hubs = F.broadcast(low.where(F.col("n") > most).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") <= most).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the smallest node reachable.

    ``edges`` has long columns u and v. Alternates the large-star and small-star
    steps on distributed edge lists until nothing changes. Each step is a minimum
    by node (combined map-side) joined back to the edges. No task gathers a hub's
    edges: nodes with more than a thousandth of the edges (or HUB_EDGES) are at most
    2 * HUBS, and their minima are broadcast. Each round ends in a scratch table.
    """
    cur = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = materialize(cur, "cc")
    state = _edge_state(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        most = max(HUB_EDGES, state[0] // HUBS)
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, most).withColumn("m", F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc")
        joined = _with_least(large, most)
        small = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        nxt = materialize(small, "cc")
        new = _edge_state(nxt)
        cur = nxt
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return leaves.union(roots).distinct()
