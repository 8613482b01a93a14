"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent, an exact count
verifies them, and the verified winners (at most ``counters`` rows, whatever the
input) are broadcast: their copies are resolved where they are read. Only the
remaining digests are shuffled.

Defined cases: a null text counts as empty; equal means identical after
lower-casing A-Z only; of equal texts the largest id stays; a null id never
wins over another; rows that repeat an id each carry the answer of their own
text's group, so all rows with a group's winning id and text have ``kept``; an
empty table gives an empty result. Other columns are ignored, whatever their
names. ``drop_copies`` decides by row: of each text exactly one row stays, of rows
with the largest id one of them, and of rows with a null id one where no other
has the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import UPPER, keep_rows, materialize, packed, table

COUNTERS = 512
MERGE_GROUPS = 32


def normalised_digest(text) -> F.Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), 256)


def reduce_summary(counts: pd.Series, counters: int) -> pd.Series:
    """The Misra-Gries step: keeps at most ``counters`` entries, subtracting the next largest count from all."""
    if len(counts) <= counters:
        return counts
    cut = counts.nlargest(counters + 1).iloc[-1]
    counts = counts - cut
    return counts[counts > 0]


def heavy_digests(df: DataFrame, digest: str, counters: int) -> list[str]:
    """Every value with more than rows/(counters+1) copies is among the at most ``counters`` returned."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = pd.Series(dtype="int64")
        for pdf in batches:
            own = reduce_summary(own.add(pdf[digest].value_counts(), fill_value=0), counters)
        group = TaskContext.get().partitionId() % MERGE_GROUPS
        yield pd.DataFrame({"g": group, "h": own.index.astype(str), "n": own.to_numpy("int64")})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = reduce_summary(pdf.groupby("h")["n"].sum(), counters)
        return pd.DataFrame({"h": own.index.astype(str), "n": own.to_numpy("int64")})

    parts = df.select(digest).mapInPandas(summarise, "g int, h string, n long")
    merged = parts.groupBy("g").applyInPandas(merge, "h string, n long")
    rows = merged.toPandas()  # at most MERGE_GROUPS * counters rows
    return list(reduce_summary(rows.groupby("h")["n"].sum(), counters).index)


def _split(docs: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, winners, groups): (id, h) of all rows, (h, keep_id, group_size) of frequent digests and of the others."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), normalised_digest(F.col(text_col)).alias("h"))
    base = materialize(base, "digests")
    stats = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    candidates = spark.createDataFrame([(h,) for h in heavy_digests(base, "h", counters)], "h string")
    rows = base.count()
    winners = base.join(F.broadcast(candidates), "h", "left_semi").groupBy("h").agg(*stats)
    winners = winners.where(F.col("group_size") * (counters + 1) > F.lit(rows))
    winners = materialize(winners.coalesce(1), "winners")
    rest = base.join(F.broadcast(winners.select("h")), "h", "left_anti")
    return base, winners, materialize(rest.groupBy("h").agg(*stats), "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    base, winners, groups = _split(docs, id_col, text_col, counters)
    hot = base.join(F.broadcast(winners), "h")
    cold = base.join(F.broadcast(winners.select("h")), "h", "left_anti").join(groups, "h")
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("h").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row of ``docs`` for each text, that with the largest id; columns unchanged.

    Copies of frequent texts go where they are read; the others' ids and digests are joined.
    """
    base, winners, groups = _split(docs, id_col, text_col, counters)
    groups = groups.where("group_size > 1").unionByName(winners)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    pairs = base.join(materialize(groups, "copies"), "h").groupBy("id", "h").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs, "pairs")
    rows = packed(docs, id=F.col(id_col), h=normalised_digest(F.col(text_col)))
    frequent = winners.select(F.col("h").alias("wh"), "keep_id")
    rows = rows.join(F.broadcast(frequent), (F.col("h") == F.col("wh")) & ~stays, "left_anti")
    return keep_rows(rows, ["id", "h"], pairs.where("NOT stays").select("id", "h"), pairs.where("stays AND n > 1").select("id", "h"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
       h AS text_sha256
FROM (SELECT doc_id,
             sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
      FROM documents) t
"""
