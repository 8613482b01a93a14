"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. alpha falls
from 1 (the shares) to 0 (all equal) and is bisected until the weights' entropy
reaches a target or some source would be repeated more often than the limit,
whichever comes first at the larger alpha; the limit always holds. The sums over
sources that this needs are Spark aggregates, each for several exponents, so the
sources may be as many as hosts.

Weights times the budget are the sources' token quotas. A source is dealt into
blocks; an epoch is a permutation of its blocks, and of documents within blocks,
drawn by hash. Whole epochs are emitted while the quota lasts; the last one stops
at the document that would pass it. That place is found from the blocks' token
sums, then from those of the block's parts, then among the documents of one part, so
no task sums up more than a small share of a source. Every row then tells from its
own hashes and its source's place how often it is emitted.

Tokens are white-space separated words. Defined cases: a null source is a source
of its own; documents without words count 1 token, so that they have a place;
an empty table gives an empty result; a null id and rows that repeat an id are
documents of their own; rows equal in id, text and source have one place and are
emitted equally often; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import materialize, packed, table

BLOCKS = 256
PART_BITS = 12  # parts of a block: the upper bits of a document's order
POINTS = 31  # exponents that one aggregate measures
SEED = 11


def weights_at(shares: list[float], alpha: float) -> list[float]:
    """Shares to the power alpha, normalised; computed from logarithms."""
    logs = [alpha * math.log(s) for s in shares]
    top = max(logs)
    each = [math.exp(x - top) for x in logs]
    return [x / math.fsum(each) for x in each]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect(reached: Callable[[list[float]], list[bool]], lo: float, hi: float, width: float = 1e-12) -> tuple[float, float]:
    """The interval within ``width`` around the change of ``reached``, which holds at lo and not at hi; POINTS places are tried at a time."""
    while hi - lo > width:
        at = [lo + (hi - lo) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
        ok = [*reached(at), False]
        k = ok.index(False)
        lo, hi = ([lo, *at][k], [*at, hi][k])
    return lo, hi


def choose_alpha(measure: Callable[[list[float]], list[tuple[float, float]]], total: int, least: int, budget: float, target_entropy: float | None, max_repeats: float) -> float:
    """The largest alpha whose entropy reaches the target, or the smallest that keeps repeats within the limit, if that is larger.

    ``measure`` gives, for each alpha, the sums over sources of share**alpha and
    of share**alpha * log(share). Up to alpha 1 the source with the ``least`` tokens
    is repeated most, weight * budget / tokens times. Where even alpha 1 passes the
    limit (the budget is too large) alpha is 1.
    """

    def entropies(at: list[float]) -> list[float]:
        return [math.log(z) - a * y / z for a, (z, y) in zip(at, measure(at))]

    def repeats(at: list[float]) -> list[float]:
        return [(least / total) ** a / z * budget / least for a, (z, _) in zip(at, measure(at))]

    wanted = 1.0
    if target_entropy is not None:
        even, own = entropies([0.0, 1.0])
        if even < target_entropy:
            wanted = 0.0
        elif own < target_entropy:
            wanted = bisect(lambda at: [e >= target_entropy for e in entropies(at)], 0.0, 1.0)[0]
    here, there = repeats([wanted, 1.0])
    if here <= max_repeats:
        return wanted
    if there > max_repeats:
        return 1.0
    return bisect(lambda at: [r > max_repeats for r in repeats(at)], wanted, 1.0)[1]


def fit_alpha(tokens: list[int], budget: float, target_entropy: float | None, max_repeats: float) -> float:
    """``choose_alpha`` for sources with the given tokens."""
    shares = [t / math.fsum(tokens) for t in tokens]
    each = lambda a: [s**a for s in shares]
    measure = lambda at: [(math.fsum(each(a)), math.fsum(w * math.log(s) for w, s in zip(each(a), shares))) for a in at]
    return choose_alpha(measure, sum(tokens), min(tokens), budget, target_entropy, max_repeats)


def source_plan(sources: list[tuple[str | None, int]], budget: int | None, entropy_share: float, max_repeats: float) -> list[tuple]:
    """[(source, tokens, weight, quota, whole epochs, tokens of the last, alpha)] of a list of sources."""
    if not sources:
        return []
    tokens = [t for _, t in sources]
    total = sum(tokens)
    budget = total if budget is None else budget
    shares = [t / total for t in tokens]
    h = entropy(shares)
    alpha = fit_alpha(tokens, budget, h + entropy_share * (math.log(len(tokens)) - h), max_repeats)
    out = []
    for (name, t), w in zip(sources, weights_at(shares, alpha)):
        quota = round(w * budget)
        out.append((name, t, w, quota, quota // t, quota % t, alpha))
    return out


def _quotas(base: DataFrame, budget: int | None, entropy_share: float, max_repeats: float) -> DataFrame:
    """(ps, weight, alpha, whole, rest): ``source_plan`` as a table, one row per source."""
    totals = materialize(base.groupBy("source").agg(F.sum("n_tokens").alias("t")), "totals")
    total, least, count = totals.agg(F.sum("t"), F.min("t"), F.count(F.lit(1))).first()
    if not count:
        return totals.selectExpr("source AS ps", "double(0) AS weight", "double(0) AS alpha", "0L AS whole", "0L AS rest")
    budget = total if budget is None else budget
    log = F.log(F.col("t") / F.lit(float(total)))

    def measure(at: list[float]) -> list[tuple[float, float]]:
        w = [F.exp(log * F.lit(a)) for a in at]
        r = totals.agg(*[F.sum(x) for x in w], *[F.sum(x * log) for x in w]).first()
        return list(zip(r[: len(at)], r[len(at) :]))

    z, y = measure([1.0])[0]
    own = math.log(z) - y / z
    alpha = choose_alpha(measure, total, least, budget, own + entropy_share * (math.log(count) - own), max_repeats)
    weight = F.exp(log * F.lit(alpha)) / F.lit(measure([alpha])[0][0])
    quota = F.rint(F.col("weight") * F.lit(float(budget))).cast("long")
    plan = totals.select(F.col("source").alias("ps"), "t", weight.alias("weight"), F.lit(alpha).alias("alpha")).withColumn("quota", quota)
    return materialize(plan.selectExpr("ps", "weight", "alpha", "quota div t AS whole", "quota % t AS rest"), "quotas")


def _tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    return {"id": F.col(id_col), "source": F.col(source_col), "n_tokens": F.greatest(words, F.lit(1)).cast("long"), "h": F.xxhash64(text)}


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id", "h", F.lit(SEED)), F.lit(blocks)).cast("int")


def _in_epoch(df: DataFrame, epoch: str) -> DataFrame:
    """``df`` (id, h, block) with its places in an epoch: block_order, doc_order and part."""
    df = df.withColumn("block_order", F.xxhash64("block", epoch, F.lit(SEED))).withColumn("doc_order", F.xxhash64("id", "h", epoch, F.lit(SEED + 1)))
    return df.withColumn("part", F.shiftright("doc_order", 64 - PART_BITS))


def _ends(base: DataFrame, quotas: DataFrame) -> DataFrame:
    """``quotas`` with the place where each source's last epoch ends: end_order, end_block, end_part and end_doc.

    The blocks before (end_order, end_block) belong to it, of that block the parts
    before end_part, and of that part the documents up to end_doc (null: none).
    """
    last = _in_epoch(base.join(quotas, base["source"].eqNullSafe(quotas["ps"])), "whole")
    ahead = lambda *k: Window.partitionBy("ps").orderBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda own, *k: own.withColumn("to", F.col("before") + F.coalesce(F.sum("own").over(ahead(*k)), F.lit(0))).where("to <= rest AND to + own > rest")
    blocks = last.groupBy("ps", "rest", "block_order", "block").agg(F.sum("n_tokens").alias("own")).withColumn("before", F.lit(0).cast("long"))
    end = first(blocks, "block_order", "block").select("ps", F.col("block_order").alias("end_order"), F.col("block").alias("end_block"), F.col("to").alias("before"))
    end = materialize(end, "ends")
    inside = last.drop("block_order", "source").withColumnRenamed("ps", "source")
    inside = materialize(inside.join(end, inside["source"].eqNullSafe(end["ps"]) & (inside["block"] == end["end_block"])).select("ps", "rest", "part", "doc_order", "n_tokens", "before"), "edges")
    parts = inside.groupBy("ps", "rest", "part", "before").agg(F.sum("n_tokens").alias("own"))
    part = materialize(first(parts, "part").select(F.col("ps").alias("pps"), F.col("part").alias("end_part"), F.col("to").alias("reached")), "parts")
    edge = inside.join(part, inside["ps"].eqNullSafe(part["pps"]) & (inside["part"] == part["end_part"]))
    upto = F.col("reached") + F.sum("n_tokens").over(Window.partitionBy("pps").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, 0))
    docs = edge.withColumn("upto", upto).groupBy("pps", "end_part").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("doc_order"))).alias("end_doc"))
    out = quotas.join(end.drop("before").withColumnRenamed("ps", "eps"), F.col("ps").eqNullSafe(F.col("eps")))
    return materialize(out.join(docs, F.col("ps").eqNullSafe(F.col("pps"))).drop("eps", "pps"), "plan")


def _belongs() -> Column:
    """Whether a row is emitted in its source's last epoch."""
    order, block, part = F.col("block_order"), F.col("block"), F.col("part")
    before = (order < F.col("end_order")) | ((order == F.col("end_order")) & (block < F.col("end_block")))
    inside = (part < F.col("end_part")) | ((part == F.col("end_part")) & (F.col("doc_order") <= F.col("end_doc")))
    return F.coalesce(before | ((block == F.col("end_block")) & inside), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy_share: float = 0.5, max_repeats: float = 4.0, blocks: int = BLOCKS) -> DataFrame:
    """One row per emitted copy of a document: id, source, n_tokens, epoch, block, block_order, doc_order, weight, alpha.

    Sorted by (source, epoch, block_order, block, doc_order) the rows are the mixed
    stream of a source. ``budget`` defaults to the tokens there are;
    ``entropy_share`` is the target's place between the shares' entropy and the
    greatest one.
    """
    base = docs.select(*[c.alias(k) for k, c in _tokens(docs, id_col, text_col, source_col).items()])
    base = materialize(base.withColumn("block", _block(blocks)), "tokens")
    plan = _ends(base, _quotas(base, budget, entropy_share, max_repeats))
    rows = base.join(plan, base["source"].eqNullSafe(plan["ps"]))
    rows = _in_epoch(rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))), "epoch")
    cols = ["id", "source", "n_tokens", "epoch", "block", "block_order", "doc_order", "weight", "alpha"]
    return rows.where((F.col("epoch") < F.col("whole")) | _belongs()).select(*cols).withColumnRenamed("id", id_col)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy_share: float = 0.5, max_repeats: float = 4.0, blocks: int = BLOCKS) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as ``mix`` emits it; columns unchanged."""
    keys = _tokens(docs, id_col, text_col, source_col)
    base = materialize(docs.select(*[c.alias(k) for k, c in keys.items()]).withColumn("block", _block(blocks)), "tokens")
    plan = _ends(base, _quotas(base, budget, entropy_share, max_repeats))
    keys.pop("n_tokens")
    rows = packed(docs, **keys).withColumn("block", _block(blocks))
    rows = _in_epoch(rows.join(plan, rows["source"].eqNullSafe(plan["ps"])), "whole")
    times = F.col("whole").cast("int") + _belongs().cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
