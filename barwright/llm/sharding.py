"""Shards by balanced label propagation.

Linked documents hang on hubs: a hub is a group of equal texts, cut into parts of
a shard's size where it is larger than one. A hub's documents differ in nothing
but their place, so the state of the propagation is how many of them are in each
shard: rows of (hub, shard, n).

Hubs of at least 1/HEAVY of a shard (a bounded number) are placed first, whole, by
best fit in descending size. The documents of the others start apart, dealt over
the room that is left. In every round each hub votes for the shard that most of
its documents are in, and its other documents ask to move there; after the first
round, up to JITTER documents are added to a vote by chance, so that hubs whose shard
is full come to try another. Flows
between the shards that keep all quotas are found from the counts of movers by
pair of shards; the movers of a pair are admitted in an order drawn by hub, which
is the same for all shards, so that hubs are admitted whole as far as the quotas
allow, and the last one in part. Rounds end when nothing moves, after ROUNDS at
the latest. No shard ever has more linked documents than its quota. Documents
without links are dealt last, to the places that the linked ones left, which makes
the sizes exact.

Law ``rows``: the shards' counts are at most one apart.

Defined cases: a null text has no bytes, the size 8 and no links (empty texts
are equal to each other and linked); an empty table gives an empty result; with
fewer rows than shards some shards are empty; a null id and rows that repeat an
id are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import dense_rank, materialize, rank_parts, table

SHARDS = 24
ROUNDS = 12
HEAVY = 8
JITTER = 6
STATE = ["h", "p", "shard", "n"]


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _starts(df: DataFrame, keys: list[str], order: list[str], weight: str, parts: int) -> DataFrame:
    """``df`` with ``start``: the weights of a key's rows before this one, summed in ``parts`` hash parts. The order is drawn by hash of ``order``, the same for all keys."""
    parted = df.withColumn("__draw", F.xxhash64(*order)).withColumn("__part", F.pmod("__draw", F.lit(parts)).cast("int"))
    before = lambda w: F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parted.groupBy(*keys, "__part").agg(F.sum(weight).alias(weight))
    sizes = sizes.select(*keys, "__part", before(Window.partitionBy(*keys).orderBy("__part")).alias("__first"))
    ranked = parted.withColumn("__own", before(Window.partitionBy(*keys, "__part").orderBy("__draw", *order)))
    return ranked.join(sizes, [*keys, "__part"]).withColumn("start", F.col("__first") + F.col("__own")).drop("__draw", "__part", "__first", "__own")


def place_heavy(hubs: list[tuple], room: list[int]) -> list[tuple]:
    """(h, p, shard, n) of the hubs (h, p, n) that fit whole, largest first, each where least room is left over."""
    room, out = list(room), []
    for h, p, n in sorted(hubs, key=lambda x: (-x[2], bytes(x[0]), x[1])):
        fit = [(r, s) for s, r in enumerate(room) if r >= n]
        if fit:
            s = min(fit)[1]
            room[s] -= n
            out.append((h, p, s, n))
    return out


def flows(moves: list[list[int]], counts: list[int], quotas: list[int]) -> list[list[int]]:
    """How many of moves[i][j] may go from i to j so that no shard passes its quota; counts keep the quotas."""
    x, shards = [list(r) for r in moves], range(len(quotas))
    while True:
        over = [counts[j] + sum(x[i][j] for i in shards) - sum(x[j]) - quotas[j] for j in shards]
        if max(over) <= 0:
            return x
        for j in shards:
            if over[j] > 0:
                into, left = sum(x[i][j] for i in shards), over[j]
                for i in sorted(shards, key=lambda i: -x[i][j]):
                    cut = min(x[i][j], left, math.ceil(over[j] * x[i][j] / into))
                    x[i][j] -= cut
                    left -= cut


def start_apart(hubs: DataFrame, total: int, room: list[int]) -> DataFrame:
    """(h, p, shard, n): the documents of hubs (h, p, n), ``total`` in all, dealt over the room without regard to hubs."""
    take = [0] * len(room)
    left = total
    while left:  # evenly, as far as there is room
        open_ = [s for s, r in enumerate(room) if r > take[s]]
        each = max(1, left // len(open_))
        for s in open_:
            k = min(each, room[s] - take[s], left)
            take[s] += k
            left -= k
    step = max(1, int(total * 0.6180339887))
    while math.gcd(step, total) > 1:
        step += 1
    ends = [sum(take[: s + 1]) for s in range(len(take))]
    one = _starts(hubs.withColumn("one", F.lit(0)), ["one"], ["h", "p"], "n", rank_parts(total))
    at = one.select("h", "p", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    # a step that has no factor in common with the total permutes the places
    at = at.withColumn("at", ((F.col("at").cast("decimal(19,0)") * F.lit(step)) % F.lit(total)).cast("long"))
    shard = sum(((F.col("at") >= F.lit(e)).cast("int") for e in ends[:-1]), F.lit(0))
    return at.groupBy("h", "p", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def propagate(state: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Label propagation under quotas: (h, p, shard, n) with the documents of each hub (h, p) in as few shards as it finds."""
    spark, shards = state.sparkSession, len(quotas)
    state = materialize(state.select(*STATE), "labels")
    for r in range(rounds):
        draw = F.xxhash64("h", "p", "shard", F.lit(r))
        vote = F.col("n") + (F.pmod(draw, F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.lit(JITTER if r else 0))
        best = state.groupBy("h", "p").agg(F.max(F.struct(vote.alias("vote"), draw.alias("tie"), "shard")).alias("b")).select("h", "p", F.col("b.shard").alias("home"))
        voted = materialize(state.join(best, ["h", "p"]), "votes")
        counts, moves = [0] * shards, [[0] * shards for _ in range(shards)]
        for i, j, n in voted.groupBy("shard", "home").agg(F.sum("n")).collect():  # one row per pair of shards
            counts[i] += n
            if i != j:
                moves[i][j] = n
        if not any(map(sum, moves)):
            break
        granted = flows(moves, counts, quotas)
        pairs = spark.createDataFrame([(i, j, granted[i][j]) for i in range(shards) for j in range(shards) if moves[i][j]], "shard int, home int, most long")
        ask = _starts(voted.where("shard <> home").withColumn("turn", F.lit(r)), ["shard", "home"], ["turn", "h", "p"], "n", rank_parts(sum(quotas)))
        ask = ask.join(F.broadcast(pairs), ["shard", "home"]).withColumn("go", F.greatest(F.lit(0), F.least("n", F.col("most") - F.col("start"))))
        ask = ask.select("h", "p", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("home").alias("shard"), F.col("go").alias("n")))).alias("e"))
        moved = voted.where("shard = home").select(*STATE).unionByName(ask.select("h", "p", "e.shard", "e.n"))
        state = materialize(moved.groupBy("h", "p", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "labels")
    return state


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.when(F.col(text_col).isNotNull(), F.unhex(F.md5(F.encode(F.col(text_col), "UTF-8")))).alias("h"),
    )
    base = materialize(base.withColumn("key", F.xxhash64("id", "h")), "docs")
    rows = base.count()
    parts = rank_parts(rows)
    quotas = _quotas(rows, shards)
    part = max(1, rows // shards)
    groups = base.where("h IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = materialize(groups, "groups")
    linked = materialize(base.join(groups.select("h"), "h"), "linked")
    # hubs: groups in parts of at most a shard; the heavy ones are at most HEAVY a shard, and one more a group
    heavy = max(2, math.ceil(part / HEAVY))
    big = [(h, k, min(part, c - k * part)) for h, c in groups.where(F.col("c") >= heavy).collect() for k in range(-(-c // part))]
    fixed = place_heavy(big, quotas)
    room = list(quotas)
    for _, _, s, n in fixed:
        room[s] -= n
    done = {(bytes(h), k) for h, k, _, _ in fixed}
    rest = spark.createDataFrame([b for b in big if (bytes(b[0]), b[1]) not in done], "h binary, p int, n long")
    light = groups.where(F.col("c") < heavy).select("h", F.lit(0).alias("p"), F.col("c").alias("n")).unionByName(rest)
    light = materialize(light, "hubs")
    total = light.agg(F.sum("n")).first()[0] or 0
    state = spark.createDataFrame(fixed, "h binary, p int, shard int, n long")
    if total:
        state = state.unionByName(propagate(start_apart(light, total, room), room))
    # a group's documents, in the order of their ranks, fill its places
    upto = F.sum("n").over(Window.partitionBy("h").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = state.groupBy("h", "shard").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    ranges = materialize(ranges.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places")), "ranges")
    ranked = materialize(dense_rank(linked, ["h"], ["key", "id"], "r", parts), "ranked")
    placed = ranked.join(ranges, "h").withColumn("shard", F.expr("filter(places, x -> x.upto > r)[0].shard"))
    placed = materialize(placed.select("id", "size", "crc", "key", "shard"), "placed")
    taken = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shard
    taken = [taken.get(s, 0) for s in range(shards)]
    stay = dense_rank(placed, ["shard"], ["key", "id"], "slot", parts)
    single = base.join(groups, "h", "left_anti").select("id", "size", "crc", "key")
    loose = dense_rank(single.withColumn("one", F.lit(0)), ["one"], ["key", "id"], "n", parts)
    starts, acc = [], 0  # place of each shard's first free slot among all free slots
    for t, q in zip(taken, quotas):
        starts.append(acc)
        acc += q - t
    to = sum(((F.col("n") >= F.lit(s)).cast("int") for s in starts[1:]), F.lit(0))
    loose = loose.withColumn("shard", to.cast("int"))
    loose = loose.withColumn("slot", F.col("n") - _pick(starts, F.col("shard")) + _pick(taken, F.col("shard")))
    both = stay.select("id", "size", "crc", "key", "shard", "slot").unionByName(loose.select("id", "size", "crc", "key", "shard", "slot"))
    return both.select(
        F.col("id").cast(kind).alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
