"""Balanced label propagation against a plain loop over hubs; only the draws come from Spark's hash."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barwright.llm import common, sharding

HUB = "h binary, p int"


def draws(spark, rows, schema, columns):
    """Spark's hash of each row."""
    if not rows:
        return {}
    got = spark.createDataFrame(rows, schema).select("*", F.xxhash64(*columns).alias("draw")).collect()
    return {tuple(bytes(v) if isinstance(v, bytearray) else v for v in r[:-1]): r["draw"] for r in got}


def admitted(keys, draw, parts):
    """The order of admission: by hash part, then by draw."""
    return sorted(keys, key=lambda k: (draw[k] % parts, draw[k], k))


def begin(spark, hubs, room):
    """{(h, p): {shard: n}}: documents dealt one by one to the shards that have room."""
    total = sum(hubs.values())
    take, turn = [0] * len(room), itertools.cycle(range(len(room)))
    while sum(take) < total:
        s = next(turn)
        take[s] += take[s] < room[s]
    places = [s for s, n in enumerate(take) for _ in range(n)]
    step = max(1, int(total * 0.6180339887))
    while math.gcd(step, total) > 1:
        step += 1
    out, at = defaultdict(Counter), 0
    draw = draws(spark, list(hubs), HUB, ["h", "p"])
    for hub in admitted(hubs, draw, common.rank_parts(total)):
        for _ in range(hubs[hub]):
            out[hub][places[at * step % total]] += 1
            at += 1
    return out


def move(spark, state, quotas, rounds):
    """The propagation, hub by hub."""
    parts = common.rank_parts(sum(quotas))
    for r in range(rounds):
        rows = [(*hub, s, r) for hub, at in state.items() for s in at]
        draw = draws(spark, rows, HUB + ", shard int, r int", ["h", "p", "shard", "r"])
        home = {}
        for hub, at in state.items():
            votes = [(n + (draw[(*hub, s, r)] % (1 << 20)) / float(1 << 20) * (sharding.JITTER if r else 0), draw[(*hub, s, r)], s) for s, n in at.items()]
            home[hub] = max(votes)[2]
        counts, moves = [0] * len(quotas), [[0] * len(quotas) for _ in quotas]
        for hub, at in state.items():
            for s, n in at.items():
                counts[s] += n
                moves[s][home[hub]] += n if s != home[hub] else 0
        if not any(map(sum, moves)):
            break
        left = sharding.flows(moves, counts, quotas)
        assert all(counts[j] + sum(row[j] for row in left) - sum(left[j]) <= quotas[j] for j in range(len(quotas)))
        turn = draws(spark, [(r, *hub) for hub in state], "turn int, " + HUB, ["turn", "h", "p"])
        after = defaultdict(Counter)
        for key in admitted([(r, *hub) for hub in state], turn, parts):
            hub = key[1:]
            for s, n in state[hub].items():
                go = min(n, left[s][home[hub]]) if s != home[hub] else 0
                left[s][home[hub]] -= go
                after[hub][s] += n - go
                after[hub][home[hub]] += go
        state = {hub: {s: n for s, n in at.items() if n} for hub, at in after.items()}
    return state


def as_state(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[bytes(r["h"]), r["p"]][r["shard"]] = r["n"]
    return dict(out)


@pytest.mark.parametrize("quotas", [[50] * 8, [10, 200, 30, 90, 70]])
def test_propagation_is_the_plain_loop(spark, quotas):
    hubs = {(bytes([k]), k % 2): 3 + k * k % 7 for k in range(60)}
    total = sum(hubs.values())
    assert total <= sum(quotas)
    frame = spark.createDataFrame([(*k, n) for k, n in hubs.items()], HUB + ", n long")
    begun = common.materialize(sharding.start_apart(frame, total, quotas), "test")
    want = begin(spark, hubs, quotas)
    assert as_state(begun) == {k: dict(v) for k, v in want.items()}
    for rounds in (1, 3):
        assert as_state(sharding.propagate(begun, quotas, rounds)) == move(spark, want, quotas, rounds)


def test_whole_tables_are_the_plain_loop(spark):
    """Groups of all sizes, one of a third of all rows, null and empty texts: as many of each group in each shard."""
    texts = ["hot"] * 400 + [f"group {g}" for g in range(70) for _ in range(2 + g % 9)] + [""] * 5 + [None] * 20
    texts += [f"own {k}" for k in range(1200 - len(texts))]
    rows = list(enumerate(texts))
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    found = defaultdict(Counter)
    for k, t in rows:
        found[t][int(got.loc[k, "shard"])] += 1
    quotas = [len(rows) // 24 + (s < len(rows) % 24) for s in range(24)]
    part = len(rows) // 24
    sizes = {hashlib.md5(t.encode()).digest(): (t, n) for t, n in Counter(texts).items() if t is not None and n > 1}
    heavy = max(2, math.ceil(part / sharding.HEAVY))
    big = [(h, k, min(part, n - k * part)) for h, (_, n) in sizes.items() if n >= heavy for k in range(-(-n // part))]
    fixed = sharding.place_heavy(big, quotas)
    room = list(quotas)
    for _, _, s, n in fixed:
        room[s] -= n
    whole = {(h, k) for h, k, _, _ in fixed}
    light = {(h, 0): n for h, (_, n) in sizes.items() if n < heavy} | {(h, k): n for h, k, n in big if (h, k) not in whole}
    want = defaultdict(Counter)
    for h, _, s, n in fixed:
        want[sizes[h][0]][s] += n
    for (h, _), at in move(spark, begin(spark, light, room), room, sharding.ROUNDS).items():
        for s, n in at.items():
            want[sizes[h][0]][s] += n
    assert {t: found[t] for t in want} == want and len(want) == 72
