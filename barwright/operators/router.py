"""Which setup to trade: arbitration, modulators and gates as one plan; calibration of probabilities.

The plan takes one row a bar with the setups' columns (as ``features.structural_features``
gives them, with vss and tof) and the context columns CONTEXT. A setup counts if it is
active, strong enough and points somewhere. Of setups that agree the one with the best
prior win rate times fitness is taken; opposite ones need a gap. Without any setup the
model's own direction may be traded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import clip, flag
from barwright.operators import evaluation, features, labels, structure
from barwright.plans import Plan, duck_text, spark_text
from barwright.sources import bars, bars_sql

# Prior win rates by setup; least strength and gap; bonus, penalty and veto of a second opinion.
PRIOR = {"sfs": 0.62, "sfa": 0.62, "sld": 0.60, "orb": 0.57, "svwap": 0.57, "spb": 0.57, "seod": 0.56, "scomp": 0.55}
LEAST_STRENGTH, LEAST_GAP, BONUS, PENALTY, VETO = 0.5, 0.05, 0.02, 0.03, 0.65
DRIFT, DRIFT_CAP, FLOOR, CEILING = 0.7, 0.4, 0.51, 0.70
#: Context of a bar, and what stands for it where a table has no such column.
CONTEXT = {"htf_agreement": "0.0", "model_confidence": "1.0", "recent_similar_wr": "CAST(NULL AS DOUBLE)", "drift_score": "0.0", "cross_asset_divergence": "false", "conformal_lower_bound": "1.0", "l1_direction": "0", "l1_conviction": "0.0", "no_setup_wr": "0.0"}


def route_plan(names: list[str], base_wr: dict[str, str] | None = None) -> Plan:
    """``base_wr`` gives the expected win rate of a setup as an expression; its prior by default."""
    wr = {n: f"{PRIOR[n]}" for n in names} | (base_wr or {})
    best = lambda side: "greatest(" + ", ".join(f"e{side}_{n}" for n in names) + ")" if len(names) > 1 else f"e{side}_{names[0]}"
    pick = lambda side, top: " ".join(f"WHEN side = {side} AND e{'l' if side > 0 else 's'}_{n} = {top} THEN '{n}'" for n in names)
    agree = lambda side: " + ".join(flag(f"q_{n} AND {side} * {n}_direction > 0") for n in names)
    lower = f"CASE WHEN recent_similar_wr < 0.5 THEN {PENALTY} ELSE 0.0 END"
    return Plan(
        [
            {f"q_{n}": f"{n}_active >= 0.5 AND {n}_strength >= {LEAST_STRENGTH} AND {n}_direction <> 0" for n in names} | {f"fit_{n}": f"{PRIOR[n]} * greatest(vss_match_{n} * tof_fit_{n}, 1e-6)" for n in names},
            {f"el_{n}": f"CASE WHEN q_{n} AND {n}_direction > 0 THEN fit_{n} END" for n in names} | {f"es_{n}": f"CASE WHEN q_{n} AND {n}_direction < 0 THEN fit_{n} END" for n in names},
            {"top_l": best("l"), "top_s": best("s")},
            {"clash": f"top_l IS NOT NULL AND top_s IS NOT NULL AND abs(top_l - top_s) < {LEAST_GAP}", "side": "CASE WHEN top_l IS NULL AND top_s IS NULL THEN 0 WHEN top_s IS NULL OR top_l > top_s THEN 1 ELSE -1 END"},
            {"picked": f"CASE WHEN clash THEN NULL {pick(1, 'top_l')} {pick(-1, 'top_s')} END"},
            {"way": "CASE WHEN clash THEN 0 WHEN side <> 0 THEN side ELSE l1_direction END", "base": "CASE picked " + " ".join(f"WHEN '{n}' THEN {wr[n]}" for n in names) + " ELSE no_setup_wr END", "mates": f"CASE side WHEN 1 THEN {agree(1)} WHEN -1 THEN {agree(-1)} ELSE 0 END"},
            {"m1": f"base + CASE WHEN htf_agreement > 0.3 THEN 0.02 WHEN htf_agreement < -0.3 THEN -0.03 ELSE 0.0 END - CASE WHEN model_confidence < 0.5 THEN 0.02 ELSE 0.0 END - {lower} - CASE WHEN cross_asset_divergence THEN 0.02 ELSE 0.0 END"},
            {"m2": clip(f"CASE WHEN drift_score > {DRIFT} THEN least(m1, {DRIFT_CAP}) ELSE m1 END", 0.0, 1.0)},
            {"m3": f"CASE WHEN picked IS NOT NULL AND mates >= 2 THEN least(1.0, m2 + {BONUS} * least(mates - 1, 2)) ELSE m2 END", "contrary": "way <> 0 AND l1_direction <> 0 AND l1_direction <> way"},
            {"wr": f"CASE WHEN contrary AND l1_conviction < {VETO} THEN greatest(0.0, m3 - {PENALTY}) ELSE m3 END"},
            {"why": f"CASE WHEN clash THEN 'setup_conflict_ambiguous' WHEN way = 0 THEN 'no_setup_no_conviction' WHEN contrary AND l1_conviction >= {VETO} THEN 'l1_direction_veto' WHEN wr < {evaluation.BREAKEVEN} THEN 'wr_below_breakeven' WHEN conformal_lower_bound < {evaluation.BREAKEVEN} - 0.01 THEN 'conformal_uncertain' END"},
        ],
        {
            "trade": flag("why IS NULL"), "setup": "picked", "direction": "way", "adjusted_wr": "CASE WHEN clash OR way = 0 THEN 0.0 ELSE round(wr, 9) END",
            "sizing_factor": f"CASE WHEN why IS NULL THEN round({clip(f'(wr - {FLOOR}) / ({CEILING} - {FLOOR})', 0.0, 1.0)} * model_confidence, 9) ELSE 0.0 END", "abstain_reason": "why",
        },
        raw=True,
    )


def route(table: DataFrame, names: list[str] | None = None, base_wr: dict[str, str] | None = None) -> DataFrame:
    """(symbol, ts, trade, setup, direction, adjusted_wr, sizing_factor, abstain_reason) of each bar of ``table``."""
    names = [n for n in structure.PRIORITY if f"{n}_active" in table.columns] if names is None else names
    given = table.select("*", *[F.expr(spark_text(e)).alias(c) for c, e in CONTEXT.items() if c not in table.columns])
    return route_plan(names, base_wr).apply(given)


# Clearance of an open road in mean ranges, what a wall takes off, the least quality of a trade, and the size of a trade without a setup.
OPEN_ROAD, WALL, ROAD_FLOOR, WAVE = 1.5, 0.6, 0.25, 0.5
#: Gates and sizes of decisions beside the clearance columns (null where they were not built).
GATES = Plan(
    [
        {"room": "CASE WHEN direction > 0 THEN pc_clearance_above_atr WHEN direction < 0 THEN pc_clearance_below_atr END", "wall": "CASE WHEN direction > 0 THEN pc_obstacle_above_strength WHEN direction < 0 THEN pc_obstacle_below_strength END"},
        {"road": f"CASE WHEN room IS NULL AND wall IS NULL THEN 1.0 ELSE {clip(clip(f'coalesce(room, 0.0) / {OPEN_ROAD}', 0.0, 1.0) + f' * (1.0 - {WALL} * ' + clip('coalesce(wall, 0.0)', 0.0, 1.0) + ')', 0.0, 1.0)} END"},
        {"taken": f"trade = 1 AND direction <> 0 AND road >= {ROAD_FLOOR}"},
    ],
    {
        "gate": flag("taken"), "side": "CASE WHEN taken THEN direction ELSE 0 END", "path_quality": "round(road, 9)", "executed": "CASE WHEN taken THEN setup END",
        "size": f"CASE WHEN taken THEN round(sizing_factor * road * CASE WHEN setup IS NULL THEN {WAVE} ELSE 1.0 END, 9) ELSE 0.0 END",
        "reason": "CASE WHEN taken THEN NULL WHEN trade = 1 AND direction <> 0 THEN 'path_walled_in' ELSE coalesce(abstain_reason, 'unknown') END",
    },
    raw=True,
)


def gates(decisions: DataFrame, clearances: DataFrame | None = None) -> DataFrame:
    """(symbol, ts, gate, side, path_quality, executed, size, reason) of ``route``'s decisions: trades whose road to the target is walled in stay out, others are sized by it; trades without a setup are half as large."""
    columns = features.family_columns("pclear")[:4]
    if clearances is None:
        beside = decisions.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
    else:
        beside = decisions.join(clearances.select("symbol", "ts", *columns), ["symbol", "ts"], "left")
    return GATES.apply(beside)


# Trades before a lift counts, and the points that tell a good or bad setup.
LIFT_ROWS, GOOD, BAD = 30, 3.0, -1.0


def setup_lift(table: DataFrame, names: list[str], long: str = "long_tp", short: str = "short_tp") -> DataFrame:
    """(setup, side, n, win_rate, lift, verdict): how often either side wins where a setup is active in its direction, and by how many points of percent more than anywhere.

    One aggregation of ``table`` (each setup's _active and _direction, and both outcomes), whatever the number of setups.
    """
    if not names:
        raise ValueError("no setups")
    sides = {1: long, -1: short}
    on = lambda n, s: (F.col(f"{n}_active") >= 0.5) & (F.col(f"{n}_direction") * s > 0.5)
    sums = [F.avg(F.col(y).cast("double")).alias(f"all{s}") for s, y in sides.items()]
    sums += [c for n in names for s, y in sides.items() for c in (F.count_if(on(n, s)).alias(f"n_{n}{s}"), F.avg(F.when(on(n, s), F.col(y).cast("double"))).alias(f"w_{n}{s}"))]
    one = table.agg(*sums)
    rows = [F.struct(F.lit(n).alias("setup"), F.lit(s).alias("side"), F.col(f"n_{n}{s}").alias("n"), F.col(f"w_{n}{s}").alias("win_rate"), ((F.col(f"w_{n}{s}") - F.col(f"all{s}")) * 100).alias("lift")) for n in names for s in sides]
    out = one.select(F.inline(F.array(*rows)))
    told = F.when(F.col("n") < LIFT_ROWS, "few").when(F.round("lift", 9) > GOOD, "good").when(F.round("lift", 9) < BAD, "bad").otherwise("none")
    return out.withColumn("verdict", told)


def isotonic(fit: DataFrame, table: DataFrame, prob: str, label: str) -> DataFrame:
    """``table`` with ``prob`` replaced by a rising step function of it, fitted on ``fit`` by pooling neighbours that fall."""
    from pyspark.ml.regression import IsotonicRegression

    known = fit.select(F.col(prob).cast("double").alias("p"), F.col(label).cast("double").alias("y")).where("p IS NOT NULL AND y IS NOT NULL")
    model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="__fitted").fit(known)
    out = model.transform(table.withColumn("p", F.col(prob).cast("double")))
    return out.withColumn(prob, F.least(F.greatest("__fitted", F.lit(1e-4)), F.lit(1 - 1e-4))).drop("__fitted", "p")


def temperature(fit: DataFrame, table: DataFrame, prob: str, label: str, rounds: int = 6, points: int = 17) -> DataFrame:
    """``table`` with the logits of ``prob`` divided by the temperature that makes ``fit`` likeliest: a grid of its logarithm, narrowed by one aggregate a round."""
    logit = lambda c: F.log(F.least(F.greatest(c.cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(c.cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))))
    known = fit.select(logit(F.col(prob)).alias("z"), F.col(label).cast("double").alias("y")).where("z IS NOT NULL AND y IS NOT NULL").cache()
    lo, hi = -4.0, 4.0
    for _ in range(rounds):
        at = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        loss = [F.sum(F.log1p(F.exp(-F.abs(F.col("z") / math.exp(t)))) + F.greatest(F.col("z") / math.exp(t), F.lit(0.0)) - F.col("y") * F.col("z") / math.exp(t)) for t in at]
        sums = list(known.agg(*loss).first())
        if sums[0] is None:
            break
        k = sums.index(min(sums))
        lo, hi = at[max(0, k - 1)], at[min(points - 1, k + 1)]
    known.unpersist()
    return table.withColumn(prob, 1 / (1 + F.exp(-logit(F.col(prob)) / math.exp((lo + hi) / 2))))


DEMO = ["sfs", "orb", "svwap", "seod", "scomp"]  # setups that are plans
#: The demo's context: arithmetic on row numbers.
DEMO_CONTEXT = {
    "htf_agreement": "((rn * 37) % 101) / 50.0 - 1.0", "model_confidence": "((rn * 31) % 89) / 89.0", "recent_similar_wr": "CASE WHEN rn % 3 = 0 THEN NULL ELSE ((rn * 17) % 83) / 83.0 END", "drift_score": "((rn * 13) % 97) / 120.0", "cross_asset_divergence": "rn % 7 = 0",
    "conformal_lower_bound": "0.4 + ((rn * 11) % 79) / 300.0", "l1_direction": "(rn % 3) - 1", "l1_conviction": "((rn * 7) % 61) / 61.0", "no_setup_wr": "0.5 + ((rn * 5) % 53) / 400.0",
}
_SPEC = features.Spec(frozenset([*DEMO, "vss", "tof"]))
_ROWS = Plan([{"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"}], {}, raw=True)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.structural_features(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15), _SPEC, shift=False)
    table = table.withColumn("rn", F.expr(_ROWS.steps[0]["rn"]))
    return route(table.select("*", *[F.expr(spark_text(e)).alias(c) for c, e in DEMO_CONTEXT.items()]), DEMO)


def routed_sql() -> str:
    names = [*DEMO, "vss", "tof"]
    joins = " ".join(f"JOIN ({features.PLANS[n].sql()}) f{k} USING (symbol, ts)" for k, n in enumerate(names))
    cols = ", ".join(f"{duck_text(e)} AS {c}" for c, e in DEMO_CONTEXT.items())
    inner = f"SELECT *, {cols} FROM (SELECT *, {_ROWS.steps[0]['rn']} FROM (SELECT symbol, ts FROM ({features.bars_sql(15)}) z) g {joins}) y(symbol, ts, " + ", ".join(c for n in names for c in features.family_columns(n)) + ", rn)"
    return route_plan(DEMO).sql(inner)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.structural_features(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15), features.Spec(frozenset([*DEMO, "pclear"])), shift=False)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of the demo's decisions."""
    table = _features(spark, sf_dir)
    out = gates(routed(spark, sf_dir), table.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in features.family_columns("pclear")]))
    return out.select("symbol", "ts", "gate", "side", *[F.round(c, 6).alias(c) for c in ("path_quality", "size")], "executed", "reason")


def gated_sql() -> str:
    return "SELECT symbol, ts, gate, side, round(path_quality, 6) AS path_quality, round(size, 6) AS size, executed, reason FROM (" + GATES.sql(f"SELECT r.*, p.* EXCLUDE (symbol, ts) FROM ({routed_sql()}) r LEFT JOIN ({features.PLANS['pclear'].sql()}) p USING (symbol, ts)") + ") g"


def lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo's setups against the outcomes of the same bars."""
    truths = labels.barrier_labels(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15), 60, None, 15).select("symbol", "ts", "long_tp", "short_tp")
    out = setup_lift(_features(spark, sf_dir).join(truths, ["symbol", "ts"]), DEMO)
    return out.select("setup", "side", "n", F.round("win_rate", 9).alias("win_rate"), F.round("lift", 6).alias("lift"), "verdict")


def lifts_sql() -> str:
    joins = " ".join(f"JOIN ({features.PLANS[n].sql()}) f_{n} USING (symbol, ts)" for n in DEMO)
    one = lambda n, s, y: f"SELECT '{n}' AS setup, {s} AS side, count(*) FILTER (WHERE {n}_active >= 0.5 AND {n}_direction * {s} > 0.5) AS n, avg({y}) FILTER (WHERE {n}_active >= 0.5 AND {n}_direction * {s} > 0.5) AS w, avg({y}) AS a FROM t"
    rows = " UNION ALL ".join(one(n, s, y) for n in DEMO for s, y in ((1, "long_tp"), (-1, "short_tp")))
    return f"""WITH t AS (SELECT * FROM ({labels.labels_sql(60, None, 15)}) l {joins}), r AS ({rows})
SELECT setup, CAST(side AS INT) AS side, n, round(w, 9) AS win_rate, round((w - a) * 100, 6) AS lift, CASE WHEN n < {LIFT_ROWS} THEN 'few' WHEN round((w - a) * 100, 9) > {GOOD} THEN 'good' WHEN round((w - a) * 100, 9) < {BAD} THEN 'bad' ELSE 'none' END AS verdict FROM r"""


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prob, fitted): the demo's probabilities of two digits and their isotonic values."""
    table = evaluation.with_demo(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15)).select((F.floor(F.col("pl") * 100) / 100).alias("prob"), "y")
    return isotonic(table.withColumnRenamed("prob", "fitted"), table.select("prob", F.col("prob").alias("fitted")).distinct(), "fitted", "y").select("prob", F.round("fitted", 9).alias("fitted"))


def calibrated_sql() -> str:
    """Pooled neighbours in closed form: the largest, over starts up to a value, of the least mean over ends from it on."""
    y = f"SELECT row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, CASE WHEN close > open THEN 1 ELSE 0 END AS y FROM ({bars_sql(15)}) b"
    return f"""WITH v AS (SELECT floor(((rn * 7919) % 1000) / 1000e0 * 100) / 100 AS prob, count(*) AS n, sum(y) AS s FROM ({y}) r GROUP BY 1),
c AS (SELECT prob, n, s, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM v WINDOW w AS (ORDER BY prob)),
m AS (SELECT a.prob AS lo, b.prob AS hi, (b.cs - a.cs + a.s) * 1e0 / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON b.prob >= a.prob),
l AS (SELECT lo, hi AS z, min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS low FROM m)
SELECT z AS prob, round(least(greatest(max(low), 0.0001), 0.9999), 9) AS fitted FROM l GROUP BY z"""


QUERIES = {"calibration_isotonic": calibrated, "router_route": routed, "router_gates": gated, "setup_lift": lifts}
ORACLES = {"calibration_isotonic": calibrated_sql(), "router_route": routed_sql(), "router_gates": gated_sql(), "setup_lift": lifts_sql()}
