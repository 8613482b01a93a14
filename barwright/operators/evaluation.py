"""Metrics, simulations and routing of predictions, by symbol, as plans.

Ranks break ties by time, so results do not depend on partitioning. By default a
plan runs on demo predictions, arithmetic on row numbers; ``evaluate`` runs it on a
given table, such as ``outcomes`` makes of predictions and barrier labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import clip, flag, lag, lead, over
from barwright.operators import families, labels
from barwright.plans import Plan, spark_text
from barwright.sources import bars

# Costs of a trade in points, and dollars a point.
COST = 0.5 + 3.5 / 2.0
POINT = 2.0
# Prior win rates by setup come with the candidates; these are the gates.
BREAKEVEN = 0.512

PREDS = [
    {"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "y": flag("close > open"), "y2": flag("close < open")},
    {"pl": "((rn * 7919) % 1000) / 1000.0", "ps": "((rn * 104729) % 997) / 997.0", "mfe_l": "high - open", "mae_l": "open - low", "mfe_s": "open - low", "mae_s": "high - open", "target_return": "close", "win_points": "30.0", "loss_points": "30.0"},
]
#: What a table of predictions and outcomes must have beside symbol and ts.
NEEDED = ["y", "y2", "pl", "ps", "mfe_l", "mae_l", "mfe_s", "mae_s", "target_return", "win_points", "loss_points"]
ALL = "(PARTITION BY symbol)"
_rank = lambda x: f"rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0"

PLANS: dict[str, Plan] = {}
SYM = ("symbol",)
PLANS["auc_rank"] = Plan([*PREDS, {"r": _rank("pl")}], {"auc": "(sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / NULLIF(sum(y) * (count(*) - sum(y)) * 1.0, 0)"}, keys=SYM, group=True)
PLANS["average_precision"] = Plan([*PREDS, {"tp": "sum(y) OVER (PARTITION BY symbol ORDER BY pl DESC)", "k": "count(*) OVER (PARTITION BY symbol ORDER BY pl DESC)"}], {"ap": "sum(y * tp / (k * 1.0)) / NULLIF(sum(y), 0)"}, keys=SYM, group=True)
PLANS["brier_improvement"] = Plan([*PREDS, {"e": "(pl - y) * (pl - y)"}], {"base_rate": "avg(y)", "brier": "avg(e)", "improvement": "1.0 - avg(e) / NULLIF(avg(y) * (1.0 - avg(y)), 0)"}, keys=SYM, group=True)
PLANS["spearman_ic"] = Plan(
    [*PREDS, {"a": _rank("pl"), "b": _rank("target_return")}],
    {"ic": "CASE WHEN count(*) >= 30 THEN (count(*) * sum(a * b) - sum(a) * sum(b)) / NULLIF(sqrt((count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b))), 0) END"},
    keys=SYM, group=True,
)
PLANS["topk_winrate"] = Plan([*PREDS, {"k": "row_number() OVER (PARTITION BY symbol ORDER BY pl DESC, ts)", "n": f"count(*) OVER {ALL}"}], {"win_rate": "avg(y)", "taken": "count(*)"}, keys=SYM, group=True, where="k <= greatest(1, ceil(0.1 * n))")
PLANS["reliability_bins"] = Plan([*PREDS, {"bin": "CAST(least(floor(pl * 10), 9) AS INT)"}], {"predicted": "avg(pl)", "observed": "avg(y)", "n": "count(*)"}, keys=("symbol", "bin"), group=True)

_pnl = lambda y, mfe, mae: f"(CASE WHEN {y} = 1 THEN win_points WHEN {mae} >= loss_points THEN -loss_points ELSE {mfe} - {mae} END - {COST})"
PNL = {"pnl_l": _pnl("y", "mfe_l", "mae_l"), "pnl_s": _pnl("y2", "mfe_s", "mae_s")}
TAKEN = {"usd": f"CASE WHEN tl THEN pnl_l WHEN tsh THEN pnl_s END * {POINT}"}
TOTALS = {"n_trades": "count(usd)", "n_long": "sum(CASE WHEN tl THEN 1 ELSE 0 END)", "n_short": "sum(CASE WHEN tsh THEN 1 ELSE 0 END)", "win_rate": "avg(CASE WHEN usd > 0 THEN 1.0 WHEN usd <= 0 THEN 0.0 END)", "total_usd": "coalesce(sum(usd), 0.0)", "profit_factor": "sum(CASE WHEN usd > 0 THEN usd ELSE 0.0 END) / NULLIF(-sum(CASE WHEN usd < 0 THEN usd ELSE 0.0 END), 0)"}
ABSOLUTE = [*PREDS, PNL, {"l0": "pl > 0.6 AND ps < 0.4", "s0": "ps > 0.6 AND pl < 0.4"}, {"tl": "l0 AND (NOT s0 OR pl >= ps)", "tsh": "s0 AND (NOT l0 OR ps > pl)"}, TAKEN]
PERCENTILE = [
    *PREDS, PNL,
    {"kl": "row_number() OVER (PARTITION BY symbol ORDER BY pl DESC, ts)", "ks": "row_number() OVER (PARTITION BY symbol ORDER BY ps DESC, ts)", "n": f"count(*) OVER {ALL}"},
    {"take": "greatest(1, ceil(0.05 * n))"},
    {"tl": "kl <= take AND ks > take", "tsh": "ks <= take AND kl > take"},
    TAKEN,
]
PLANS["sim_absolute"] = Plan(ABSOLUTE, TOTALS, keys=SYM, group=True)
PLANS["sim_percentile"] = Plan(PERCENTILE, TOTALS, keys=SYM, group=True)
# Thresholds of the sweep, from and step; targets and stops of the reward sweep, in points, and its shares of best bars.
ENTER, AVOID = (0.50, 0.02, 11), (0.30, 0.05, 5)
RR = [(30.0, 30.0), (25.0, 30.0), (20.0, 30.0), (40.0, 20.0), (40.0, 30.0), (50.0, 30.0), (60.0, 20.0), (60.0, 30.0)]
SHARES = [0.01, 0.05, 0.1, 0.2]
_pick = lambda i, xs: f"(CASE {i} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END)"
_level = lambda i, grid: f"round({grid[0]} + {grid[1]} * {i}, 2)"
PLANS["sim_threshold_sweep"] = Plan(
    [*PREDS, PNL, {"i": f"@each({ENTER[2]})@"}, {"j": f"@each({AVOID[2]})@"}, {"enter": _level("i", ENTER), "avoid": _level("j", AVOID)},
     {"l0": "pl > enter AND ps < avoid", "s0": "ps > enter AND pl < avoid"}, {"tl": "l0 AND (NOT s0 OR pl >= ps)", "tsh": "s0 AND (NOT l0 OR ps > pl)"}, TAKEN],
    TOTALS, keys=("symbol", "enter", "avoid"), group=True,
)
#: The best bars of either side; a bar that reaches both barriers counts as a loss, one that reaches none as nothing but its cost.
PLANS["rr_sweep"] = Plan(
    [*PREDS, {"kl": "row_number() OVER (PARTITION BY symbol ORDER BY pl DESC, ts)", "ks": "row_number() OVER (PARTITION BY symbol ORDER BY ps DESC, ts)", "n": f"count(*) OVER {ALL}"},
     {"i": f"@each({len(RR)})@"}, {"j": f"@each({len(SHARES)})@"}, {"target": _pick("i", [t for t, _ in RR]), "stop": _pick("i", [s for _, s in RR]), "share": _pick("j", SHARES)},
     {"take": "ceil(n * share - 1e-9)"}, {"tl": flag("kl <= take"), "tsh": flag("ks <= take")},
     {"won": f"tl * {flag('mfe_l >= target AND mae_l < stop')} + tsh * {flag('mfe_s >= target AND mae_s < stop')}", "lost": f"tl * {flag('mae_l >= stop')} + tsh * {flag('mae_s >= stop')}"}],
    {"n_trades": "sum(tl + tsh)", "wins": "sum(won)", "losses": "sum(lost)", "win_rate": "sum(won) * 1.0 / sum(tl + tsh)", "total_usd": f"(sum(won * target) - sum(lost * stop) - sum(tl + tsh) * {COST}) * {POINT}"},
    keys=("symbol", "target", "stop", "share"), group=True, where="take >= 10",
)
DAILY = Plan([*ABSOLUTE, {"day": "CAST(ts AS DATE)"}], {"usd": "coalesce(sum(usd), 0.0)"}, keys=("symbol", "day"), group=True)
_day = lambda f, x: f"{f}({x}) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PLANS["daily_equity_drawdown"] = Plan([{"equity": _day("sum", "usd")}, {"peak": _day("max", "equity")}], {"usd": "usd", "equity": "equity", "drawdown": "peak - equity"}, keys=("symbol", "day"), source=DAILY)
PLANS["sharpe_sortino"] = Plan(
    [], {"sharpe": "avg(usd) / NULLIF(stddev_samp(usd), 0) * sqrt(252.0)", "sortino": "avg(usd) / NULLIF(stddev_samp(CASE WHEN usd < 0 THEN usd END), 0) * sqrt(252.0)", "days": "count(*)"},
    keys=SYM, group=True, source=DAILY, where="usd <> 0",
)
PLANS["grade_assignment"] = Plan(
    [*PREDS, {"p": "greatest(pl, ps)"}, {"k": "row_number() OVER (PARTITION BY symbol ORDER BY p DESC, ts)", "n": "sum(CASE WHEN p > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol)"}],
    {"grade": "CASE WHEN p <= 1e-9 THEN 0 WHEN k <= ceil(0.005 * n) THEN 4 WHEN k <= ceil(0.01 * n) THEN 3 WHEN k <= ceil(0.05 * n) THEN 2 WHEN k <= ceil(0.2 * n) THEN 1 ELSE 0 END"},
)
PLANS["worst_intraday_dd"] = Plan(
    [*ABSOLUTE, {"day": "CAST(ts AS DATE)", "u": "coalesce(usd, 0.0)"}, {"cum": "sum(u) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, {"peak": "greatest(0.0, max(cum) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"}],
    {"worst_dd": "max(peak - cum)"}, keys=SYM, group=True,
)
PLANS["l2_derived_features"] = Plan(
    [*PREDS, {"a": clip("pl * 0.5", 1e-9, 1.0), "b": clip("ps * 0.5", 1e-9, 1.0)}, {"c": clip("1.0 - a - b", 1e-9, 1.0)}],
    {"direction": "CASE WHEN a >= b THEN 1 ELSE -1 END", "strength": "greatest(a, b)", "margin": "abs(a - b)", "entropy": "-(a * ln(a) + b * ln(b) + c * ln(c))", "expected_r": "CASE WHEN a >= b THEN mfe_l / (mae_l + 1e-9) ELSE mfe_s / (mae_s + 1e-9) END"},
    where="mae_l > 0 AND mae_s > 0",
    digits=9,  # probabilities have six digits, so their halves end in the seventh
)
PLANS["candidate_selection"] = Plan([*PREDS, {"m": "round(abs(pl - ps), 9)"}, {"k": "row_number() OVER (PARTITION BY symbol ORDER BY m DESC, ts)", "n": f"count(*) OVER {ALL}"}], {"margin": "m", "rank": "k", "side": "CASE WHEN pl >= ps THEN 1 ELSE -1 END", "meta_label": "CASE WHEN pl >= ps THEN y ELSE y2 END"}, where="k <= greatest(1, ceil(0.1 * n))")
PLANS["conformal_interval"] = Plan(
    [*PREDS, {"score": "round(abs(pl - y), 9)"}, {"k": "row_number() OVER (PARTITION BY symbol ORDER BY score, ts)", "n": f"count(*) OVER {ALL}"}, {"pos": "1 + ceil((n - 1) * least(ceil((n + 1) * 0.9 - 1e-9) / (n * 1.0), 1.0) - 1e-9)"}, {"q": f"max(CASE WHEN k = pos THEN score END) OVER {ALL}"}],
    {"q": "q", "lo": "greatest(pl - q, 0.0)", "hi": "least(pl + q, 1.0)", "trade": flag("pl - q >= 0.55")},
)
PLANS["encoder_disagreement"] = Plan(
    [*PREDS, {"a": clip("pl", 1e-6, 0.999999), "b": clip("ps", 1e-6, 0.999999)}],
    {"abs_diff": "abs(a - b)", "sym_kl": "0.5 * ((a - b) * (ln(a) - ln(b)) + (b - a) * (ln(1.0 - a) - ln(1.0 - b)))", "concordant": flag("(a >= 0.5) = (b >= 0.5)")},
)
MODULATED = {
    "wr": clip("pl + CASE WHEN htf > 0.3 THEN 0.02 WHEN htf < -0.3 THEN -0.03 ELSE 0.0 END - CASE WHEN conf < 0.5 THEN 0.02 ELSE 0.0 END - CASE WHEN recent < 0.5 THEN 0.03 ELSE 0.0 END - CASE WHEN diverge = 1 THEN 0.02 ELSE 0.0 END", -1.0, 2.0)
}
ROUTER = [*PREDS, {"htf": "ps * 2.0 - 1.0", "conf": "((rn * 31) % 101) / 101.0", "recent": "((rn * 17) % 89) / 89.0", "diverge": "(rn % 7) / 6", "drift": "((rn * 13) % 97) / 97.0"}, {"diverge_": "CASE WHEN rn % 7 = 0 THEN 1 ELSE 0 END"}]
_wr = clip(f"CASE WHEN drift > 0.7 THEN least(wr0, 0.4) ELSE wr0 END", 0.0, 1.0)  # noqa: F541
ROUTED = [*ROUTER, {"wr0": MODULATED["wr"].replace("diverge = 1", "diverge_ = 1")}, {"wr": _wr}]
PLANS["router_modulators"] = Plan(ROUTED, {"adjusted_wr": "wr"})
PLANS["router_decision"] = Plan([*ROUTED, {"lb": "wr - 0.005 - conf * 0.01"}], {"wr": "wr", "trade": flag(f"wr >= {BREAKEVEN} AND lb >= {BREAKEVEN} - 0.01"), "reason": f"CASE WHEN wr < {BREAKEVEN} THEN 1 WHEN lb < {BREAKEVEN} - 0.01 THEN 2 ELSE 0 END", "sizing": clip("(wr - 0.51) / 0.19", 0.0, 1.0)})
PLANS["tracker_recent_wr"] = Plan([*PREDS, {"setup": "rn % 8", "k": "row_number() OVER (PARTITION BY symbol, rn % 8 ORDER BY ts DESC)"}], {"n": "count(*)", "recent_wr": "avg(y)", "r_mean": "avg(close - open)", "r_std": "stddev_pop(close - open)"}, keys=("symbol", "setup"), group=True, where="k <= 30")
PLANS["cascade_percentile"] = Plan([*PREDS, {"k": "row_number() OVER (PARTITION BY symbol ORDER BY pl DESC, ts)", "n": f"count(*) OVER {ALL}"}], {"passed": "count(*)", "wins": "sum(y)"}, keys=SYM, group=True, where="k <= greatest(1, ceil(0.2 * n)) AND ps < 0.5")

SHAPE = [{"up": "greatest(close - open, 0.0)", "r15": f"{lead('close', 15)} - close", "gap": f"{lead('ts', 15)}", "rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "n": f"count(*) OVER {ALL}", "past": f"close - {lag('close', 10)}"}]
PLANS["label_returns"] = Plan([*SHAPE, {"tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"}, {"atr": f"CASE WHEN {over('count', 'tr', -60, -1)} >= 15 THEN greatest({over('avg', 'tr', -60, -1)}, 0.5) END"}], {"return_h15": clip("r15 / atr", -10.0, 10.0)}, where="rn <= n - 15")


def with_demo(frame: DataFrame) -> DataFrame:
    """Bars with the demo's predictions and outcomes."""
    for step in PREDS:
        frame = frame.select("*", *[F.expr(spark_text(e)).alias(a) for a, e in step.items()])
    return frame


def outcomes(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Predictions (symbol, ts, long_tp_prob, short_tp_prob) beside what ``labels.barrier_labels`` says of the same bars."""
    took = ["long_tp AS y", "short_tp AS y2", "mfe_long AS mfe_l", "mae_long AS mae_l", "mfe_short AS mfe_s", "mae_short AS mae_s", "return_h60 AS target_return", "tp_points AS win_points", "sl_points AS loss_points"]
    given = predictions.selectExpr("symbol", "ts", "CAST(long_tp_prob AS DOUBLE) AS pl", "CAST(short_tp_prob AS DOUBLE) AS ps")
    return given.join(truths.selectExpr("symbol", "ts", *took), ["symbol", "ts"])


def evaluate(name: str, table: DataFrame) -> DataFrame:
    """The plan ``name`` on a table with symbol, ts and the columns NEEDED, one row a prediction."""
    return _on(PLANS[name], table)


def _on(plan: Plan, table: DataFrame) -> DataFrame:
    if plan.source is not None:
        return plan.apply(_on(plan.source, table))
    if missing := set(NEEDED) - set(table.columns):
        raise ValueError(f"the table lacks {sorted(missing)}")
    rows = table.select("symbol", "ts", *NEEDED, F.expr(PREDS[0]["rn"]).alias("rn"))
    return _bare(plan).apply(rows)


def _bare(plan: Plan) -> Plan:
    """The plan without the steps that make demo predictions."""
    return Plan(plan.steps[len(PREDS) :], plan.out, keys=plan.keys, where=plan.where, group=plan.group, raw=plan.raw, digits=plan.digits)


#: Plans that only need a table's columns; they also run on the momentum baseline against its own labels.
ON_TABLES = [n for n, p in PLANS.items() if p.source is None and p.steps[: len(PREDS)] == PREDS and not any(w in str(p.steps[len(PREDS) :]) + str(p.out) for w in ("close", "open", "% 7"))]


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The momentum baseline's predictions of 15-minute bars and their outcomes."""
    given = families.PRIMITIVES["momentum_baseline"].run(spark, sf_dir).withColumnsRenamed({"long_tp_pred": "long_tp_prob", "short_tp_pred": "short_tp_prob"})
    return outcomes(given, labels.barrier_labels(bars(spark.read.parquet(f"{sf_dir}/events.parquet"), 15), 60, None, 15))


BASELINE_SQL = f"""SELECT symbol, ts, p.long_tp_pred AS pl, p.short_tp_pred AS ps, l.long_tp AS y, l.short_tp AS y2, l.mfe_long AS mfe_l, l.mae_long AS mae_l, l.mfe_short AS mfe_s, l.mae_short AS mae_s,
 l.return_h60 AS target_return, l.tp_points AS win_points, l.sl_points AS loss_points, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
FROM ({families.PRIMITIVES["momentum_baseline"].sql()}) p JOIN ({labels.labels_sql(60, None, 15)}) l USING (symbol, ts)"""


def _baseline_query(name: str):
    return lambda spark, sf_dir: evaluate(name, baseline(spark, sf_dir))


def calendar_sums(daily: DataFrame, period: str = "day") -> DataFrame:
    """(symbol, period, usd): sums of (symbol, day, usd) by day or month, empty ones included as 0."""
    each = daily.groupBy("symbol", F.date_trunc(period, "day").cast("date").alias("at")).agg(F.sum("usd").alias("usd"))
    spine = each.groupBy("symbol").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {period}"))).alias("at"))
    return spine.join(each, ["symbol", "at"], "left").select("symbol", F.col("at").alias("day"), F.coalesce(F.round("usd", 6), F.lit(0.0)).alias("usd"))


def _calendar_sql(period: str) -> str:
    return f"""WITH d AS (SELECT symbol, CAST(date_trunc('{period}', day) AS DATE) AS d0, sum(usd) AS usd FROM ({DAILY.sql()}) x WHERE CAST(day AS DATE) <> DATE '2024-01-10' GROUP BY 1, 2)
SELECT s.symbol, s.d0 AS day, coalesce(round(d.usd, 6), 0) AS usd FROM (SELECT symbol, CAST(unnest(generate_series(min(d0)::TIMESTAMP, max(d0)::TIMESTAMP, INTERVAL 1 {period})) AS DATE) AS d0 FROM d GROUP BY symbol) s LEFT JOIN d USING (symbol, d0)"""


def _calendar(period: str):
    """The demo's days but one, so that a gap is filled."""
    return lambda spark, sf_dir: calendar_sums(DAILY.run(spark, sf_dir).where("day <> DATE '2024-01-10'"), period)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's diagnostics by symbol and what they say: the sides' correlation, the rank correlation with the hour's return, the area of the long side."""
    from barwright.operators import dataset

    table = baseline(spark, sf_dir)
    corr = table.groupBy("symbol").agg(F.round(F.corr("pl", "ps"), 9).alias("side_corr"))
    ic = evaluate("spearman_ic", table).select("symbol", F.col("ic").alias("ic_60"))
    auc = evaluate("auc_rank", table).select("symbol", F.col("auc").alias("clear_auc"))
    none = F.lit(None).cast("double")
    out = corr.join(ic, "symbol").join(auc, "symbol").withColumns({"ic_15": none, "shape_accuracy": none})
    return dataset.verdict(out).drop("ic_15", "shape_accuracy")


def verdicts_sql() -> str:
    tell = lambda k: f"CAST(coalesce(side_corr < {(-0.3, -0.5)[k]}, false) AS INT) + CAST(coalesce(ic_60 > {(0.03, 0.06)[k]}, false) AS INT) + CAST(coalesce(clear_auc > {(0.53, 0.56)[k]}, false) AS INT)"
    parts = {"c": f"SELECT symbol, round(corr(pl, ps), 9) AS side_corr FROM ({BASELINE_SQL}) t GROUP BY symbol", "i": _bare(PLANS["spearman_ic"]).sql(BASELINE_SQL), "a": _bare(PLANS["auc_rank"]).sql(BASELINE_SQL)}
    return f"""WITH j AS (SELECT symbol, side_corr, ic AS ic_60, auc AS clear_auc FROM ({parts["c"]}) c JOIN ({parts["i"]}) i USING (symbol) JOIN ({parts["a"]}) a USING (symbol)), p AS (SELECT *, {tell(0)} AS weak, {tell(1)} AS strong FROM j)
SELECT symbol, side_corr, ic_60, clear_auc, CASE WHEN coalesce(side_corr, ic_60, clear_auc) IS NULL THEN 'INCONCLUSIVE' WHEN side_corr > 0.5 THEN 'PACING' WHEN strong >= 3 THEN 'STRONG-PREDICTIVE' WHEN weak >= 3 THEN 'PREDICTIVE' WHEN weak >= 1 THEN 'WEAK' ELSE 'PACING-LIKE' END AS verdict FROM p"""


QUERIES = {f"baseline_{n}": _baseline_query(n) for n in ON_TABLES} | {"daily_calendar": _calendar("day"), "monthly_calendar": _calendar("month"), "prediction_verdict": verdicts}
ORACLES = {f"baseline_{n}": _bare(PLANS[n]).sql(BASELINE_SQL) for n in ON_TABLES} | {"daily_calendar": _calendar_sql("day"), "monthly_calendar": _calendar_sql("month"), "prediction_verdict": verdicts_sql()}
