"""All queries over bars and their SQL."""

from dataclasses import replace

from pyspark.sql import functions as F

from barwright.operators import anomaly, audit, dataset, evaluation, execution, families, features, intervals, kernels, labels, neighbours, order, paths, router, setups, structure, training
from barwright.plans import Plan, kernels_sql
from barwright.sources import bars_sql
from barwright.streaming import queries as streams

PLANS: dict[str, Plan] = families.PRIMITIVES | {f"fam_{k}": p for k, p in (families.FAMILIES | setups.SETUPS).items()} | evaluation.PLANS | {"sim_candidates": execution.CANDIDATES}
#: Opening ranges break only where a session has many bars: minute bars of all events together.
PLANS["fam_orb_minutes"] = replace(setups.SETUPS["orb"], minutes=1, pool=True)
QUERIES = {k: p.run for k, p in PLANS.items()} | labels.QUERIES | kernels.QUERIES | structure.QUERIES | execution.QUERIES | audit.QUERIES | features.QUERIES | evaluation.QUERIES | router.QUERIES | dataset.QUERIES | order.QUERIES | training.QUERIES | intervals.QUERIES | streams.QUERIES | anomaly.QUERIES | paths.QUERIES | neighbours.QUERIES
ORACLES = {k: p.sql() for k, p in PLANS.items()} | labels.ORACLES | audit.ORACLES | features.ORACLES | evaluation.ORACLES | router.ORACLES | dataset.ORACLES | order.ORACLES | training.ORACLES | intervals.ORACLES | streams.ORACLES | anomaly.ORACLES | paths.ORACLES | neighbours.ORACLES
ORACLES["ema_trend"] = f"""
WITH RECURSIVE b AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars_sql(15)}) x),
e AS (SELECT symbol, ts, rn, CAST(close AS DOUBLE) AS ema8, CAST(close AS DOUBLE) AS ema32 FROM b WHERE rn = 1
 UNION ALL SELECT b.symbol, b.ts, b.rn, e.ema8 + 2e0 / 9 * (b.close - e.ema8), e.ema32 + 2e0 / 33 * (b.close - e.ema32) FROM e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
SELECT symbol, ts, round(ema8, 6) AS ema8, round(ema32, 6) AS ema32 FROM e"""
ORACLES["embedding_cache_join"] = (
    "SELECT g.symbol, g.ts, "
    + ", ".join(f"coalesce(round(CAST(e.embedding[{i + 1}] AS DOUBLE), 6), 0) AS simmtm_{i:03d}" for i in range(kernels.CACHED))
    + f" FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS vec_id FROM ({bars_sql(15)}) x) g LEFT JOIN embeddings e ON e.vec_id = g.vec_id"
)


def rounded(query, digits: int = 6):
    """The query with its numbers rounded, as SQL's are."""

    def run(spark, sf_dir):
        out = query(spark, sf_dir)
        return out.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else c for c, t in out.dtypes])

    return run


def rounded_sql(sql: str, columns: list[str], digits: int = 6) -> str:
    return f"SELECT symbol, ts, {', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns)} FROM ({sql}) r"


_setups = {n: structure.KERNELS[n][1] for n in ("mtf", "spb", "sfa", "sld", "trend", "liquidity", "lasym", "tstruct")}
for _name, _sql, _cols in (
    ("kern_facc", kernels_sql.facc(), kernels.KERNELS["kern_facc"][1]),
    *((f"fam_{n}", getattr(kernels_sql, n)(), c) for n, c in _setups.items()),
    ("fam_scnf", kernels_sql.scnf(), features.family_columns("scnf")),
    ("fam_shtf", kernels_sql.shtf(), features.family_columns("shtf")),
):
    QUERIES[_name] = rounded(QUERIES[_name])
    ORACLES[_name] = rounded_sql(_sql, _cols)
