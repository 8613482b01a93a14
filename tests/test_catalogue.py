"""Every query against its SQL, by value."""

import duckdb
import pandas as pd
import pytest

from barwright.plans import catalogue

TABLES = ["events", "lineitem", "orders", "embeddings"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype.kind in "ifub":
            df[c] = df[c].astype(float)
        elif df[c].map(type).astype(str).str.contains("date").any():
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        else:
            df[c] = df[c].astype(object)
    keys = [c for c in ("symbol", "event_type", "ts", "minute", "day", "bin", "setup", "regime", "fold", "role", "enter", "avoid", "target", "stop", "share", "feature", "other", "prob", "metric", "i", "j", "mode") if c in df.columns]
    return df.sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = tidy(catalogue.QUERIES[name](spark, sf_dir).toPandas())
    want = tidy(duck.sql(catalogue.ORACLES[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=2e-9)


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        got = catalogue.QUERIES[name](spark, sf_dir)
        assert got.count() and len(got.columns) > 2
