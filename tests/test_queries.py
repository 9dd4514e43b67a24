"""A sample of the registered queries against their SQL twins, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from panelwise.plans import registry

DIR = "/root/testdata/sf0.001"
NAMES = ("cp04_episodes", "cp08_baseline", "cp11_day_panel", "cp12_events", "cp14_risk_sets", "pf14_deficit", "q09_panel_invariants", "dc07_complementary", "e12_logit_shift")


def norm(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>"):
        return "None"
    if str(v) in ("True", "False"):
        return str(v)
    try:
        return repr(round(float(v), 5) + 0.0)
    except (TypeError, ValueError):
        return str(v)[:10] if hasattr(v, "year") else str(v)


def rows_of(df, cols):
    return sorted(tuple(map(norm, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert rows_of(got, cols) == rows_of(want, cols)


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
