"""Queries over whole tables, where a sibling of an earlier round returns a part."""

import hashlib

import duckdb
import numpy as np

from panelwise.operators import aggregates
from panelwise.plans import registry

DIR = "/root/testdata/sf0.001"


def both(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DIR}/events.parquet')")
    got, want = registry.queries()[name](spark, DIR), con.execute(registry.oracle_sql()[name])
    assert got.columns == [x[0] for x in want.description]
    rows = [sorted(map(tuple, x)) for x in (got.collect(), want.fetchall())]
    return *rows, con.execute("SELECT count(*) FROM events").fetchall()[0][0]


def test_roles_of_all_rows(spark):
    got, want, n = both(spark, "io5b_resolve_all")
    assert got == want and len(got) == n


def test_scan_and_all_but_of_all_rows(spark):
    for name in ("io1b_scan_all", "pf10b_all_but_whole"):
        got, want, n = both(spark, name)
        assert got == want and len(got) == n, name


def test_weights_follow_from_a_fit(spark):
    from panelwise.plans import estimates as X
    from panelwise.plans.chain import Chain

    c = Chain(spark, DIR)
    d = X._weighted(c).select("episode_id", "post_day", "region", "y", "observed", *X._OBSERVED_X).toPandas()
    x, y = d[list(X._OBSERVED_X)].to_numpy(float), d["y"].to_numpy(float)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(p - d["observed"]).max() < 1e-6 and np.abs(x.T @ (y - d["observed"])).max() < 1e-4
    raw = np.where(y == 1, d.groupby("region")["y"].transform("mean") / p, np.nan)
    lo, hi = np.nanpercentile(raw, [1, 99])
    d["want"] = np.where(y == 1, np.clip(raw, lo, hi), hi)
    both = d.merge(registry.queries()["e03b_fitted_weights"](spark, DIR).toPandas(), on=["episode_id", "post_day"])
    assert len(both) == len(d) and np.abs(both["weight"] - both["want"]).max() < 1e-5


def test_deficits_are_fitted(spark):
    from panelwise.plans import estimates as X
    from panelwise.plans.chain import Chain

    d = X._fitted(Chain(spark, DIR)).where("deficit IS NOT NULL").toPandas()
    x = d[list(X._DEFICIT_X)].to_numpy(float)
    assert len(d) > 20 and np.abs(x.T @ (d["weight"] * (d["deficit"] - d["pred"])).to_numpy(float)).max() < 1e-4


def test_digest_keeps_no_table_in_a_row(spark):
    rows = spark.range(30_000, numPartitions=7).selectExpr("id", "IF(id % 3 = 0, NULL, concat('é', id * 7919 % 30011)) AS s")
    keys = sorted(f"{i}|" + ("" if i % 3 == 0 else f"é{i * 7919 % 30011}") for i in range(30_000))
    got = aggregates.table_digest(rows, ["id", "s"])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert tuple(got.first()) == (30_000, hashlib.md5("~".join(keys).encode()).hexdigest())
    assert tuple(aggregates.table_digest(rows.where("id < 0"), ["id", "s"]).first()) == (0, None)
