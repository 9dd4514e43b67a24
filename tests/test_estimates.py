"""Fits, bootstrap and other estimators: recovery on made data, and queries against their recursive twins."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import DIR, rows_of

from panelwise.operators import aggregates, estimators, events, running
from panelwise.params import SCALED
from panelwise.plans import registry

NAMES = ("e03_inverse_weights", "e04_logit_fit", "e08_g_computation", "e15_imputation", "e22_contrast", "cp15b_full_ladder", "cp25b_gate_ledger", "q08b_baseline_rules", "q22_ladder_problems", "dc07b_complementary_grid", "dc17b_strata_both_ways", "dc12_daily_curve", "w11_precision_at_rank", "cp13_landmark_panel")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DIR}/events.parquet')")
    got, want = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and rows_of(got, cols) == rows_of(want, cols)


def test_unobserved_days_have_no_weight_and_bad_probabilities_are_refused(spark):
    rows = [("g", True, 0.5), ("g", False, 0.2), ("g", True, 0.8)]
    d = spark.createDataFrame(rows, "r string, seen boolean, p double")
    got = {x["p"]: x["weight"] for x in estimators.inverse_weights(d, "seen", "p", "r", 0.0, 1.0).collect()}
    assert got[0.2] is None and abs(got[0.5] - (2 / 3) / 0.5) < 1e-12 and abs(got[0.8] - (2 / 3) / 0.8) < 1e-12
    with pytest.raises(Exception, match="outside"):
        estimators.inverse_weights(d.withColumn("p", F.lit(0.0)), "seen", "p", "r").collect()


def test_bootstrap_refit_covers_and_agrees_on_rerun(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(0.3 + 0.9 * x)))).astype(float)
    d = spark.createDataFrame([(1.0, float(a), float(b), 1.0, i % 300) for i, (a, b) in enumerate(zip(x, y, strict=True))], "one double, x double, y double, w double, u int")
    one = estimators.bootstrap_fit(d, "u", ("one", "x"), "y", "w", 40)
    two = estimators.bootstrap_fit(d.repartition(7), "u", ("one", "x"), "y", "w", 40)
    assert np.allclose([r[1:5] for r in one], [r[1:5] for r in two]) and one[1][2] < 0.9 < one[1][3] and one[1][4] < 0.1 and one[1][5] == 0


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 50, 500), strict=True))] + [(None, 4, 1000), (None, None, 1001)]
    got = {r["i"]: r["s"] for r in running.running_sums(spark.createDataFrame(rows, "g int, v int, i int"), ["g"], [F.asc("v"), F.asc("i")], {"s": F.col("v")}).collect()}
    want, sums = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[i] = sums[g]
    assert got == want
    assert running.running_sums(spark.createDataFrame([], "v int"), [], [F.asc("v")], {"n": F.lit(1)}).count() == 0


def test_risk_sets_do_not_depend_on_the_parts(spark):
    rng = np.random.default_rng(2)
    features = [(f"e{k}", k, int(rng.integers(3, 15))) for k in range(60)]
    f = spark.createDataFrame(features, "episode_id string, person_id int, at_risk_last_day int").withColumn("discharge_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("person_id") % 9))
    ev = spark.createDataFrame([(f"e{k}-x", f"e{k}", k, int(rng.integers(4, 9)), int(rng.integers(1, 8)), True, False) for k in range(0, 60, 6)], "event_id string, episode_id string, person_id int, event_day int, landmark_dow int, is_first_event boolean, no_window boolean")
    one, many = (sorted(map(tuple, events.risk_sets(f.repartition(n), ev.repartition(n), SCALED).collect())) for n in (1, 13))
    assert one == many and len(one) > 20


def test_refusals_of_code_sets(spark):
    d = spark.createDataFrame([("a",), ("b",)], "k string")
    assert aggregates.exact_size(d, 2).count() == 2 and aggregates.all_levels(d, "k", ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        aggregates.exact_size(d, 3)
    with pytest.raises(ValueError, match="c"):
        aggregates.all_levels(d, "k", ["a", "c"])


def test_fallback_is_recorded():
    def refuse():
        raise ValueError("separated: too far")

    assert estimators.fit_or_step_down([("a", refuse), ("b", lambda: 3), ("c", lambda: 4)]) == (3, [(1, "a", "failed: separated"), (2, "b", "fitted")])
