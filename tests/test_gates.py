"""Gates between parts of an analysis, and the ladder of estimators with named triggers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import descent as L
from panelwise.operators import gates as G
from panelwise.operators.groups import tier_for_count
from panelwise.sources import io

ZONES = "p int, d int, z string, m long"


def verdict(spark, rows):
    bands = G.zone_bands(spark.createDataFrame(rows, ZONES), "p", "d", "z", "m")
    return tuple(G.zone_verdict(bands).first()), {(r.block, r.label): r.n for r in bands.collect()}


@pytest.mark.parametrize(("rows", "want"), [
    ([], ("not_run", 0)),
    ([(1, 1, "a", 700), (1, 1, "a", 700), (2, 1, "a", 2000)], ("repeated_label", 2)),
    ([(1, 1, None, 10)], ("repeated_label", 1)),
    ([(1, 1, "a", 1000), (1, 1, "b", 441), (1, 2, "a", 1440)], ("above_ceiling", 2)),
    ([(1, 1, "a", 1000), (1, 1, "b", 440), (1, 2, "a", None)], ("partition", 2)),
    ([(1, 1, "a", 1380)], ("partition", 1)),
    ([(1, 1, "a", 1379), (2, 1, "b", None)], ("inconclusive", 2)),
])
def test_zone_verdicts(spark, rows, want):
    assert verdict(spark, rows)[0] == want


def test_zone_bands(spark):
    _, n = verdict(spark, [(1, 1, "a", 599), (1, 2, "a", 600), (1, 3, "b", None), (2, 1, "a", 1441), (2, 2, "c", 1440)])
    assert n == {("minutes", "person_days"): 5, ("minutes", "persons"): 2, ("minutes", "below_valid"): 1, ("minutes", "valid"): 2, ("minutes", "above_ceiling"): 1, ("minutes", "top"): 1,
                 ("minutes", "repeated_label"): 0, ("minutes", "null_minutes"): 1, ("minutes", "no_total"): 1, ("zone", "a"): 3, ("zone", "b"): 1, ("zone", "c"): 1}


def test_verdict_without_a_band_is_not_run(spark):
    bands = G.zone_bands(spark.createDataFrame([(1, 1, "a", 1400)], ZONES), "p", "d", "z", "m")
    assert G.zone_verdict(bands.where("label <> 'top'")).first().verdict == "not_run"


def test_tiers_and_catalogue(spark):
    counts = spark.createDataFrame([(n,) for n in (0, 19, 20, 49, 50, 99, 100)], "n long")
    got = {r.n: (r.t, r.w) for r in counts.select("n", G.tier_number(F.col("n")).alias("t"), tier_for_count(F.col("n")).alias("w")).collect()}
    assert got == {0: (4, "none"), 19: (4, "none"), 20: (3, "descriptive"), 49: (3, "descriptive"), 50: (2, "reduced"), 99: (2, "reduced"), 100: (1, "full")}
    rows = G.permitted(counts.where("n IN (19, 50, 100)"), G.catalogue(spark), "n").collect()
    assert len(rows) == 3 * 19
    assert [sum(r.permitted for r in rows if r.n == n) for n in (19, 50, 100)] == [2, 12, 18]
    assert {r.why for r in rows if r.analysis == "broad_feature_selection"} == {"never"}


def test_stage_problems(spark):
    leaf = F.col("stratum") != "all"

    def found(rows):
        ledger = spark.createDataFrame(rows, "stage string, part string, stratum string, n long")
        return sorted(map(tuple, G.stage_problems(ledger, "ABC", "B", "C", leaf).collect()))

    good = [("A", "total", "all", 9), ("B", "total", "all", 5), ("C", "total", "all", 5), ("C", "total", "x", 2), ("C", "total", "y", 3)]
    assert found(good) == []
    assert found([]) == [("absent_stage", s, 1, 0) for s in "ABC"]
    assert found(good[1:]) == [("absent_stage", "A", 1, 0)]
    assert found([("A", "total", "all", 4), *good[1:]]) == [("rises", "B", 4, 5)]
    assert found(good[:-1]) == [("split_differs", "C", 5, 2)]
    assert found([*good, good[-1], ("Z", "total", "all", 1)]) == [("repeated_row", "C", 1, 2), ("split_differs", "C", 5, 8), ("unknown_stage", "Z", 0, 1)]
    # a stage without a total is stepped over: the next is held against the last that has one
    assert found([("A", "total", "all", 4), ("C", "total", "all", 5)]) == [("absent_stage", "B", 1, 0), ("rises", "C", 4, 5)]


def test_missingness_and_observation_problems(spark):
    def gaps(rows, variables=("a", "b"), complete=("a",)):
        ledger = spark.createDataFrame(rows, "variable string, n long, n_missing long")
        return {r.rule: r.n for r in G.missingness_problems(ledger, variables, complete).collect()}

    assert gaps([("a", 5, 0), ("b", 5, 5)]) == {}
    assert gaps([]) == {"empty": 1, "absent": 2}
    assert gaps([("a", 5, 1), ("b", 5, 6), ("c", 1, -1), ("b", 1, 0), (None, 1, 0)]) == {"gap_in_complete": 1, "missing_over_rows": 1, "undeclared": 2, "negative": 1, "repeated": 1}
    bands = spark.createDataFrame([("unavailable", 3, 3, 2, 3), ("none", 3, 4, 2, 1), ("odd", 1, 0, 1, 0)], "band string, n_days long, n_at_risk long, n_analyzable long, n_first_day long")
    found = lambda d: {r.rule: r.n for r in G.observation_problems(d).collect()}
    assert found(bands) == {"unknown_band": 1, "analyzable_over_at_risk": 1, "at_risk_over_days": 1, "lag_on_first_day": 1}
    assert found(bands.limit(0)) == {"no_first_day": 1}
    shares = spark.createDataFrame([(x,) for x in (None, 0.0, 0.2, 0.25, 0.5, 0.75, 1.0)], "s double")
    assert [r[0] for r in shares.select(G.lag_band(F.col("s"))).collect()] == list(G.LAG_BANDS)


def test_print_problems(spark):
    t = spark.createDataFrame([("x", 20, 1), ("y", None, 2), ("on 2024-01-02", 7, 3), ("a–b", 0, 4)], "k string, n long, `n–x` long")
    found = lambda d, *a: sorted(map(tuple, G.print_problems(d, *a).collect()))
    assert found(t.where("n = 20 OR n IS NULL").select("k", "n"), ["n"], ["k"]) == []
    assert found(t, ["n", "q"], ["k", "n"]) == [("absent", "q", 1), ("banned_dash", "k", 1), ("banned_dash", "n–x", 1), ("date", "k", 1), ("declared_twice", "n", 1), ("illegal_count", "n", 1), ("undeclared", "n–x", 1)]
    dated = t.select(F.lit("2024-01-01").cast("date").alias("d"), F.lit("suppressed").alias("c"))
    assert found(dated, ["c"], ["d"]) == [("date", "d", 1), ("illegal_count", "c", 4)]
    assert found(spark.createDataFrame([], "k string, n long"), ["n"], ["k"]) == []


def test_sink_refuses_every_class(spark, tmp_path):
    t = spark.createDataFrame([("x", "a", 40, 10), ("x", "b", None, None), ("x", "c", None, None)], "g string, k string, n long, pct long")
    ok = dict(counts=["n"], percents={"pct": "n"}, texts=["k"], partitions={"n": ["g"]})
    io.gated_export(t, str(tmp_path / "ok"), **ok)
    bad = {"2_illegal_count": t.withColumn("n", F.coalesce("n", F.lit(7))), "3_percent": t.withColumn("pct", F.lit(1)), "4_lone_hidden": t.where("k <> 'c'"),
           "5_banned": t.withColumn("k", F.lit("<b>")), "7_date": t.withColumn("k", F.lit("2024-01-01")), "7_identifier": t.withColumn("person_id", F.lit(1))}
    for name, df in bad.items():
        with pytest.raises(ValueError, match=name):
            io.gated_export(df, str(tmp_path / name), **ok)
        assert not os.path.exists(tmp_path / name)
    with pytest.raises(ValueError, match="6_kind"):
        io.gated_export(t, str(tmp_path / "kind"), kind="results", **ok)


def test_table_sizes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    row = io.table_sizes({"t": spark.read.parquet(path), "other": spark.range(1)}, "^t$").collect()
    assert [tuple(r) for r in row] == [("t", 100, len(files), sum(os.path.getsize(f"{path}/{f}") for f in files))]
    with pytest.raises(ValueError, match="no table"):
        io.table_sizes({"t": spark.range(1)}, "x")


def test_ledgers_compared(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 3), (4, 1)], "k int, n long"), spark.createDataFrame([(1, 5), (2, 4), (3, 1)], "k int, n long")
    assert sorted(map(tuple, G.compared(a, b, "k", "n").collect())) == [(1, 5, 5, True), (2, 3, 4, False), (3, None, 1, False), (4, 1, None, False)]


def failing(trigger):
    def fit():
        raise L.RungFailure(trigger, "here")

    return fit


def test_descent():
    floor = L.Rung("floor", lambda: "means")
    far = [L.Rung("far_a", failing("T0"), ("T0",), True, "far"), L.Rung("far_b", lambda: 1 / 0, ("T1",), True, "far"), L.Rung("near", failing("T2"), ("T1", "T2"), True), floor]
    got = L.descend(far)
    assert (got.result, got.rung, got.triggers) == ("means", 4, ["T0", "T2"])
    assert [o for _, _, o in got.outcomes] == ["skipped", "skipped", "did not converge", "converged"]
    got = L.descend([L.Rung("a", lambda: 1, (), True), floor], bounded=False)
    assert (got.rung, got.triggers, [o for _, _, o in got.outcomes]) == (2, [], ["skipped", "converged"])
    got = L.descend([L.Rung("a", lambda: 1), floor])
    assert [o for _, _, o in got.outcomes] == ["converged", "not attempted"]
    got = L.descend([L.Rung("a", lambda: 1), floor], start=2)
    assert (got.triggers, [o for _, _, o in got.outcomes]) == ([], ["skipped", "converged"])

    def singular():
        return np.linalg.inv(np.zeros((2, 2)))

    assert L.descend([L.Rung("a", singular, ("T1",)), floor]).triggers == ["T1"]
    with pytest.raises(RuntimeError, match="does not list"):
        L.descend([L.Rung("a", failing("T3"), ("T1",)), floor])
    with pytest.raises(RuntimeError, match="no rung"):
        L.descend([L.Rung("a", failing("T1"), ("T1",))])
    with pytest.raises(KeyError):
        L.RungFailure("T9", "no such trigger")


def test_descent_after_unstable_resamples():
    rungs = [L.Rung("a", failing("T1"), ("T1",)), L.Rung("b", lambda: 2), L.Rung("c", lambda: 3), L.Rung("floor", lambda: 4)]
    asked = []

    def resamples(rung):
        asked.append(rung)
        return [None] * (3 if rung == 2 else 2) + [1] * (5 if rung == 2 else 6)  # 3 of 8 fail, then 2 of 8: a quarter is allowed

    got = L.stable_or_below(L.descend(rungs), rungs, resamples)
    assert (got.result, got.rung, got.triggers, asked) == (3, 3, ["T1", "T4"], [2, 3])
    got = L.stable_or_below(L.descend(rungs[2:]), rungs[2:], lambda _: [None])
    assert (got.result, got.triggers) == (4, ["T4"])
