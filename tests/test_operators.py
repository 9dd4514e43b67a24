from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import aggregates, daily, disclosure, episodes, estimators, groups, joins, ledgers, matched
from panelwise.params import SCALED, CohortParams
from panelwise.sources import io

D0 = date(2024, 1, 10)


def day(k):
    return D0 + timedelta(days=k)


def test_params_refuse():
    for bad in ({"baseline": (-3, 2)}, {"rule": "x"}, {"junction_map": "x"}, {"panel_days": 5}, {"minute_column": "a b"}):
        with pytest.raises(ValueError):
            CohortParams(**bad).validated()


def test_window_join_boundaries(spark):
    a = spark.createDataFrame([(1, D0)], "person_id long, d date")
    f = spark.createDataFrame([(1, day(k)) for k in (-6, -5, 2, 3)] + [(1, None), (2, D0)], "person_id long, f date")
    assert sorted(r["rel_day"] for r in joins.window_join(a, f, "person_id", "d", "f", -5, 2).collect()) == [-5, 2]
    assert sorted(r["rel_day"] for r in joins.by_bucket(a, f, "person_id", "d", "f", -5, 2).collect()) == [-5, 2]


def test_grid_and_panel_keep_nulls_apart_from_zeros(spark):
    spans = spark.createDataFrame([(1, day(0), day(3)), (9, day(0), day(1))], "person_id long, lo date, hi date")
    activity = spark.createDataFrame([(1, day(0), 0), (1, day(1), 50)], "person_id long, date date, steps long")
    minutes = spark.createDataFrame([(1, day(0), 700), (1, day(2), 700)], "person_id long, date date, wear_minutes long")
    g = {r["activity_date"]: r for r in daily.person_day_grid(spans, activity, minutes).collect()}
    assert len(g) == 4  # person 9 has no data at all
    assert g[day(0)]["is_analyzable"] and not g[day(1)]["valid_wear"] and g[day(2)]["valid_wear"] and not g[day(2)]["is_analyzable"] and g[day(3)]["steps"] is None
    f = spark.createDataFrame([("e", 1, day(-1), 0, 100.0, 3)], "episode_id string, person_id long, discharge_date date, los_days int, baseline_steps double, at_risk_last_day int")
    stays = spark.createDataFrame([], "person_id long, visit_start_date date, visit_end_date date")
    grid = daily.person_day_grid(spans, activity, minutes)
    p = {r["post_day"]: r for r in daily.day_panel(f, grid, stays, SCALED).collect()}
    assert p[1]["deficit"] == 1.0 and p[2]["deficit"] is None and p[4]["day_kind"] == "censored"
    assert p[1]["lagged_wear_fraction"] is None and p[2]["lagged_wear_fraction"] == 1.0


def test_daily_minutes_refuses_too_many_long_days(spark):
    z = spark.createDataFrame([(1, D0, "a", 1000), (1, D0, "b", 800)], "person_id long, date date, zone string, minute_in_zone long")
    spans = spark.createDataFrame([(1, D0, D0)], "person_id long, lo date, hi date")
    with pytest.raises(ValueError):
        daily.daily_minutes(z, spans)
    assert daily.daily_category(None, spans).count() == 0


def test_ladder_closes_and_a_broken_one_is_found(spark):
    e = spark.createDataFrame([(3,), (3,), (12,), (None,)], "first_fail_step int")
    ladder = ledgers.attrition(e)
    assert ladder.agg(F.sum("n_dropped")).first()[0] == 3 and ladder.orderBy(F.desc("step")).first()["n_out"] == 1
    assert ledgers.ladder_problems(ladder).count() == 0
    bad = ladder.withColumn("n_out", F.when(F.col("step") == 5, F.col("n_out") + 1).otherwise(F.col("n_out")))
    assert {r["problem"] for r in ledgers.ladder_problems(bad).collect()} == {"closes", "carries", "falls"}


def test_complementary_suppression(spark):
    t = spark.createDataFrame([("a", "x", 5), ("a", "y", 100), ("a", "z", 100), ("b", "x", 40), ("b", "y", 0), ("c", "x", 3), ("c", "y", 4)], "r string, k string, n long")
    got = {(r["r"], r["k"]): r["hidden"] for r in disclosure.complementary(t, ["r"], "n", ["k"]).collect()}
    assert got == {("a", "x"): True, ("a", "y"): True, ("a", "z"): False, ("b", "x"): False, ("b", "y"): False, ("c", "x"): True, ("c", "y"): True}
    grid = disclosure.complementary_grid(t, "r", "k", "n").groupBy("r").agg(F.count_if("hidden").alias("h"), F.count_if(~F.col("hidden") & (F.col("n") > 0)).alias("s"))
    assert grid.where("h = 1 AND s > 0").count() == 0


def test_gated_export(spark, tmp_path):
    t = spark.createDataFrame([("a", 40, 12.5), ("b", None, 3.0)], "k string, n long, m double")
    io.gated_export(t, str(tmp_path / "ok"), counts=["n"], texts=["k"])
    text = next((tmp_path / "ok").glob("part-*")).read_text()
    assert text == "k,n,m\na,40,12.5000\nb,,3\n" or "b," in text
    with pytest.raises(ValueError, match="illegal_count"):
        io.gated_export(t.withColumn("n", F.lit(7)), str(tmp_path / "no"), counts=["n"])


def test_build_tables_restart(spark, tmp_path):
    made = []

    def stage(name, n):
        def make(done):
            made.append(name)
            return spark.range(n + sum(t.count() for t in done.values()))
        return make

    stages = {"a": stage("a", 1), "b": stage("b", 2)}
    io.build_tables(spark, stages, str(tmp_path))
    assert io.build_tables(spark, stages, str(tmp_path), "b")["b"].count() == 3 and made == ["a", "b", "b"]
    with pytest.raises(ValueError):
        io.build_tables(spark, stages, str(tmp_path), "z")


def test_resolve_roles_refuses_ambiguity(spark):
    df = spark.createDataFrame([(1, 2)], "user_id long, User_ID2 long")
    assert io.resolve_roles(df, {"p": ("person_id", "user_id")}).columns == ["p"]
    for rules in ({"p": ("user.*",)}, {"p": ("none",)}):
        with pytest.raises(ValueError):
            io.resolve_roles(df, rules)


def test_surrogates_are_dense_ranks(spark):
    df = spark.createDataFrame([(k,) for k in "dbacbd"], "k string")
    got = {r["k"]: r["i"] for r in groups.with_surrogate(df, "k", "i").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_hierarchical_score_and_missing(spark):
    h = spark.createDataFrame([("p", "mild"), ("p", "severe"), ("p", "severe"), ("q", "mild"), ("q", None)], "k string, c string")
    got = {r["k"]: r["score"] for r in aggregates.hierarchical_score(h, "k", "c", {"mild": 1, "severe": 3}, {"severe": "mild"}).collect()}
    assert got == {"p": 3, "q": 1}


def test_logit_recovers_coefficients_and_refuses_separation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(-0.5 + 1.2 * x)))).astype(float)
    df = spark.createDataFrame([(1.0, float(a), float(b), int(i % 200)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "one double, x double, y double, c int")
    fit = estimators.fit_logit(df, ["one", "x"], "y", cluster="c")
    assert np.abs(fit["beta"] - [-0.5, 1.2]).max() < 0.15
    assert np.abs(np.sqrt(np.diag(fit["robust"])) / np.sqrt(np.diag(fit["cov"])) - 1).max() < 0.3
    with pytest.raises(ValueError):
        estimators.fit_logit(df.withColumn("y", (F.col("x") > 0).cast("double")), ["one", "x"], "y")


def test_conditional_logit_recovers_a_coefficient(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(400):
        x = rng.normal(size=4)
        p = np.exp(0.9 * x)
        case = rng.choice(4, p=p / p.sum())
        rows += [(s, bool(i == case), float(v)) for i, v in enumerate(x)]
    rows += [(1000, True, 1.0), (1001, False, 0.0), (1001, False, 1.0)]  # sets that say nothing
    fit = matched.fit_conditional_logit(spark.createDataFrame(rows, "set_id int, is_case boolean, x double"), ["x"])
    assert abs(fit["beta"][0] - 0.9) < 3 * np.sqrt(fit["cov"][0, 0]) and fit["cov"][0, 0] < 0.02


def test_bootstrap_reruns_agree(spark):
    df = spark.createDataFrame([(i, "g", float(i % 5)) for i in range(60)], "u int, g string, v double")
    a, b = (estimators.bootstrap_mean(df.repartition(n), "u", "g", "v", 50).collect() for n in (2, 7))
    assert a == b and a[0]["low"] < a[0]["mean"] < a[0]["high"]


def test_neighbours_and_ladder_names(spark):
    r = spark.createDataFrame([(1, "a", day(0), day(1)), (1, "b", day(3), None), (2, "c", day(0), day(0))], "person_id long, k string, d date, e date")
    got = {x["k"]: (x["has_prior"], x["next_date"]) for x in joins.neighbours(r, "person_id", "k", "d", "e", 3).collect()}
    assert got == {"a": (False, day(3)), "b": (True, None), "c": (False, None)}
    assert len(episodes.LADDER) == 13
