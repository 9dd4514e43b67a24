"""Matched likelihood, validation over resamples, ladders of counts and the bucketed layout, each against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import disclosure, estimators, matched
from panelwise.plans.chain import Chain

DIR = "/root/testdata/sf0.001"


def matched_rows(rng, n_sets=150, people=120):
    rows = []
    for s in range(n_sets):
        size = int(rng.integers(2, 6))
        x = rng.normal(size=(size, 2)) + rng.normal() * 3
        p = np.exp(x @ [0.8, -0.5])
        case = rng.choice(size, p=p / p.sum())
        rows += [(s, bool(k == case), int(rng.integers(people)), float(x[k, 0]), float(x[k, 1])) for k in range(size)]
    return rows + [(900, True, 1, 1.0, 0.0), (901, False, 2, 0.0, 0.0), (901, False, 3, 1.0, 2.0)]


def brute_fit(rows, weights=None):
    sets = {}
    for i, (s, y, who, *x) in enumerate(rows):
        sets.setdefault(s, []).append((float(y), np.array(x), who, 1.0 if weights is None else weights.get(who, 0.0)))
    beta = np.zeros(2)
    for _ in range(60):
        g, h, scores, by_set = np.zeros(2), np.zeros((2, 2)), {}, []
        for members in sets.values():
            y, x, who, m = (np.array([r[k] for r in members]) for k in range(4))
            if weights is None and not 0 < y.sum() < len(y):
                continue
            n = (m * y).sum()
            if n == 0:
                continue
            e = m * np.exp(x @ beta - (x @ beta).max())
            p = e / e.sum()
            left = m * y - n * p
            g += left @ x
            h += n * ((x * p[:, None]).T @ x - np.outer(p @ x, p @ x))
            by_set.append(left @ x)
            for k, w in enumerate(who):
                scores[w] = scores.get(w, 0) + left[k] * x[k]
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    bread = np.linalg.inv(h)
    meat = lambda u: sum(np.outer(v, v) for v in u)
    return beta, bread, bread @ meat(by_set) @ bread, bread @ meat(scores.values()) @ bread


def test_conditional_fit_and_clustered_errors(spark):
    rows = matched_rows(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "set_id int, is_case boolean, person int, a double, b double")
    fit = matched.fit_conditional_logit(df, ["a", "b"], "person")
    beta, bread, by_set, by_person = brute_fit(rows)
    for got, want in ((fit["beta"], beta), (fit["cov"], bread), (fit["robust"], by_set), (fit["clustered"], by_person)):
        assert np.allclose(got, want, atol=1e-6)
    assert not np.allclose(by_set, by_person, rtol=0.01)


def test_resamples_of_persons_keep_their_sets(spark):
    rows = matched_rows(np.random.default_rng(5), 60, 40)
    df = spark.createDataFrame(rows, "set_id int, is_case boolean, person int, a double, b double")
    d = matched.matched_design(df, ["a", "b"], "person")
    drawn = estimators.replicates(df, "person", 6).collect()
    many = d.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("m", estimators.multiplicity(F.col("b"), F.col("person")).cast("double")).where("m > 0")
    fits = matched.fit_matched_each(many, 2, "b", range(1, 7))
    informative = [r for r in rows if r[0] < 900]
    for b in range(1, 7):
        want = brute_fit(informative, {r["person"]: float(r["multiplicity"]) for r in drawn if r["b"] == b})[0]
        assert np.allclose(fits[b]["beta"], want, atol=1e-5)
    (_, low, high, failed, above), = matched.bootstrap_contrasts(d, 2, {"a": np.array([1.0, 0.0])}, 30)
    assert low < brute_fit(informative)[0][0] < high and failed == 0 and above == 0


def test_separated_sets_are_refused(spark):
    rows = [(s, k == 0, s * 3 + k, float(k == 0)) for s in range(30) for k in range(3)]
    df = spark.createDataFrame(rows, "set_id int, is_case boolean, person int, a double")
    with pytest.raises(ValueError):
        matched.fit_conditional_logit(df, ["a"], "person")
    with pytest.raises(ValueError, match="not estimable"):
        matched.fit_conditional_logit(df.where("is_case"), ["a"])


def area(score, y, w):
    order = sorted(set(score))
    pos, neg = (np.array([sum(w[i] * (y[i] if k else 1 - y[i]) for i in range(len(y)) if score[i] == s) for s in order]) for k in (1, 0))
    return (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())


def test_optimism_against_single_fits(spark):
    rng = np.random.default_rng(6)
    n = 240
    x = np.c_[rng.integers(0, 3, n), rng.integers(0, 4, n)].astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.7, -0.4])))).astype(float)
    unit = rng.integers(0, 60, n)
    df = spark.createDataFrame([(int(u), 1.0, *map(float, a), float(b)) for u, a, b in zip(unit, x, y, strict=True)], "u int, one double, p double, q double, y double")
    got = estimators.optimism_corrected(df, "u", ("one", "p", "q"), "y", 5).first()
    full = np.c_[np.ones(n), x]

    def fit(w):
        beta = np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-full @ beta))
            beta = beta + np.linalg.solve(full.T @ (full * (w * mu * (1 - mu))[:, None]), full.T @ (w * (y - mu)))
        return np.round(full @ beta, 9)

    times = {(r["b"], r["u"]): r["multiplicity"] for r in estimators.replicates(df, "u", 5).collect()}
    ones, on, back = np.ones(n), [], []
    for b in range(1, 6):
        w = np.array([times.get((b, int(u)), 0) for u in unit], float)
        s = fit(w)
        on.append(area(s, y, w))
        back.append(area(s, y, ones))
    apparent = area(fit(ones), y, ones)
    want = (apparent, np.mean(on), np.mean(back), np.mean(on) - np.mean(back), apparent - np.mean(on) + np.mean(back), 5, 0.0)
    assert np.allclose(list(map(float, got)), want, atol=1e-6)
    one_class = estimators.optimism_corrected(df.withColumn("y", F.when(F.col("u") == 1, F.col("y")).otherwise(0.0)), "u", ("one",), "y", 3).first()
    assert one_class["failed"] >= 0


def test_marginal_mean_against_an_integral(spark):
    rng = np.random.default_rng(10)
    b = rng.normal(size=400) * 0.9
    eta = rng.choice([-1.0, 0.2, 1.5], (400, 8))
    y = (rng.random((400, 8)) < 1 / (1 + np.exp(-(eta + b[:, None])))).astype(float)
    rows = [(u, float(eta[u, k]), float(y[u, k])) for u in range(400) for k in range(8)]
    d = spark.createDataFrame(rows, "u int, eta double, y double")
    got = estimators.marginal_mean_drawn(d, "u", "eta", "y").first()
    z, w = np.polynomial.hermite_e.hermegauss(60)
    want = sum((w * 1 / (1 + np.exp(-(e + got["sd"] * z)))).sum() / w.sum() for e in eta.ravel()) / 400
    assert abs(got["mean_total"] - want) < 0.1 and got["n_draws"] == 2000 and 0.4 < got["sd"] < 1.2
    more = estimators.marginal_mean_drawn(d, "u", "eta", "y", draws=(20, 40, 500), tolerance=0.0).first()
    assert more["n_draws"] == 500 and abs(more["mean_total"] - want) < 0.3
    assert estimators.marginal_mean_drawn(d.where("false"), "u", "eta", "y", draws=(2, 4, 8)).first()["mean_total"] is None


def test_tipping_points(spark):
    def told(*rows):
        return tuple(estimators.tipping_points(spark.createDataFrame([(float(s), c, lo, hi) for s, (c, lo, hi) in enumerate(rows)], "shift double, contrast double, low double, high double")).first())

    assert told((2.0, 1.0, 3.0), (1.0, -0.1, 2.0), (0.0, -1.0, 1.0), (-1.0, -2.0, -0.5)) == (2.0, False, True, 1.0, False)
    assert told((-1.0, -2.0, 0.5), (1.0, 0.5, 2.0)) == (None, True, False, 0.0, True)
    assert told((2.0, 1.0, 3.0), (1.5, None, None)) == (None, False, True, None, False)


def follows(values, hidden, equations):
    """Cells among the hidden whose value the equations and the shown cells fix."""
    unknown = sorted(hidden)
    if not unknown:
        return set()
    a = np.array([[e.get(u, 0) for u in unknown] for e in equations], float)
    rank = np.linalg.matrix_rank(a)
    return {u for k, u in enumerate(unknown) if np.linalg.matrix_rank(np.vstack([a, np.eye(len(unknown))[k]])) == rank}


def test_no_hidden_count_of_a_ladder_follows(spark):
    rng = np.random.default_rng(8)
    ladders, steps = {}, 4
    for k, drops in enumerate(itertools.chain([(5, 0, 0, 0), (0, 0, 0, 7), (30, 5, 40, 0), (0, 3, 3, 0)], rng.choice([0, 0, 3, 12, 25, 60], (40, steps)).tolist())):
        n = int(sum(drops) + rng.choice([0, 4, 30, 200]))
        rungs = []
        for s, d in enumerate(drops, 3):
            rungs.append((f"l{k}", s, n, int(d), n - int(d)))
            n -= int(d)
        ladders[f"l{k}"] = rungs
    df = spark.createDataFrame([r for rungs in ladders.values() for r in rungs], "ladder string, step int, n_in long, n_dropped long, n_out long")
    found = disclosure.suppressed_equations(*disclosure.ladder_cells(df, ["ladder"]), ["ladder"]).collect()
    for name, rungs in ladders.items():
        hidden = {r["cell"] for r in found if r["ladder"] == name and r["hidden"]}
        values = {r["cell"]: r["n"] for r in found if r["ladder"] == name}
        assert len(values) == 3 * steps and all(c in hidden for c, n in values.items() if 1 <= n <= 20)
        cell = lambda s, f: f"{s:04d}/{f}"
        equations = [{cell(s, "in"): 1, cell(s, "dropped"): -1, cell(s, "out"): -1} for _, s, *_ in rungs]
        equations += [{cell(s, "out"): 1, cell(s + 1, "in"): -1} for _, s, *_ in rungs[:-1]]
        own = {c for c, n in values.items() if 1 <= n <= 20}
        assert not follows(values, hidden, equations) or hidden == set(values), (name, rungs, hidden)
        assert own or not hidden, (name, hidden)


def test_stored_tables_are_read_without_an_exchange(spark):
    c = Chain(spark, DIR)
    grid, features = c.grid, c.features
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        days = features.select("episode_id", "person_id", "discharge_date").withColumn("post_day", F.explode(F.sequence(F.lit(1), F.lit(15)))).withColumn("activity_date", F.date_add("discharge_date", "post_day"))
        plan = days.join(grid.select("person_id", "activity_date", "steps"), ["person_id", "activity_date"], "left")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        by_person = grid.groupBy("person_id").agg(F.sum("steps"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in by_person
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
