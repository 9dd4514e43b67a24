"""Estimators over the panel (E)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import estimators as E
from panelwise.operators import matched as M
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.fits import conditional_sql, covariance_sql, matched_sql, multiplicity_sql, newton_sql, resampled_sql
from panelwise.plans.registry import query


def _lost(base: str, steps: str = "steps") -> str:
    return f"CASE WHEN {base} > 0 THEN greatest(0.0, 1 - {steps} / {base}) END"


#: Re-definitions of the deficit, as expressions over a panel day with its flags and baselines.
VARIANTS = {
    "primary": "CASE WHEN in_accrual_window THEN deficit END",
    "after_operation": f"CASE WHEN postoperative_day BETWEEN {P.accrual[0] + 2} AND {P.accrual[1] + 2} THEN deficit END",
    "inpatient_censored": "CASE WHEN in_accrual_window AND NOT is_inpatient THEN deficit END",
    **{f"wear_{r}": f"CASE WHEN in_accrual_window AND NOT is_censored AND valid_wear_{r} THEN {_lost('baseline_steps')} END" for r in ("s1", "s2", "s3", "s4")},
    "baseline_early": f"CASE WHEN in_accrual_window AND is_analyzable THEN {_lost('baseline_steps_early')} END",
    "baseline_late": f"CASE WHEN in_accrual_window AND is_analyzable THEN {_lost('baseline_steps_late')} END",
    "baseline_by_week_part": f"CASE WHEN in_accrual_window AND is_analyzable THEN CASE WHEN dayofweek(calendar_date) IN (WEEKEND) THEN {_lost('baseline_steps_weekend')} ELSE {_lost('baseline_steps_weekday')} END END",
    "baseline_floor": f"CASE WHEN in_accrual_window AND baseline_steps >= {P.baseline_floor} THEN deficit END",
    "not_truncated": "CASE WHEN in_accrual_window THEN deficit_untruncated END",
    "truncated_at_most": "CASE WHEN in_accrual_window THEN CASE WHEN is_censored AND censor_reason IN ('death', 'repeat_operation') THEN 1.0 ELSE deficit END END",
    "weekdays": "CASE WHEN in_accrual_window AND dayofweek(calendar_date) NOT IN (WEEKEND) THEN deficit END",
}


def _days(c: Chain) -> DataFrame:
    return c.panel.where("in_accrual_window AND NOT is_censored").withColumn("w", F.col("wear_minutes") / 1440.0)


_DAYS = "(SELECT *, wear_minutes / 1440.0 AS w FROM panel WHERE in_accrual_window AND NOT is_censored)"
#: Terms of the two small models that have SQL twins: whether a day is observed, and its deficit.
_SEEN, _LOST = ("one", "day", "weekend"), ("one", "day", "fusion")


def _terms(c: Chain) -> DataFrame:
    return c.kept("days", lambda: _make_terms(c))


def _make_terms(c: Chain) -> DataFrame:
    d = _days(c).join(c.features.select("person_id", "episode_id", "is_fusion"), ["person_id", "episode_id"])
    return d.withColumns({"one": F.lit(1.0), "day": (F.col("post_day") - 5) / 5.0, "weekend": F.col("day_of_week").isin(1, 7).cast("double"), "fusion": F.col("is_fusion").cast("double"), "y": F.col("is_analyzable").cast("double")})


def _observed(c: Chain) -> DataFrame:
    """Days with the probability of being observed, from the fitted observation model, and their weight."""
    d = _terms(c)
    return c.kept("weighted", lambda: E.inverse_weights(E.with_fitted(d, _SEEN, E.fit_logit(d, _SEEN, "y")["beta"], "observed"), "is_analyzable", "observed", "region"))


def _modelled(c: Chain) -> tuple[DataFrame, np.ndarray]:
    """Weighted days and the coefficients of the deficit model."""
    d = _observed(c)
    return d, E.fit_logit(d.where("deficit IS NOT NULL"), _LOST, "deficit", weight="weight")["beta"]


def _predicted(c: Chain) -> DataFrame:
    def make() -> DataFrame:
        d, beta = _modelled(c)
        return E.with_fitted(d, _LOST, beta, "pred")

    return c.kept("fitted", make)


@query("e01_design_columns", sql("SELECT min(age) <> max(age) AS age_varies, min(x) <> max(x) AS constant_varies, round(avg(CAST(sex = 'F' AS INTEGER)), 6) AS share_f, round(avg(ln(1 + los_days)), 6) AS mean_log_los FROM (SELECT *, 1 AS x FROM features)", "features"))
def e01(c: Chain) -> DataFrame:
    d = c.features.withColumn("x", F.lit(1))
    return d.agg((F.min("age") != F.max("age")).alias("age_varies"), (F.min("x") != F.max("x")).alias("constant_varies"), F.round(F.avg((F.col("sex") == "F").cast("int")), 6).alias("share_f"), F.round(F.avg(F.log1p("los_days")), 6).alias("mean_log_los"))


@query("e03_inverse_weights", sql("SELECT episode_id, post_day, round(weight, 6) AS weight FROM weighted", "weighted"))
def e03(c: Chain) -> DataFrame:
    return rounded(_observed(c), "weight").select("episode_id", "post_day", "weight")


@query("e03c_weight_summary", sql("SELECT count(weight) AS n, round(avg(weight), 6) AS mean, round(min(weight), 6) AS least, round(max(weight), 6) AS most, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS effective_n FROM weighted", "weighted"))
def e03c(c: Chain) -> DataFrame:
    return rounded(E.weight_summary(_observed(c), "weight"), "mean", "least", "most", "effective_n")


_LOGIT = covariance_sql("days", ["1", "day", "weekend"], "y", "observed_fit", "episode_id")


@query("e04_logit_fit", sql(f"SELECT unnest(['one', 'day', 'weekend']) AS term, round(unnest([b0, b1, b2]), 6) AS beta, round(unnest([sqrt(r00), sqrt(r11), sqrt(r22)]), 6) AS robust_se FROM ({_LOGIT})", "observed_fit"))
def e04(c: Chain) -> DataFrame:
    """Coefficients and robust standard errors of whether a day is observed."""
    fit = E.fit_logit(_terms(c), _SEEN, "y", cluster="episode_id")
    se = np.sqrt(np.diag(fit["robust"]))
    return c.spark.createDataFrame([(n, float(round(b, 6)), float(round(s, 6))) for n, b, s in zip(_SEEN, fit["beta"], se, strict=True)], "term string, beta double, robust_se double")


@query("e22_contrast", sql(f"SELECT kind, round(est, 6) AS estimate, round(est - 1.959963984540054 * sqrt(v), 6) AS low, round(est + 1.959963984540054 * sqrt(v), 6) AS high FROM (SELECT b1 + b2 AS est, unnest(['naive', 'robust']) AS kind, unnest([v11 + v22 + 2 * v12, r11 + r22 + 2 * r12]) AS v FROM ({_LOGIT}))", "observed_fit"))
def e22(c: Chain) -> DataFrame:
    """Day and weekend together, with the naive and the robust interval."""
    fit = E.fit_logit(_terms(c), _SEEN, "y", cluster="episode_id")
    found = [(k, E.contrast(fit["beta"], fit[m], np.array([0.0, 1.0, 1.0]))) for k, m in (("naive", "cov"), ("robust", "robust"))]
    return c.spark.createDataFrame([(k, *(float(round(x[n], 6)) for n in ("estimate", "low", "high"))) for k, x in found], "kind string, estimate double, low double, high double")


@query("e05_fractional_logit", sql("SELECT unnest(['one', 'day']) AS term, round(unnest([b0, b1]), 6) AS beta FROM (" + newton_sql("days WHERE deficit IS NOT NULL", ["1", "day"], "deficit") + ")", "days"))
def e05(c: Chain) -> DataFrame:
    d = _days(c).where("deficit IS NOT NULL").select("episode_id", "deficit", F.lit(1.0).alias("one"), ((F.col("post_day") - 5) / 5.0).alias("day"))
    fit = E.fit_logit(d, ["one", "day"], "deficit", cluster="episode_id")
    return c.spark.createDataFrame([(n, float(round(b, 6))) for n, b in zip(("one", "day"), fit["beta"], strict=True)], "term string, beta double")


@query("e06_cell_means", sql(f"SELECT region, post_day, round(coalesce(cell, by_day, total), 6) AS mean, CASE WHEN cell IS NOT NULL THEN 'cell' WHEN by_day IS NOT NULL THEN 'day' ELSE 'overall' END AS level FROM (SELECT region, post_day, sum(CASE WHEN w > 0 THEN deficit * w END) / sum(CASE WHEN w > 0 AND deficit IS NOT NULL THEN w END) AS cell FROM {_DAYS} GROUP BY ALL) JOIN (SELECT post_day, sum(CASE WHEN w > 0 THEN deficit * w END) / sum(CASE WHEN w > 0 AND deficit IS NOT NULL THEN w END) AS by_day FROM {_DAYS} GROUP BY ALL) USING (post_day) CROSS JOIN (SELECT sum(CASE WHEN w > 0 THEN deficit * w END) / sum(CASE WHEN w > 0 AND deficit IS NOT NULL THEN w END) AS total FROM {_DAYS})", "panel"))
def e06(c: Chain) -> DataFrame:
    return rounded(E.cell_means(_days(c), "region", "post_day", "deficit", "w"), "mean")


_TENTHS = """(SELECT m.set_id, m.role = 'case' AS is_case, 10 * least(3, median(g.steps) / any_value(f.baseline_steps)) AS tenths
 FROM sets m JOIN features f USING (episode_id) JOIN grid g ON g.person_id = m.person_id AND g.activity_date - f.discharge_date - m.day BETWEEN {lo} AND {hi} AND g.activity_date > f.discharge_date AND g.valid_wear AND g.steps IS NOT NULL
 GROUP BY m.set_id, m.episode_id, m.role, m.day)"""


@query("e07_conditional_logit", sql("SELECT 'tenths' AS term, round(b, 6) AS beta, round(1 / sqrt(h), 6) AS se FROM (" + conditional_sql(_TENTHS.format(lo=P.landmark[0], hi=P.landmark[1]), "tenths", 1.0) + ")", "sets", "grid"))
def e07(c: Chain) -> DataFrame:
    from panelwise.operators.events import member_exposure

    m = member_exposure(c.sets, c.features, c.grid, P.landmark, 1).where("ratio IS NOT NULL")
    d = m.select("set_id", (F.col("role") == "case").alias("is_case"), (10 * F.least("ratio", F.lit(3.0))).alias("tenths"))
    fit = M.fit_conditional_logit(d, ["tenths"], ridge=1.0)
    return c.spark.createDataFrame([("tenths", float(round(fit["beta"][0], 6)), float(round(np.sqrt(fit["cov"][0, 0]), 6)))], "term string, beta double, se double")


@query("e08_g_computation", sql("SELECT level, round(mean_total, 6) AS mean_total, round(mean_total - first(mean_total) OVER (ORDER BY level), 6) AS contrast FROM (SELECT level, avg(total) AS mean_total FROM (SELECT level, episode_id, sum(1 / (1 + exp(-(b0 + b1 * day + b2 * level)))) AS total FROM (SELECT episode_id, day, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS level FROM weighted), deficit_fit GROUP BY ALL) GROUP BY level)", "deficit_fit"))
def e08(c: Chain) -> DataFrame:
    """Mean unit totals had every row each level of exposure, and their difference from the first level."""
    d, beta = _modelled(c)
    out = E.under_exposure(d, "episode_id", _LOST, beta, "fusion", (0, 1))
    first = out.agg(F.min_by("mean_total", "level").alias("_first"))
    return rounded(out.join(F.broadcast(first)).withColumn("contrast", F.col("mean_total") - F.col("_first")), "mean_total", "contrast").drop("_first")


@query("e09_marginal_mean", sql("SELECT episode_id, round(avg(m), 6) AS marginal FROM (SELECT episode_id, (1 / (1 + exp(-(e - 0.5))) + 1 / (1 + exp(-e)) + 1 / (1 + exp(-(e + 0.5)))) / 3 AS m FROM (SELECT episode_id, (post_day - 5) / 5.0 AS e FROM " + _DAYS + ")) GROUP BY episode_id", "panel"))
def e09(c: Chain) -> DataFrame:
    d = _days(c).withColumn("e", (F.col("post_day") - 5) / 5.0)
    return E.marginal_mean(d, "e", 0.5, (-1.0, 0.0, 1.0)).groupBy("episode_id").agg(F.round(F.avg("marginal"), 6).alias("marginal"))


_Z32 = "(CAST(concat('0x', md5(concat_ws('|', k, 1))[{}:{}]) AS BIGINT) + 0.5) / 4294967296"
_MC = "SELECT k, sqrt(-2 * ln({})) * cos(2 * pi() * {}) AS z FROM range(1, 10001) r(k)".format(_Z32.format(1, 8), _Z32.format(9, 16))


@query("e09b_drawn_mean", sql(f"""WITH d AS MATERIALIZED (SELECT episode_id, deficit, ln(pred / (1 - pred)) AS eta FROM fitted), z AS MATERIALIZED ({_MC}),
u AS (SELECT episode_id, sum(r) AS r, sum(r * r) AS rr, sum(s) AS s, sum(s * s) AS ss FROM (SELECT episode_id, deficit - 1 / (1 + exp(-eta)) AS r, 1 / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))) AS s FROM d WHERE deficit IS NOT NULL) GROUP BY episode_id),
v AS (SELECT sqrt(greatest(0, coalesce(sum(r * r - rr) / nullif(sum(s * s - ss), 0), 0))) AS sd FROM u),
e AS MATERIALIZED (SELECT round(eta, 9) AS eta, count(*) AS n FROM d GROUP BY 1),
m AS (SELECT sd, sum(n * p2) / units AS t2, sum(n * p4) / units AS t4, sum(n * p10) / units AS t10 FROM (SELECT eta, n, sd, sum(p) FILTER (WHERE k <= 2000) / 2000 AS p2, sum(p) FILTER (WHERE k <= 4000) / 4000 AS p4, sum(p) / 10000 AS p10 FROM (SELECT e.eta, e.n, v.sd, z.k, 1 / (1 + exp(-(e.eta + v.sd * z.z))) AS p FROM e, v, z) GROUP BY eta, n, sd), (SELECT count(DISTINCT episode_id) AS units FROM d) GROUP BY sd, units)
SELECT round(sd, 5) AS sd, round(CASE WHEN abs(t2 - t4) <= 0.05 THEN t2 ELSE t10 END, 5) AS mean_total, round(t4, 5) AS rechecked, CASE WHEN abs(t2 - t4) <= 0.05 THEN 2000 ELSE 10000 END AS n_draws FROM m""", "fitted"))
def e09b(c: Chain) -> DataFrame:
    """The mean unit total over a random intercept whose variance comes from the data, by shared draws with a recheck."""
    d = _predicted(c).withColumn("eta", F.ln(F.col("pred") / (1 - F.col("pred"))))
    return rounded(E.marginal_mean_drawn(d, "episode_id", "eta", "deficit"), "sd", "mean_total", "rechecked", digits=5)


_DRAWS = 100
_B = f"(SELECT unit, CAST(b AS INTEGER) AS b FROM (SELECT DISTINCT {{}} AS unit FROM {{}}), range(1, {_DRAWS + 1}) t(b))"


@query("e10_cluster_bootstrap", sql(f"WITH u AS (SELECT person_id, region, sum(deficit) AS total FROM days GROUP BY ALL HAVING sum(deficit) IS NOT NULL), r AS (SELECT unit, b, {multiplicity_sql('b', 'unit')} AS k FROM {_B.format('person_id', 'u')}), means AS (SELECT b, region, sum(total * k) / sum(k) AS mean FROM u JOIN r ON unit = person_id WHERE k > 0 GROUP BY ALL) SELECT region, round(any_value(p.mean), 6) AS mean, round(quantile_cont(m.mean, 0.025), 6) AS low, round(quantile_cont(m.mean, 0.975), 6) AS high, count(m.mean) AS n_replicates FROM means m JOIN (SELECT region, avg(total) AS mean FROM u GROUP BY region) p USING (region) GROUP BY region", "days"))
def e10(c: Chain) -> DataFrame:
    return rounded(E.bootstrap_mean(_days(c), "person_id", "region", "deficit", _DRAWS), "mean", "low", "high")


_REFIT = newton_sql("(SELECT r.b, r.k * w.weight AS kw, w.* EXCLUDE (weight) FROM weighted w JOIN reps r ON r.unit = w.person_id WHERE w.deficit IS NOT NULL AND r.k > 0)", ["1", "day", "fusion"], "deficit", "kw", by="b")


@query("e10b_bootstrap_refit", sql(f"WITH reps AS MATERIALIZED (SELECT unit, b, {multiplicity_sql('b', 'unit')} AS k FROM {_B.format('person_id', 'weighted WHERE deficit IS NOT NULL')}), refit AS MATERIALIZED ({_REFIT}), long AS (SELECT unnest(['one', 'day', 'fusion']) AS term, unnest([r.b0, r.b1, r.b2]) AS v, unnest([f.b0, f.b1, f.b2]) AS estimate FROM refit r, deficit_fit f) SELECT term, round(any_value(estimate), 5) AS estimate, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.975), 5) AS high, round(least(1, 2 * least(avg(CAST(v <= 0 AS INTEGER)), avg(CAST(v >= 0 AS INTEGER)))), 6) AS p_value, round(1 - count(*) / {_DRAWS}, 6) AS failed, {_DRAWS} AS n_replicates FROM long GROUP BY term", "deficit_fit"))
def e10b(c: Chain) -> DataFrame:
    """The deficit model fitted again in every resample of whole persons."""
    d = _observed(c).where("deficit IS NOT NULL")
    found = E.bootstrap_fit(d, "person_id", _LOST, "deficit", "weight", _DRAWS)
    rows = [(r[0], *(round(v, 5) for v in r[1:4]), round(r[4], 6), round(r[5], 6), r[6]) for r in found]
    return c.spark.createDataFrame(rows, "term string, estimate double, low double, high double, p_value double, failed double, n_replicates int")


@query("e11_worst_case_bounds", sql(f"SELECT region, count(*) AS n_units, round(avg(s), 6) AS lower, round(avg(s + miss), 6) AS upper FROM (SELECT episode_id, region, coalesce(sum(deficit), 0) AS s, count_if(deficit IS NULL) AS miss FROM {_DAYS} GROUP BY ALL) GROUP BY region", "panel"))
def e11(c: Chain) -> DataFrame:
    return rounded(E.worst_case_bounds(_days(c), "episode_id", "region", "deficit"), "lower", "upper")


@query("e11b_contrast_bounds", sql("WITH r AS (SELECT region, avg(s) AS lo, avg(s + miss) AS hi FROM (SELECT episode_id, region, coalesce(sum(deficit), 0) AS s, count_if(deficit IS NULL) AS miss FROM " + _DAYS + " GROUP BY ALL) GROUP BY region) SELECT x.region AS a, y.region AS b, round(x.lo - y.hi, 6) AS low, round(x.hi - y.lo, 6) AS high, x.lo <= y.hi AND x.hi >= y.lo AS undecided FROM r x JOIN r y ON x.region < y.region", "panel"))
def e11b(c: Chain) -> DataFrame:
    """Worst-case bounds of the difference between each two regions."""
    return rounded(E.contrast_bounds(E.worst_case_bounds(_days(c), "episode_id", "region", "deficit"), "region"), "low", "high")


@query("e28c_implied_deficit", sql("SELECT shift, count(h) AS n_days, round(avg(h), 6) AS implied, round(avg(deficit), 6) AS observed_mean FROM (SELECT shift, deficit, CASE WHEN deficit IS NULL THEN 1 / (1 + exp(-(ln(pred / (1 - pred)) + shift))) END AS h FROM (SELECT deficit, pred, unnest([-1.0, -0.5, 0.0, 0.5, 1.0]::DOUBLE[]) AS shift FROM fitted)) GROUP BY shift", "fitted"))
def e28c(c: Chain) -> DataFrame:
    """The mean deficit that each shift implies for the unobserved days."""
    return rounded(E.implied_deficit(_predicted(c), "pred", "deficit", _SHIFTS), "implied", "observed_mean")


_SHIFTS = (-1.0, -0.5, 0.0, 0.5, 1.0)
_SHIFT_SQL = "SELECT shift, avg(total) AS mean_total FROM (SELECT shift, episode_id, sum(coalesce(deficit, 1 / (1 + exp(-(ln(pred / (1 - pred)) + shift))))) AS total FROM (SELECT episode_id, deficit, pred, unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) AS shift FROM fitted) GROUP BY ALL) GROUP BY shift"


@query("e12_logit_shift", sql(f"SELECT CAST(shift AS DOUBLE) AS shift, round(mean_total, 6) AS mean_total FROM ({_SHIFT_SQL})", "fitted"))
def e12(c: Chain) -> DataFrame:
    return rounded(E.logit_shift(_predicted(c), "episode_id", "pred", "deficit", _SHIFTS), "mean_total")


@query("e12b_crossing", sql(f"SELECT CAST(min(CASE WHEN last < 4 AND mean_total >= 4 THEN shift END) AS DOUBLE) AS first_crossing, bool_and(mean_total >= coalesce(last, mean_total)) AS rising FROM (SELECT *, lag(mean_total) OVER (ORDER BY shift) AS last FROM ({_SHIFT_SQL}))", "fitted"))
def e12b(c: Chain) -> DataFrame:
    return E.crossings(E.logit_shift(_predicted(c), "episode_id", "pred", "deficit", _SHIFTS), "shift", "mean_total", 4.0)


_GRID = tuple(k / 4 for k in range(13))
_MOVED = f"""WITH people AS MATERIALIZED (SELECT person_id, fusion, shift, sum(t) AS t, count(*) AS n FROM (SELECT episode_id, person_id, fusion, shift, sum(coalesce(deficit, 1 / (1 + exp(-(ln(pred / (1 - pred)) - fusion * shift))))) AS t FROM (SELECT episode_id, person_id, fusion, deficit, pred, unnest({list(_GRID)}::DOUBLE[]) AS shift FROM fitted) GROUP BY ALL) GROUP BY ALL),
reps AS MATERIALIZED (SELECT unit, b, {multiplicity_sql('b', 'unit')} AS k FROM {_B.format('person_id', 'people')}),
many AS (SELECT b, shift, sum(k * t) FILTER (WHERE fusion = 1) / nullif(sum(k * n) FILTER (WHERE fusion = 1), 0) - sum(k * t) FILTER (WHERE fusion = 0) / nullif(sum(k * n) FILTER (WHERE fusion = 0), 0) AS c FROM people JOIN reps ON unit = person_id WHERE k > 0 GROUP BY ALL),
curve AS (SELECT shift, any_value(p.c) AS c, quantile_cont(m.c, 0.025) AS low, quantile_cont(m.c, 0.975) AS high FROM (SELECT shift, sum(t) FILTER (WHERE fusion = 1) / sum(n) FILTER (WHERE fusion = 1) - sum(t) FILTER (WHERE fusion = 0) / sum(n) FILTER (WHERE fusion = 0) AS c FROM people GROUP BY shift) p LEFT JOIN many m USING (shift) GROUP BY shift)"""


def _moved(c: Chain) -> DataFrame:
    d = _predicted(c).withColumn("is_fused", F.col("fusion") == 1)
    return E.shifted_contrast(d, "episode_id", "person_id", "is_fused", "pred", "deficit", _GRID, _DRAWS)


@query("e12e_shifted_contrast", sql(_MOVED + " SELECT shift, round(c, 5) AS contrast, round(low, 5) AS low, round(high, 5) AS high FROM curve", "fitted"))
def e12e(c: Chain) -> DataFrame:
    """The contrast of the two groups under shifts of the unobserved days of one, with intervals over whole persons."""
    return rounded(_moved(c), "contrast", "low", "high", digits=5)


@query("e12f_tipping_points", sql(_MOVED + ", steps AS (SELECT *, lag(c) OVER (ORDER BY shift) AS last, row_number() OVER (ORDER BY shift) AS i FROM curve) SELECT CASE WHEN NOT bool_or(i = 1 AND c <= 0) THEN min(CASE WHEN last > 0 AND c <= 0 THEN shift END) END AS crossing, bool_or(i = 1 AND c <= 0) AS already, bool_and(coalesce(c <= last + 1e-9, TRUE)) AS falling, min(CASE WHEN low <= 0 AND high >= 0 THEN shift END) AS interval_crossing, bool_or(i = 1 AND coalesce(low <= 0 AND high >= 0, FALSE)) AS interval_already FROM steps", "fitted"))
def e12f(c: Chain) -> DataFrame:
    """First shift at which the contrast, and at which its interval, reaches 0."""
    return E.tipping_points(_moved(c))


@query("e13_variants", sql("SELECT variant, count(v) AS n, round(avg(v), 6) AS mean FROM (SELECT unnest(['primary', 'untruncated', 'weekdays', 'not_inpatient']) AS variant, unnest([deficit, deficit_untruncated, CASE WHEN dayofweek(calendar_date) NOT IN (0, 6) THEN deficit END, CASE WHEN NOT is_inpatient THEN deficit END]) AS v FROM panel) GROUP BY variant", "panel"))
def e13(c: Chain) -> DataFrame:
    pairs = {"primary": F.col("deficit"), "untruncated": F.col("deficit_untruncated"), "weekdays": F.when(~F.col("day_of_week").isin(1, 7), F.col("deficit")), "not_inpatient": F.when(~F.col("is_inpatient"), F.col("deficit"))}
    d = c.panel.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("v")) for n, v in pairs.items()])).alias("x"))
    return d.groupBy("x.variant").agg(F.count("x.v").alias("n"), F.round(F.avg("x.v"), 6).alias("mean"))


@query("e14_complete_windows", sql(f"SELECT region, count(*) AS n, round(avg(s), 6) AS mean_sum FROM (SELECT episode_id, region, sum(deficit) AS s FROM {_DAYS} GROUP BY ALL HAVING count(deficit) >= 5) GROUP BY region", "panel"))
def e14(c: Chain) -> DataFrame:
    u = _days(c).groupBy("episode_id", "region").agg(F.sum("deficit").alias("s"), F.count("deficit").alias("k")).where("k >= 5")
    return u.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_sum"))


@query("e16_recovery", sql("SELECT region, count(*) AS n, count_if(m >= 0.8) AS n_recovered FROM (SELECT episode_id, region, median(normalized_activity) AS m FROM panel WHERE post_day BETWEEN 8 AND 15 GROUP BY ALL) WHERE m IS NOT NULL GROUP BY region", "panel"))
def e16(c: Chain) -> DataFrame:
    u = c.panel.where("post_day BETWEEN 8 AND 15").groupBy("episode_id", "region").agg(F.median("normalized_activity").alias("m")).where("m IS NOT NULL")
    return u.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") >= 0.8).alias("n_recovered"))


@query("e17_standardised", sql("SELECT valid_wear, round(sum(e) / sum(n), 6) AS crude, round(sum(w * e / n) / sum(w), 6) AS standardised, CAST(sum(n) AS BIGINT) AS n FROM (SELECT post_day // 5 AS s, valid_wear, count(*) AS n, count_if(is_inpatient) AS e FROM panel GROUP BY ALL) JOIN (SELECT post_day // 5 AS s, count(*) AS w FROM panel GROUP BY ALL) USING (s) GROUP BY valid_wear", "panel"))
def e17(c: Chain) -> DataFrame:
    d = c.panel.withColumn("y", F.col("is_inpatient").cast("int"))
    return rounded(E.standardised_rates(d, F.floor(F.col("post_day") / 5), "valid_wear", "y"), "crude", "standardised")


@query("e18_horizon_risk", sql("SELECT round(d, 6) AS daily, round(1 - pow(1 - d, 30), 6) AS risk FROM (SELECT avg(CAST(is_event AS INTEGER)) AS d FROM lm WHERE NOT is_censored)", "lm"))
def e18(c: Chain) -> DataFrame:
    return rounded(E.horizon_risk(c.lm.where("NOT is_censored").withColumn("p", F.col("is_event").cast("int")), "p", 30), "daily", "risk")


_SCORED = "(SELECT episode_id, post_day, round(1 - coalesce(landmark_lag, 0.5), 6) AS score, CAST(is_event AS INTEGER) AS y FROM lm WHERE NOT is_censored)"


def _scored(c: Chain) -> DataFrame:
    return c.lm.where("NOT is_censored").select("episode_id", "post_day", F.round(1 - F.coalesce("landmark_lag", F.lit(0.5)), 6).alias("score"), F.col("is_event").cast("int").alias("y"))


@query("e19_roc_panel", sql(f"SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(h) AS BIGINT) AS n1, round((sum((bef + (n + 1) / 2) * h) - sum(h) * (sum(h) + 1) / 2) / nullif(sum(h) * (sum(n) - sum(h)), 0), 6) AS auc, round(sum(h * th / t) / nullif(sum(h), 0), 6) AS average_precision, round((SELECT avg(pow(score - y, 2)) FROM {_SCORED}), 6) AS brier FROM (SELECT score, n, h, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS t, sum(h) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS th FROM (SELECT score, count(*) AS n, sum(y) AS h FROM {_SCORED} GROUP BY score))", "lm"))
def e19(c: Chain) -> DataFrame:
    return rounded(E.roc_panel(_scored(c), "score", "y", "post_day"), "auc", "average_precision", "brier")


@query("e19b_confusion", sql(f"SELECT threshold, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv FROM (SELECT max(t) AS threshold, count_if(score >= t AND y = 1) AS tp, count_if(score >= t AND y = 0) AS fp, count_if(score < t AND y = 1) AS fn, count_if(score < t AND y = 0) AS tn FROM {_SCORED} CROSS JOIN (SELECT quantile_disc(score, 0.25) AS t FROM {_SCORED} WHERE y = 1))", "lm"))
def e19b(c: Chain) -> DataFrame:
    return rounded(E.confusion_at(_scored(c), "score", "y", 0.75), "sensitivity", "specificity", "ppv")


_FOLDS = 60
_PATTERNS = "SELECT person_id AS unit, day, weekend, count(*) AS n, sum(y) AS hits FROM days GROUP BY ALL"


@query("e19e_optimism_corrected", sql(f"""WITH pat AS MATERIALIZED ({_PATTERNS}),
drawn AS MATERIALIZED (SELECT b, k, p.* FROM (SELECT unit, b, {multiplicity_sql('b', 'unit')} AS k FROM (SELECT DISTINCT unit FROM pat), (SELECT CAST(b AS INTEGER) AS b FROM range(1, {_FOLDS + 1}) t(b))) JOIN pat p USING (unit) WHERE k > 0),
refit AS MATERIALIZED ({newton_sql("(SELECT b, day, weekend, k * n AS kn, hits / n AS share FROM drawn)", ["1", "day", "weekend"], "share", "kn", by="b")}),
scored AS (SELECT 'apparent' AS kind, 0 AS b, round(b0 + b1 * day + b2 * weekend, 9) AS s, n, hits FROM pat, observed_fit
 UNION ALL SELECT 'original', r.b, round(b0 + b1 * day + b2 * weekend, 9), n, hits FROM pat, refit r
 UNION ALL SELECT 'resample', b, round(b0 + b1 * day + b2 * weekend, 9), k * n, k * hits FROM drawn JOIN refit USING (b)),
areas AS (SELECT kind, b, sum(pos * (upto - neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY kind, b ORDER BY s) AS upto FROM (SELECT kind, b, s, sum(hits) AS pos, sum(n - hits) AS neg FROM scored GROUP BY ALL)) GROUP BY kind, b),
pairs AS (SELECT r.auc AS r, o.auc AS o FROM areas r JOIN areas o ON r.b = o.b AND r.kind = 'resample' AND o.kind = 'original' WHERE r.auc IS NOT NULL AND o.auc IS NOT NULL)
SELECT round(a.auc, 6) AS apparent, round(avg(r), 6) AS on_resamples, round(avg(o), 6) AS on_original, round(avg(r) - avg(o), 6) AS optimism, round(a.auc - (avg(r) - avg(o)), 6) AS corrected, {_FOLDS} AS n_replicates, round(1 - count(*) / {_FOLDS}, 6) AS failed FROM pairs, (SELECT auc FROM areas WHERE kind = 'apparent') a GROUP BY a.auc""", "days", "observed_fit"))
def e19e(c: Chain) -> DataFrame:
    """The ROC area of the observation model, corrected for optimism over resamples of whole persons."""
    return rounded(E.optimism_corrected(_terms(c), "person_id", _SEEN, "y", _FOLDS), "apparent", "on_resamples", "on_original", "optimism", "corrected", "failed")


@query("e20_lead_time", sql(f"SELECT e.episode_id, e.event_day, e.event_day - min(CASE WHEN a.post_day BETWEEN e.event_day - 6 AND e.event_day - 1 THEN a.post_day END) AS lead_days FROM ev e LEFT JOIN (SELECT episode_id, post_day FROM lm WHERE no_signal) a USING (episode_id) GROUP BY e.episode_id, e.event_day", "lm"))
def e20(c: Chain) -> DataFrame:
    return E.lead_time(c.ev, c.lm.where("no_signal"))


@query("e21_explained_variation", sql("SELECT round(1 - sum(w * pow(deficit - pred, 2)) / (sum(w * deficit * deficit) - sum(w * deficit) * sum(w * deficit) / sum(w)), 6) AS r2 FROM fitted WHERE deficit IS NOT NULL AND w IS NOT NULL", "fitted"))
def e21(c: Chain) -> DataFrame:
    return rounded(E.explained(_predicted(c).where("deficit IS NOT NULL AND w IS NOT NULL"), "deficit", "pred", "w"), "r2")


@query("e21b_intraclass", sql(f"SELECT round((b - wi) / (b + (m - 1) * wi), 6) AS icc FROM (SELECT (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) AS b, (sum(q) - sum(s * s / n)) / (sum(n) - count(*)) AS wi, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS m FROM (SELECT episode_id, count(deficit) AS n, sum(deficit) AS s, sum(deficit * deficit) AS q FROM {_DAYS} WHERE deficit IS NOT NULL GROUP BY episode_id))", "panel"))
def e21b(c: Chain) -> DataFrame:
    return rounded(E.intraclass(_days(c), "episode_id", "deficit"), "icc")


@query("e24_group_labels", sql("SELECT CASE WHEN is_fusion AND sex = 'F' THEN 'fusion_f' WHEN is_fusion THEN 'fusion_m' WHEN sex = 'F' THEN 'other_f' ELSE 'other_m' END AS four, CASE WHEN is_fusion THEN 'fusion' ELSE 'other' END AS two, count(*) AS n FROM features GROUP BY ALL", "features"))
def e24(c: Chain) -> DataFrame:
    two = F.when(F.col("is_fusion"), "fusion").otherwise("other")
    return c.features.groupBy(F.concat_ws("_", two, F.when(F.col("sex") == "F", "f").otherwise("m")).alias("four"), two.alias("two")).agg(F.count(F.lit(1)).alias("n"))


def _outside(d: DataFrame) -> DataFrame:
    b = E.worst_case_bounds(d, "episode_id", "region", "deficit")
    est = d.groupBy("episode_id", "region").agg(F.sum(F.coalesce("deficit", "pred")).alias("p")).groupBy("region").agg(F.avg("p").alias("est"))
    return b.join(est, "region").where("est < lower OR est > upper").agg(F.count(F.lit(1)).alias("n_outside"))


@query("e28_bounds_bracket", sql("SELECT count(*) AS n_outside FROM (SELECT region, avg(s) AS lo, avg(s + miss) AS hi, avg(p) AS est FROM (SELECT episode_id, region, coalesce(sum(deficit), 0) AS s, count_if(deficit IS NULL) AS miss, sum(coalesce(deficit, pred)) AS p FROM fitted GROUP BY ALL) GROUP BY region) WHERE est < lo OR est > hi", "fitted"))
def e28(c: Chain) -> DataFrame:
    return _outside(_predicted(c))


#: Terms of the two fitted models. The observation model has the deficit model's and what predicts wear.
_DEFICIT_X = ("one", "day", "day_squared", "weekend", "log_los", "fusion")
_OBSERVED_X = (*_DEFICIT_X, "valid_days", "lag", "lag_missing")


def _design(c: Chain) -> DataFrame:
    """All days of the accrual window with the terms of both models; a missing lag is its median."""
    d = _days(c)
    mid = d.agg(F.coalesce(F.median("lagged_wear_fraction"), F.lit(0.0)).alias("_mid"))
    d = d.join(c.features.select("episode_id", "is_fusion"), "episode_id").join(c.baseline.select("episode_id", "n_valid_baseline_days"), "episode_id", "left").join(F.broadcast(mid))
    day = (F.col("post_day") - 5) / 5.0
    return d.withColumns({
        "one": F.lit(1.0), "day": day, "day_squared": day * day, "weekend": F.col("day_of_week").isin(1, 7).cast("double"), "log_los": F.log1p(F.coalesce("los_days", F.lit(0))), "fusion": F.coalesce("is_fusion", F.lit(False)).cast("double"),
        "valid_days": F.coalesce("n_valid_baseline_days", F.lit(0)) / 10.0, "lag": F.coalesce("lagged_wear_fraction", "_mid"), "lag_missing": F.col("lagged_wear_fraction").isNull().cast("double"), "y": F.col("is_analyzable").cast("double"),
    }).drop("_mid")


def _weighted(c: Chain) -> DataFrame:
    """Days with ``observed``, the fitted probability that a day is observed, and the weight from it."""
    def make() -> DataFrame:
        d = c.kept("design", lambda: _design(c))
        return E.inverse_weights(E.with_fitted(d, _OBSERVED_X, E.fit_logit(d, _OBSERVED_X, "y")["beta"], "observed"), "is_analyzable", "observed", "region")

    return c.kept("weighted_full", make)


def _deficit_fit(c: Chain) -> tuple[DataFrame, np.ndarray]:
    """Days and the coefficients of the deficit model, weighted by the observation model."""
    d = _weighted(c)
    return d, E.fit_logit(d.where("deficit IS NOT NULL"), _DEFICIT_X, "deficit", weight="weight")["beta"]


def _fitted(c: Chain) -> DataFrame:
    def make() -> DataFrame:
        d, beta = _deficit_fit(c)
        return E.with_fitted(d, _DEFICIT_X, beta, "pred")

    return c.kept("fitted_full", make)


@query("e03b_fitted_weights")
def e03b(c: Chain) -> DataFrame:
    """Weights from the fitted observation model, where e03 has a given formula."""
    return rounded(_weighted(c), "weight").select("episode_id", "post_day", "weight")


@query("e08b_fitted_g_computation")
def e08b(c: Chain) -> DataFrame:
    d, beta = _deficit_fit(c)
    return rounded(E.under_exposure(d, "episode_id", _DEFICIT_X, beta, "fusion", (0, 1)), "mean_total")


@query("e12c_fitted_shift")
def e12c(c: Chain) -> DataFrame:
    return rounded(E.logit_shift(_fitted(c), "episode_id", "pred", "deficit", _SHIFTS), "mean_total")


@query("e12d_fitted_crossing")
def e12d(c: Chain) -> DataFrame:
    return E.crossings(E.logit_shift(_fitted(c), "episode_id", "pred", "deficit", _SHIFTS), "shift", "mean_total", 4.0)


@query("e21c_fitted_variation")
def e21c(c: Chain) -> DataFrame:
    return rounded(E.explained(_fitted(c).where("deficit IS NOT NULL"), "deficit", "pred", "weight"), "r2")


@query("e28b_fitted_bracket")
def e28b(c: Chain) -> DataFrame:
    return _outside(_fitted(c))


@query("e13b_all_variants", sql("""
WITH v AS (SELECT p.*, f.is_fusion, g.valid_wear_s1, g.valid_wear_s2, g.valid_wear_s3, g.valid_wear_s4, b.baseline_steps_early, b.baseline_steps_late, b.baseline_steps_weekday, b.baseline_steps_weekend, e.censor_reason
 FROM panel p JOIN features f ON f.episode_id = p.episode_id JOIN baseline b ON b.episode_id = p.episode_id JOIN elig e ON e.episode_id = p.episode_id LEFT JOIN grid g ON g.person_id = p.person_id AND g.activity_date = p.calendar_date),
long AS (SELECT unnest([{names}]) AS variant, unnest([{values}]) AS v FROM v)
SELECT variant, count(v) AS n, round(avg(v), 6) AS mean FROM long GROUP BY variant""".format(
    names=", ".join(f"'{n}'" for n in VARIANTS), values=", ".join(f"CAST({e.replace('WEEKEND', '0, 6')} AS DOUBLE)" for e in VARIANTS.values())), "panel", "baseline", "elig"))
def e13b(c: Chain) -> DataFrame:
    """Every re-definition of the deficit at once: window, wear rule, baseline, exclusion, truncation."""
    flags = c.grid.select("person_id", F.col("activity_date").alias("calendar_date"), *[f"valid_wear_{r}" for r in ("s1", "s2", "s3", "s4")])
    base = c.baseline.select("episode_id", *[f"baseline_steps_{n}" for n in ("early", "late", "weekday", "weekend")])
    d = c.panel.join(flags, ["person_id", "calendar_date"], "left").join(base, "episode_id").join(c.elig.select("episode_id", "censor_reason"), "episode_id")
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), F.expr(e.replace("WEEKEND", "1, 7")).cast("double").alias("v")) for n, e in VARIANTS.items()])
    return d.select(F.explode(pairs).alias("x")).groupBy("x.variant").agg(F.count("x.v").alias("n"), F.round(F.avg("x.v"), 6).alias("mean"))


@query("e14b_direct_regression", sql("SELECT round(regr_intercept(s, fusion), 6) AS intercept, round(regr_slope(s, fusion), 6) AS slope, round(sqrt(greatest(0, regr_syy(s, fusion) - regr_slope(s, fusion) * regr_sxy(s, fusion)) / (count(*) - 2)), 6) AS deviation, count(*) AS n FROM (SELECT episode_id, fusion, sum(deficit) AS s FROM days GROUP BY ALL HAVING count(deficit) >= 5)", "days"))
def e14b(c: Chain) -> DataFrame:
    u = _terms(c).groupBy("episode_id", "fusion").agg(F.sum("deficit").alias("s"), F.count("deficit").alias("k")).where("k >= 5")
    return rounded(E.straight_line(u, "fusion", "s"), "intercept", "slope", "deviation")


_U = "(CAST('0x' || substr(md5(concat_ws('|', i, episode_id, post_day, 1)), {}, 8) AS BIGINT) + 0.5) / 4294967296"


@query("e15_imputation", sql(f"WITH line AS (SELECT regr_intercept(deficit, post_day) AS a, regr_slope(deficit, post_day) AS b, sqrt(greatest(0, regr_syy(deficit, post_day) - regr_slope(deficit, post_day) * regr_sxy(deficit, post_day)) / (count(*) - 2)) AS s FROM days WHERE deficit IS NOT NULL), filled AS (SELECT i, episode_id, coalesce(deficit, greatest(0, least(1, a + b * post_day + s * sqrt(-2 * ln({_U.format(1)})) * cos(2 * pi() * {_U.format(9)})))) AS v FROM days, line, range(1, 21) t(i)), each AS (SELECT i, avg(total) AS mean, var_samp(total) / count(*) AS within FROM (SELECT i, episode_id, sum(v) AS total FROM filled GROUP BY ALL) GROUP BY i) SELECT round(avg(mean), 6) AS pooled, round(avg(within), 6) AS within, round(var_samp(mean), 6) AS between, round(avg(within) + 1.05 * var_samp(mean), 6) AS total FROM each", "days"))
def e15(c: Chain) -> DataFrame:
    return rounded(E.imputed_mean(_days(c), "episode_id", "post_day", "deficit"), "pooled", "within", "between", "total")


_RECOVERED = "(SELECT p.episode_id, CAST(median(p.normalized_activity) >= 0.8 AS DOUBLE) AS y, CAST(any_value(f.is_fusion) AS DOUBLE) AS fusion, any_value((f.age - 50) / 10) AS age FROM panel p JOIN features f ON f.episode_id = p.episode_id WHERE p.post_day BETWEEN 8 AND 15 GROUP BY p.episode_id HAVING median(p.normalized_activity) IS NOT NULL)"


@query("e16b_recovery_standardised", sql("SELECT level, round(avg(1 / (1 + exp(-(b0 + b1 * level + b2 * age)))), 6) AS share FROM (SELECT age, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS level FROM " + _RECOVERED + "), (" + newton_sql(_RECOVERED, ["1", "fusion", "age"], "y") + ") GROUP BY level", "panel", "features"))
def e16b(c: Chain) -> DataFrame:
    """Share recovered by a logistic model, standardised over the units for each level of exposure."""
    u = c.panel.where("post_day BETWEEN 8 AND 15").groupBy("episode_id").agg(F.median("normalized_activity").alias("m")).where("m IS NOT NULL").join(c.features.select("episode_id", "is_fusion", "age"), "episode_id")
    u = u.select("episode_id", F.lit(1.0).alias("one"), F.col("is_fusion").cast("double").alias("fusion"), ((F.col("age") - 50) / 10).alias("age"), (F.col("m") >= 0.8).cast("double").alias("y"))
    beta = E.fit_logit(u, ("one", "fusion", "age"), "y")["beta"]
    return rounded(E.under_exposure(u, "episode_id", ("one", "fusion", "age"), beta, "fusion", (0, 1)).withColumnRenamed("mean_total", "share"), "share")


@query("e18b_horizon_interval", sql("SELECT round(d, 6) AS daily, round(se, 6) AS se, round(1 - pow(1 - d, 30), 6) AS risk, round(1 - pow(1 - 1 / (1 + exp(-(ln(d / (1 - d)) - k))), 30), 6) AS low, round(1 - pow(1 - 1 / (1 + exp(-(ln(d / (1 - d)) + k))), 30), 6) AS high FROM (SELECT *, 1.959963984540054 * se / (d * (1 - d)) AS k FROM (SELECT any_value(d) AS d, sqrt(sum(s * s)) / any_value(n) AS se FROM (SELECT episode_id, sum(CAST(is_event AS INTEGER) - d) AS s, any_value(d) AS d, any_value(n) AS n FROM (SELECT *, avg(CAST(is_event AS INTEGER)) OVER () AS d, count(*) OVER () AS n FROM lm WHERE NOT is_censored) GROUP BY episode_id)))", "lm"))
def e18b(c: Chain) -> DataFrame:
    return rounded(E.horizon_interval(c.lm.where("NOT is_censored").withColumn("p", F.col("is_event").cast("int")), "p", "episode_id", 30), "daily", "se", "risk", "low", "high")


_CALIBRATION = f"(SELECT y, ln(s / (1 - s)) AS x FROM (SELECT y, least(greatest(score, 0.000001), 0.999999) AS s FROM {_SCORED}))"


@query("e19c_calibration", sql("SELECT round(b0, 4) AS intercept, round(b1, 4) AS slope FROM (" + newton_sql(_CALIBRATION, ["1", "x"], "y") + ")", "lm"))
def e19c(c: Chain) -> DataFrame:
    """The outcome fitted on the logit of the score: a calibrated score has intercept 0 and slope 1."""
    d = _scored(c).select(F.lit(1.0).alias("one"), E.logit(F.col("score")).alias("x"), F.col("y").cast("double").alias("y"))
    b = E.fit_logit(d, ("one", "x"), "y")["beta"]
    return c.spark.createDataFrame([(float(round(b[0], 4)), float(round(b[1], 4)))], "intercept double, slope double")


@query("e19d_alert_burden", sql(f"SELECT n_days, n_alerts, n_caught, round(100.0 * n_alerts / n_days, 6) AS per_100_days, round(n_alerts / nullif(n_caught, 0), 6) AS per_caught FROM (SELECT count(*) AS n_days, count_if(score >= t) AS n_alerts, count_if(score >= t AND y = 1) AS n_caught FROM {_SCORED} CROSS JOIN (SELECT quantile_disc(score, 0.25) AS t FROM {_SCORED} WHERE y = 1))", "lm"))
def e19d(c: Chain) -> DataFrame:
    d = _scored(c)
    return rounded(E.alert_burden(d, "score", "y", E.confusion_at(d, "score", "y", 0.75)), "per_100_days", "per_caught")


_KNOTS = (30.0, 45.0, 60.0, 75.0)


def _spline_sql(x: str, knots: tuple[float, ...]) -> list[str]:
    cube = lambda t: f"pow(greatest({x} - {t}, 0), 3)"
    last, before, scale = knots[-1], knots[-2], (knots[-1] - knots[0]) ** 2
    return [x] + [f"({cube(t)} - {cube(before)} * {(last - t) / (last - before)} + {cube(last)} * {(before - t) / (last - before)}) / {scale}" for t in knots[:-2]]


_AGE = _spline_sql("age", _KNOTS)
_DESIGN = {"age_s1": _AGE[0], "age_s2": _AGE[1], "age_s3": _AGE[2], "region_lumbar": "CAST(region = 'lumbar' AS DOUBLE)", "region_thoracic": "CAST(region = 'thoracic' AS DOUBLE)", "region_absent": "CAST(region = 'absent' AS DOUBLE)", "log_los_days": "ln(1 + los_days)",
           "year_centred": "year(index_date) - 2024.0", "log_los_days_x_region_lumbar": "ln(1 + los_days) * CAST(region = 'lumbar' AS DOUBLE)"}


@query("e01b_design", sql("SELECT name, round(mean, 6) AS mean FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in _DESIGN) + "]) AS name, unnest([" + ", ".join(f"avg({e})" for e in _DESIGN.values()) + "]) AS mean, unnest([" + ", ".join(f"min({e}) <> max({e})" for e in _DESIGN.values()) + "]) AS varies FROM features) WHERE varies", "features"))
def e01b(c: Chain) -> DataFrame:
    """Means of the design columns that vary: splines, indicators, logarithm, centred year, product."""
    d = c.features.withColumn("year", F.year("index_date"))
    out, names = E.design(d, {"age": _KNOTS}, {"region": ("cervical", "lumbar", "thoracic", "absent")}, ["los_days"], {"year": 2024.0}, [("log_los_days", "region_lumbar")])
    one = out.agg(*[F.avg(n).alias(n) for n in names])
    return rounded(one.unpivot([], names, "name", "mean"), "mean")


_EXPOSED = "(SELECT least(3.0, coalesce(r, 1.0)) AS x, CAST(r IS NULL AS DOUBLE) AS a, role FROM (SELECT any_value(m.role) AS role, median(g.steps) / any_value(f.baseline_steps) AS r FROM sets m JOIN features f USING (episode_id) LEFT JOIN grid g ON g.person_id = m.person_id AND g.activity_date - f.discharge_date - m.day BETWEEN {lo} AND {hi} AND g.activity_date > f.discharge_date AND g.valid_wear AND g.steps IS NOT NULL GROUP BY m.set_id, m.episode_id, m.role, m.day))"
_KN = (0.3, 0.8, 1.5)
_AT, _ONE = _spline_sql("x", _KN), _spline_sql("1.0", _KN)


@query("e02_exposure_block", sql("SELECT role, count(*) AS n, " + ", ".join(f"round(avg((1 - a) * ({u} - ({v}))), 6) AS ratio_e{k}" for k, (u, v) in enumerate(zip(_AT, _ONE, strict=True), 1)) + ", round(avg(a), 6) AS ratio_absent FROM " + _EXPOSED.format(lo=P.landmark[0], hi=P.landmark[1]) + " GROUP BY role", "sets", "grid"))
def e02(c: Chain) -> DataFrame:
    """Means by role of the exposure block: spline columns that vanish at ratio 1, and the indicator of absence."""
    from panelwise.operators.events import member_exposure

    m = member_exposure(c.sets, c.features, c.grid, P.landmark, 1).select("role", F.least("ratio", F.lit(3.0)).alias("ratio"), F.col("ratio").isNull().alias("none"))
    out, names = E.exposure_block(m, "ratio", "none", _KN, 1.0)
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in names])


@query("e23_attempts", sql("SELECT 1 AS attempt, 'logit_on_itself' AS estimator, CASE WHEN count_if(y = 1) * count_if(y = 0) > 0 THEN 'failed: separated' ELSE 'fitted' END AS status FROM days UNION ALL SELECT 2, 'fractional_logit', CASE WHEN min(deficit) < max(deficit) THEN 'fitted' END FROM days", "days"))
def e23(c: Chain) -> DataFrame:
    """A fit that is separated by construction, and the one that is stepped down to."""
    d = _terms(c)
    _, record = E.fit_or_step_down([("logit_on_itself", lambda: E.fit_logit(d, ("one", "y"), "y")), ("fractional_logit", lambda: E.fit_logit(d.where("deficit IS NOT NULL"), ("one", "day"), "deficit")), ("cell_means", lambda: E.cell_means(d, "region", "post_day", "deficit", "w"))])
    return c.spark.createDataFrame(record, "attempt int, estimator string, status string")


_MATCHED = "(SELECT m.set_id, any_value(m.role) = 'case' AS is_case, least(3.0, median(g.steps) / any_value(f.baseline_steps)) AS r FROM sets m JOIN features f USING (episode_id) LEFT JOIN grid g ON g.person_id = m.person_id AND g.activity_date - f.discharge_date - m.day BETWEEN {lo} AND {hi} AND g.activity_date > f.discharge_date AND g.valid_wear AND g.steps IS NOT NULL WHERE m.day > 3 GROUP BY m.set_id, m.episode_id, m.role, m.day)".format(lo=P.landmark[0], hi=P.landmark[1])


@query("e26_association", sql("SELECT unnest(['tenths', 'absent']) AS term, round(unnest([b0, b1]), 5) AS beta, round(unnest([sqrt(v00), sqrt(v11)]), 5) AS se, round(unnest([sqrt(r00), sqrt(r11)]), 5) AS robust_se, round((SELECT coalesce(avg(CAST(r >= 3 AS DOUBLE)), 0) FROM " + _MATCHED + "), 6) AS at_ceiling FROM (" + matched_sql(f"(SELECT set_id, is_case, coalesce(10 * (r - 1), 0) AS tenths, CAST(r IS NULL AS DOUBLE) AS absent FROM {_MATCHED})", ["tenths", "absent"], 1.0) + ")", "sets", "grid"))
def e26(c: Chain) -> DataFrame:
    from panelwise.operators.events import member_exposure

    m = member_exposure(c.sets, c.features, c.grid, P.landmark, 1).where("day > 3")
    d = m.select("set_id", (F.col("role") == "case").alias("is_case"), F.least("ratio", F.lit(3.0)).alias("r"))
    at_most = d.agg(F.coalesce(F.avg((F.col("r") >= 3).cast("double")), F.lit(0.0)).alias("s")).first()["s"]
    fit = M.fit_conditional_logit(d.withColumns({"tenths": F.coalesce(10 * (F.col("r") - 1), F.lit(0.0)), "absent": F.col("r").isNull().cast("double")}), ["tenths", "absent"], ridge=1.0)
    se, robust = (np.sqrt(np.diag(fit[k])) for k in ("cov", "robust"))
    found = [(n, float(round(fit["beta"][i], 5)), float(round(se[i], 5)), float(round(robust[i], 5)), round(at_most, 6)) for i, n in enumerate(("tenths", "absent"))]
    return c.spark.createDataFrame(found, "term string, beta double, se double, robust_se double, at_ceiling double")


#: Members of the matched sets with the exposure block of their own landmark window: the spline of the ratio, 0 at ratio 1, and
#: the indicator of an absent ratio. Members whose window cannot lie after discharge are left out.
_BLOCK = f"(SELECT set_id, CAST(person_id AS VARCHAR) AS person, is_case, {', '.join(f'(1 - a) * ({u} - ({v})) AS e{k}' for k, (u, v) in enumerate(zip(_AT, _ONE, strict=True), 1))}, a FROM (SELECT set_id, person_id, is_case, least(3.0, coalesce(r, 1.0)) AS x, CAST(r IS NULL AS DOUBLE) AS a FROM (SELECT m.set_id, m.person_id, any_value(m.role) = 'case' AS is_case, median(g.steps) / any_value(f.baseline_steps) AS r FROM sets m JOIN features f USING (episode_id) LEFT JOIN grid g ON g.person_id = m.person_id AND g.activity_date - f.discharge_date - m.day BETWEEN {P.landmark[0]} AND {P.landmark[1]} AND g.activity_date > f.discharge_date AND g.valid_wear AND g.steps IS NOT NULL WHERE m.day > 3 GROUP BY m.set_id, m.person_id, m.episode_id, m.role, m.day)))"
_LOWER = 0.8


def _exposed_members(c: Chain) -> tuple[DataFrame, list[str]]:
    from panelwise.operators.events import member_exposure

    m = member_exposure(c.sets, c.features, c.grid, P.landmark, 1).select("set_id", "role", "person_id", "day", F.least("ratio", F.lit(3.0)).alias("ratio"), F.col("ratio").isNull().alias("none"))
    return E.exposure_block(m, "ratio", "none", _KN, 1.0)


@query("e07b_clustered", sql("SELECT unnest(['ratio_e1', 'ratio_e2', 'ratio_absent']) AS term, round(unnest([b0, b1, b2]), 5) AS beta, round(unnest([sqrt(v00), sqrt(v11), sqrt(v22)]), 5) AS se, round(unnest([sqrt(r00), sqrt(r11), sqrt(r22)]), 5) AS set_se, round(unnest([sqrt(p00), sqrt(p11), sqrt(p22)]), 5) AS person_se FROM (" + matched_sql(_BLOCK, ["e1", "e2", "a"], 1.0, person="person") + ")", "sets", "grid"))
def e07b(c: Chain) -> DataFrame:
    """Conditional fit of the exposure block with model errors and errors robust to sets and to persons."""
    m, block = _exposed_members(c)
    fit = M.fit_conditional_logit(m.where("day > 3").withColumn("is_case", F.col("role") == "case"), block, "person_id", ridge=1.0)
    se = {k: np.sqrt(np.diag(fit[k])) for k in ("cov", "robust", "clustered")}
    return c.spark.createDataFrame([(n, *(float(round(v, 5)) for v in (fit["beta"][i], se["cov"][i], se["robust"][i], se["clustered"][i]))) for i, n in enumerate(block)], "term string, beta double, se double, set_se double, person_se double")


def _spline_at(v: float) -> list[float]:
    cube = lambda t: max(v - t, 0.0) ** 3
    last, before, scale = _KN[-1], _KN[-2], (_KN[-1] - _KN[0]) ** 2
    return [v] + [(cube(t) - cube(before) * (last - t) / (last - before) + cube(last) * (before - t) / (last - before)) / scale for t in _KN[:-2]]


_LOW = [a - b for a, b in zip(_spline_at(_LOWER), _spline_at(1.0), strict=True)]
_CONTRASTS = {"lower_ratio": np.array([*_LOW, 0.0]), "absent": np.array([0.0, 0.0, 1.0])}
_Z = 1.959963984540054


@query("e26b_association", sql(f"""WITH block AS MATERIALIZED (SELECT * FROM {_BLOCK}), fit AS MATERIALIZED ({matched_sql('block', ['e1', 'e2', 'a'], 1.0, person='person')}),
reps AS MATERIALIZED (SELECT unit, b, {multiplicity_sql('b', 'unit')} AS k FROM (SELECT unit, CAST(b AS INTEGER) AS b FROM (SELECT DISTINCT person AS unit FROM block), range(1, {_DRAWS + 1}) t(b))),
refit AS MATERIALIZED ({resampled_sql('block', ['e1', 'e2', 'a'], 1.0, 'reps', 'person')}),
est AS (SELECT 'lower_ratio' AS contrast, {_LOW[0]} * b0 + {_LOW[1]} * b1 AS estimate, {' + '.join(f'({_LOW[i]}) * ({_LOW[j]}) * v{min(i, j)}{max(i, j)}' for i in range(2) for j in range(2))} AS v, {' + '.join(f'({_LOW[i]}) * ({_LOW[j]}) * p{min(i, j)}{max(i, j)}' for i in range(2) for j in range(2))} AS pv FROM fit UNION ALL SELECT 'absent', b2, v22, p22 FROM fit),
many AS (SELECT 'lower_ratio' AS contrast, {_LOW[0]} * b0 + {_LOW[1]} * b1 AS est, greatest(abs(b0), abs(b1), abs(b2)) > 10 AS above FROM refit UNION ALL SELECT 'absent', b2, greatest(abs(b0), abs(b1), abs(b2)) > 10 FROM refit)
SELECT contrast, round(estimate, 4) AS estimate, round(sqrt(v), 4) AS se, round(sqrt(pv), 4) AS person_se, round(estimate - {_Z} * sqrt(pv), 4) AS low, round(estimate + {_Z} * sqrt(pv), 4) AS high, round(b_low, 4) AS boot_low, round(b_high, 4) AS boot_high, round(failed, 6) AS failed, round(above, 6) AS above
FROM est JOIN (SELECT contrast, CASE WHEN avg(CAST(above AS DOUBLE)) <= 0.25 THEN quantile_cont(est, 0.025) END AS b_low, CASE WHEN avg(CAST(above AS DOUBLE)) <= 0.25 THEN quantile_cont(est, 0.975) END AS b_high, 1 - count(*) / {_DRAWS} AS failed, avg(CAST(above AS DOUBLE)) AS above FROM many GROUP BY contrast) USING (contrast)""", "sets", "grid"))
def e26b(c: Chain) -> DataFrame:
    """The association in full: exposure block, contrasts, clustered and bootstrap intervals over whole persons."""
    m, block = _exposed_members(c)
    found = M.association(m, block, F.col("day") <= 3, _CONTRASTS, b=_DRAWS, ridge=1.0)
    rows = [(r[0], *(float(round(v, 4)) if np.isfinite(v) else None for v in r[1:8]), round(r[8], 6), round(r[9], 6)) for r in found]
    return c.spark.createDataFrame(rows, "contrast string, estimate double, se double, person_se double, low double, high double, boot_low double, boot_high double, failed double, above double")


@query("e27_discrete_time_fit", sql("SELECT unnest(['one', 'day', 'fusion']) AS term, round(unnest([b0, b1, b2]), 4) AS beta, round(unnest([sqrt(r00), sqrt(r11), sqrt(r22)]), 4) AS robust_se FROM (WITH dt AS MATERIALIZED (SELECT l.episode_id, (l.post_day - 5) / 5.0 AS day, CAST(x.is_fusion AS DOUBLE) AS fusion, CAST(coalesce(l.post_day = f.first_event, FALSE) AS DOUBLE) AS y FROM lm l JOIN features x ON x.episode_id = l.episode_id LEFT JOIN (SELECT episode_id, min(event_day) AS first_event FROM ev GROUP BY episode_id) f ON f.episode_id = l.episode_id WHERE NOT l.is_censored AND l.post_day <= coalesce(first_event, l.post_day)), dt_fit AS MATERIALIZED (" + newton_sql("dt", ["1", "day", "fusion"], "y") + ") SELECT * FROM (" + covariance_sql("dt", ["1", "day", "fusion"], "y", "dt_fit", "episode_id") + "))", "lm", "ev", "features"))
def e27(c: Chain) -> DataFrame:
    """The discrete-time design (day, covariate) fitted to the first event, with cluster-robust errors."""
    from panelwise.operators.events import discrete_time_panel

    d = discrete_time_panel(c.lm, c.ev).join(c.features.select("episode_id", "is_fusion"), "episode_id")
    d = d.select("episode_id", F.lit(1.0).alias("one"), ((F.col("post_day") - 5) / 5.0).alias("day"), F.col("is_fusion").cast("double").alias("fusion"), F.col("outcome").cast("double").alias("y"))
    fit = E.fit_logit(d, _LOST, "y", cluster="episode_id")
    se = np.sqrt(np.diag(fit["robust"]))
    return c.spark.createDataFrame([(n, float(round(b, 4)), float(round(v, 4))) for n, b, v in zip(_LOST, fit["beta"], se, strict=True)], "term string, beta double, robust_se double")
