"""Composite tables and rule lists in full: covariates, the whole ladder, gate ledger, model frames, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import aggregates as A
from panelwise.operators import episodes, events, ledgers
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.profiles import _long, _rules
from panelwise.plans.registry import query

ERA = ("2024-01-08", "2024-01-20")
_WIDTH = P.accrual[1] - P.accrual[0] + 1
_FULL = ["episode_id", "region", "is_fusion", "sex", "baseline_steps", "at_risk_last_day", "score", "score_missing", "score_ordinal", "bmi", "bmi_missing", "bmi_imputed", "index_year", "in_era", "device_family", "device_changed",
         "n_valid_baseline_days", "baseline_band", "baseline_steps_weekday", "n_valid_baseline_days_weekday", "baseline_steps_weekend", "n_valid_baseline_days_weekend", "n_analyzable_days", "n_at_risk_days", "censor_reason", "near_complete_window"]
_SCORE = " + ".join(f"CASE WHEN list_contains(cs, '{c}')" + "".join(f" AND NOT list_contains(cs, '{h}')" for h, low in episodes.TRUMPS.items() if low == c) + f" THEN {w} ELSE 0 END" for c, w in episodes.WEIGHTS.items())
_FEATURES = f"""
WITH f AS (SELECT f.*, e.n_analyzable_days, e.n_at_risk_days, e.censor_reason FROM features f JOIN elig e ON e.episode_id = f.episode_id AND e.first_fail_step IS NULL),
s AS (SELECT episode_id, {_SCORE} AS points FROM (SELECT f.episode_id, list(DISTINCT k.category) AS cs FROM f JOIN conditions k ON k.person_id = f.person_id AND f.index_date - k.condition_start_date BETWEEN 0 AND 365 AND k.category IS NOT NULL GROUP BY f.episode_id)),
m AS (SELECT episode_id, arg_max(v, (d, -k)) AS bmi FROM (SELECT f.episode_id, m.value_as_number AS v, m.measurement_date AS d, m.measurement_id AS k FROM f JOIN measurements m ON m.person_id = f.person_id AND f.index_date - m.measurement_date BETWEEN 0 AND 365 AND m.value_as_number BETWEEN {episodes.PLAUSIBLE[0]} AND {episodes.PLAUSIBLE[1]}) GROUP BY episode_id),
dev AS (SELECT f.episode_id, regexp_extract(upper(d.model), '[A-Z]+') AS family, d.device_date, d.device_date <= f.index_date AS before, d.device_date <= f.discharge_date + {P.panel_days} AND d.device_date <= f.index_date + {3 * P.panel_days} AS within FROM f JOIN devices d ON d.person_id = f.person_id AND d.device_date >= f.index_date - {P.look_back}),
mode AS (SELECT episode_id, family FROM (SELECT episode_id, family, count(*) AS n, max(device_date) AS last FROM dev WHERE before GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, last DESC, family) = 1),
moved AS (SELECT episode_id, count(DISTINCT family) > 1 AS changed FROM dev WHERE within GROUP BY episode_id)
SELECT f.episode_id, f.region, f.is_fusion, f.sex, f.baseline_steps, f.at_risk_last_day, coalesce(points, 0) AS score, points IS NULL AS score_missing, CASE WHEN points >= 3 THEN '3_or_more' ELSE CAST(coalesce(points, 0) AS VARCHAR) END AS score_ordinal,
 bmi, bmi IS NULL AS bmi_missing, coalesce(bmi, (SELECT median(bmi) FROM m)) AS bmi_imputed, year(f.index_date) AS index_year, f.index_date BETWEEN DATE '{ERA[0]}' AND DATE '{ERA[1]}' AS in_era, coalesce(mode.family, 'other_or_unknown') AS device_family, coalesce(changed, FALSE) AS device_changed,
 b.n_valid_baseline_days, b.baseline_band, b.baseline_steps_weekday, b.n_valid_baseline_days_weekday, b.baseline_steps_weekend, b.n_valid_baseline_days_weekend, f.n_analyzable_days, f.n_at_risk_days, f.censor_reason, f.n_analyzable_days >= {0.8 * _WIDTH} AS near_complete_window,
 round(f.age, 6) AS age, round(f.n_analyzable_days / {_WIDTH}, 6) AS share_window_observed
FROM f LEFT JOIN s USING (episode_id) LEFT JOIN m USING (episode_id) LEFT JOIN mode USING (episode_id) LEFT JOIN moved USING (episode_id) JOIN baseline b ON b.episode_id = f.episode_id"""


def _full(c: Chain) -> DataFrame:
    return episodes.full_features(c.elig, c.persons, c.baseline, c.conditions, c.measurements, c.devices, P, ERA)


@query("cp10b_full_features", sql(_FEATURES, "features", "elig", "conditions", "measurements", "devices", "baseline"))
def cp10b(c: Chain) -> DataFrame:
    return rounded(_full(c), "age", "share_window_observed").select(*_FULL, "age", "share_window_observed")


_RUNGS = "SELECT step, slug, kind, unit, n_in, n_out FROM (VALUES " + ", ".join(f"({i}, '{s}', '{k}', '{u}')" for i, s, k, u in ledgers.FRAME) + """) v(step, slug, kind, unit)
 JOIN (SELECT unnest([1, 2, 16, 17, 18, 19]) AS step, unnest([persons, with_records, analytic, analytic, events, computable]) AS n_in, unnest([with_records, episodes, analytic, events, computable, computable]) AS n_out
  FROM (SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(DISTINCT person_id) FROM elig) AS with_records, (SELECT count(*) FROM elig) AS episodes, (SELECT count(*) FROM elig WHERE first_fail_step IS NULL) AS analytic,
   (SELECT count(*) FROM ev WHERE episode_id IN (SELECT episode_id FROM elig WHERE first_fail_step IS NULL)) AS events, (SELECT count(*) FROM ev WHERE has_landmark AND episode_id IN (SELECT episode_id FROM elig WHERE first_fail_step IS NULL)) AS computable)) USING (step)
 UNION ALL SELECT step, slug, 'exclusion', 'episodes', (SELECT count(*) FROM elig WHERE coalesce(first_fail_step, 99) >= step), (SELECT count(*) FROM elig WHERE coalesce(first_fail_step, 99) > step) FROM (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(episodes.LADDER, 3)) + ") w(step, slug)"


@query("cp15b_full_ladder", sql(f"SELECT *, coalesce(lag(n_out) OVER (ORDER BY step) = n_in, TRUE) AND coalesce(n_dropped >= 0, TRUE) AND (kind <> 'terminal' OR n_in = n_out) AS closes FROM (SELECT *, CASE WHEN kind = 'exclusion' THEN n_in - n_out END AS n_dropped FROM ({_RUNGS}))", "elig", "persons", "ev"))
def cp15b(c: Chain) -> DataFrame:
    return ledgers.full_ladder(c.elig, c.persons, c.ev)


#: Reasons below the rungs: (rung, reason) -> (condition, rows it is counted among).
_REASONS = {
    ("baseline", "no_valid_day"): ("first_fail_step = 12 AND n_valid_baseline_days = 0", "first_fail_step = 12"),
    ("baseline", "too_few_days"): (f"first_fail_step = 12 AND n_valid_baseline_days BETWEEN 1 AND {P.least_baseline_days - 1}", "first_fail_step = 12"),
    ("baseline", "short_span"): (f"first_fail_step = 12 AND n_valid_baseline_days >= {P.least_baseline_days} AND baseline_span_days < {P.least_baseline_span}", "first_fail_step = 12"),
    ("no_window", "no_analyzable_day"): ("first_fail_step = 14 AND n_analyzable_days = 0", "first_fail_step = 14"),
    ("no_window", "not_at_risk"): ("first_fail_step = 14 AND n_at_risk_days = 0", "first_fail_step = 14"),
    ("truncated", "death"): ("first_fail_step = 15 AND censor_reason = 'death'", "first_fail_step = 15"),
    ("truncated", "repeat_operation"): ("first_fail_step = 15 AND censor_reason = 'repeat_operation'", "first_fail_step = 15"),
    **{("analytic_cohort", f"censoring_{r}"): (f"first_fail_step IS NULL AND censor_reason = '{r}'", "first_fail_step IS NULL") for r in ("none", "death", "repeat_operation", "observation_end")},
}


_REASONS_SQL = f"""WITH e AS (SELECT *, coalesce(first_fail_step, 99) AS step FROM elig), r AS (
 SELECT step, 'baseline' AS slug, CASE WHEN n_valid_baseline_days = 0 THEN 'no_valid_day' WHEN n_valid_baseline_days < {P.least_baseline_days} THEN 'too_few_days' WHEN baseline_span_days < {P.least_baseline_span} THEN 'short_span' END AS reason FROM e WHERE step = 12
 UNION ALL SELECT step, 'no_window', 'no_analyzable_day' FROM e WHERE step = 14 AND n_analyzable_days < 1 UNION ALL SELECT step, 'no_window', 'not_at_risk' FROM e WHERE step = 14 AND n_at_risk_days < 1
 UNION ALL SELECT step, 'truncated', censor_reason FROM e WHERE step = 15 UNION ALL SELECT step, 'analytic_cohort', concat('censoring_', censor_reason) FROM e WHERE step = 99),
k AS (SELECT slug, reason, count(*) AS n FROM r GROUP BY ALL), d AS (SELECT step, count(*) AS n FROM e GROUP BY step)
SELECT slug, reason, coalesce(k.n, 0) AS n, coalesce(d.n, 0) AS n_denominator FROM (VALUES ('baseline', 'no_valid_day', 12), ('baseline', 'too_few_days', 12), ('baseline', 'short_span', 12), ('no_window', 'no_analyzable_day', 14), ('no_window', 'not_at_risk', 14), ('truncated', 'death', 15), ('truncated', 'repeat_operation', 15),
 ('analytic_cohort', 'censoring_none', 99), ('analytic_cohort', 'censoring_death', 99), ('analytic_cohort', 'censoring_repeat_operation', 99), ('analytic_cohort', 'censoring_observation_end', 99)) v(slug, reason, step) LEFT JOIN k USING (slug, reason) LEFT JOIN d ON d.step = v.step"""


@query("cp16b_reasons_by_rung", sql(_REASONS_SQL, "elig"))
def cp16b(c: Chain) -> DataFrame:
    return ledgers.reasons_by_rung(c.elig, {k: (F.expr(a), F.expr(b)) for k, (a, b) in _REASONS.items()})


@query("cp16c_orphan_slugs", sql("SELECT slug FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s, _ in _REASONS) + f"]) AS slug FROM (SELECT count(*) FROM elig)) WHERE slug NOT IN (SELECT slug FROM ({_RUNGS}))", "elig", "persons", "ev"))
def cp16c(c: Chain) -> DataFrame:
    """Reasons whose rung is no rung of the ladder: none are expected."""
    from panelwise.operators.joins import orphans

    return orphans(cp16b(c).select("slug"), ledgers.full_ladder(c.elig, c.persons, c.ev), ["slug"])


_ORDERS = {"grave_first": ("malignancy", "trauma", "degenerative"), "degenerative_first": ("degenerative", "malignancy", "trauma")}


@query("cp21_evidence_split", sql("SELECT variant, path, n AS n_persons, round(n / sum(n) OVER (PARTITION BY variant), 6) AS share, CASE WHEN n / sum(n) OVER (PARTITION BY variant) >= 0.25 THEN 'report' ELSE 'note' END AS response FROM (SELECT variant, coalesce(list_filter(prefer, lambda x: list_contains(cs, x))[1], 'none') AS path, count(*) AS n FROM (SELECT person_id, list(DISTINCT category) AS cs FROM conditions GROUP BY person_id), (VALUES "
       + ", ".join(f"('{v}', [{', '.join(repr(x) for x in o)}])" for v, o in _ORDERS.items()) + ") w(variant, prefer) GROUP BY ALL)", "conditions"))
def cp21(c: Chain) -> DataFrame:
    return rounded(A.evidence_split(c.conditions, "person_id", {v: {n: F.col("category") == n for n in order} for v, order in _ORDERS.items()}, 0.25), "share")


_GROUP = "concat(CASE WHEN is_fusion THEN 'fusion' ELSE 'other' END, '_', region)"
_PARTS = {("B", "total"): ("baseline", f"n_valid_baseline_days >= {P.least_baseline_days}"), ("C", "total"): ("elig", "NOT x_no_window"), ("D", "first_ed_visits"): ("ev", "is_first_event AND event_kind <> 'inpatient'"),
          ("D", "readmissions"): ("ev", "is_first_event AND event_kind <> 'emergency_department'"), ("D", "composite"): ("ev", "is_first_event"), ("E", "total"): ("ev", "is_first_event AND has_landmark")}


@query("cp25b_gate_ledger", sql(f"SELECT 'A' AS stage, 'total' AS part, g AS stratum, count(*) AS n FROM (SELECT unnest([{_GROUP}, split_part({_GROUP}, '_', 1), 'all']) AS g FROM episodes WHERE region IN ('cervical', 'lumbar')) GROUP BY g UNION ALL "
       + " UNION ALL ".join(f"SELECT '{s}', '{p}', 'all', count_if({e}) FROM {t}" for (s, p), (t, e) in _PARTS.items())
       + f" UNION ALL SELECT 'F', 'total', g, count(*) FROM (SELECT unnest([{_GROUP}, split_part({_GROUP}, '_', 1), 'all']) AS g FROM ev JOIN features USING (episode_id) WHERE is_first_event AND has_landmark) GROUP BY g", "baseline", "elig", "ev"))
def cp25b(c: Chain) -> DataFrame:
    """Stages A to F with their parts; A and F by group, pair of groups and in all."""
    group = F.expr(_GROUP)
    levels = F.explode(F.array(group, F.split_part(group, F.lit("_"), F.lit(1)), F.lit("all"))).alias("stratum")
    count = lambda d, s: d.select(levels).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("stage"), F.lit("total").alias("part"), "stratum", "n")
    out = count(c.episodes.where("region IN ('cervical', 'lumbar')"), "A")
    tables = {"baseline": c.baseline, "elig": c.elig, "ev": c.ev}
    for name in tables:
        mine = {k: e for k, (t, e) in _PARTS.items() if t == name}
        one = tables[name].agg(*[F.count_if(F.expr(e)).alias(f"p{i}") for i, e in enumerate(mine.values())])
        long = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("part"), F.lit("all").alias("stratum"), F.col(f"p{i}").alias("n")) for i, (s, p) in enumerate(mine)])).alias("x")
        out = out.unionByName(one.select(long).select("x.*"))
    first = c.ev.where("is_first_event AND has_landmark").select("episode_id").join(c.features.select("episode_id", "is_fusion", "region"), "episode_id")
    return out.unionByName(count(first, "F"))


def _frame_sql(lo: int, hi: int, late: str = "") -> str:
    from panelwise.plans.cohort import _EXPOSURE, _GOOD

    core = _EXPOSURE.format(good=_GOOD, least=P.least_window_days, lo=lo, hi=hi)
    return f"""SELECT dense_rank() OVER (ORDER BY x.set_id) AS set_index, x.episode_id, x.role, x.n_valid, x.ratio, f.age, f.is_fusion, f.region, f.los_days, round(l.landmark_lag, 6) AS weight_input
FROM ({core}) x JOIN sets m USING (set_id, episode_id, role) JOIN features f ON f.episode_id = x.episode_id LEFT JOIN lm l ON l.episode_id = x.episode_id AND l.post_day = m.day {late}"""


def _frame(c: Chain, members: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Members of sets with their exposure in a window, covariates, the input of the observation weight and a
    number in place of the set's identifier."""
    from panelwise.operators.groups import with_surrogate

    x = rounded(events.member_exposure(members, c.features, c.grid, window, P.least_window_days), "ratio")
    x = x.select("person_id", "set_id", "episode_id", "role", "day", "n_valid", "ratio").join(c.features.select("person_id", "episode_id", "age", "is_fusion", "region", "los_days"), ["person_id", "episode_id"])
    lag = c.lm.select("person_id", "episode_id", F.col("post_day").alias("day"), F.round("landmark_lag", 6).alias("weight_input"))
    return with_surrogate(x.join(lag, ["person_id", "episode_id", "day"], "left"), "set_id", "set_index").drop("set_id", "day", "person_id")


@query("cp27b_model_frame", sql(_frame_sql(*P.reference), "sets", "grid", "lm"))
def cp27b(c: Chain) -> DataFrame:
    return _frame(c, c.sets, P.reference)


@query("cp28b_negative_control_frame", sql(_frame_sql(*P.control, "WHERE x.set_id IN (SELECT set_id FROM sets WHERE role = 'case' AND day > 8)"), "sets", "grid", "lm"))
def cp28b(c: Chain) -> DataFrame:
    return _frame(c, c.sets.join(c.sets.where("role = 'case' AND day > 8").select("set_id"), "set_id", "left_semi"), P.control)


@query("cp29b_discrete_time_full", sql(f"""
WITH first AS (SELECT episode_id, min(event_day) AS first_event FROM ev GROUP BY episode_id),
near AS (SELECT p.episode_id, p.post_day, median(q.normalized_activity) AS near, count(q.normalized_activity) AS n_near FROM panel p LEFT JOIN panel q ON q.episode_id = p.episode_id AND q.post_day - p.post_day BETWEEN {P.landmark[0]} AND {P.landmark[1]} GROUP BY ALL)
SELECT l.episode_id, l.post_day, l.n_valid, l.has_landmark, CAST(coalesce(l.post_day = first_event, FALSE) AS INTEGER) AS outcome, round(CASE WHEN n_near >= {P.least_window_days} THEN near END, 6) AS near_ratio, NOT l.has_landmark OR n_near <= l.n_valid AS recount_agrees
FROM lm l LEFT JOIN first USING (episode_id) JOIN near USING (episode_id, post_day) WHERE NOT l.is_censored AND l.post_day <= coalesce(first_event, l.post_day)""", "lm", "panel", "ev"))
def cp29b(c: Chain) -> DataFrame:
    """The discrete-time panel with the median of the landmark window and a recount of its days."""
    from pyspark.sql import Window

    w = Window.partitionBy("episode_id").orderBy("post_day").rangeBetween(*P.landmark)
    near = c.panel.select("episode_id", "post_day", F.collect_list("normalized_activity").over(w).alias("near"))
    middle = F.when(F.size("near") >= P.least_window_days, F.expr("aggregate(slice(array_sort(near), cast((size(near) + 1) div 2 as int), 2 - size(near) % 2), 0D, (a, x) -> a + x) / (2 - size(near) % 2)"))
    d = events.discrete_time_panel(c.lm, c.ev).join(near.select("episode_id", "post_day", "near"), ["episode_id", "post_day"])
    return d.select("episode_id", "post_day", "n_valid", "has_landmark", "outcome", F.round(middle, 6).alias("near_ratio"), (~F.col("has_landmark") | (F.size("near") <= F.col("n_valid"))).alias("recount_agrees"))


_PERMITTED = tuple((a, t) for a, t in (("counts", "none"), ("distributions", "descriptive"), ("event_curve", "descriptive"), ("risk_difference", "descriptive"), ("ledger_strata", "descriptive"), ("conditional_logit", "reduced"), ("negative_control", "reduced"), ("bootstrap", "reduced"),
              ("dose_response", "reduced"), ("lag_sensitivity", "reduced"), ("rung_sensitivity", "reduced"), ("missing_signal", "reduced"), ("discrete_time", "full"), ("prediction", "full"), ("calibration", "full"), ("alert_burden", "full"), ("interaction", "full"), ("subgroups", "full"), ("lead_time", "full")))
_TIERS = ("none", "descriptive", "reduced", "full")


@query("cp24b_permitted_analyses", sql("SELECT analysis, least_tier, tier, list_position(" + str(list(_TIERS)) + ", tier) >= list_position(" + str(list(_TIERS)) + ", least_tier) AS permitted FROM (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in _PERMITTED) + ") v(analysis, least_tier), (SELECT CASE WHEN n >= 100 THEN 'full' WHEN n >= 50 THEN 'reduced' WHEN n >= 20 THEN 'descriptive' ELSE 'none' END AS tier FROM (SELECT count_if(has_landmark) AS n FROM ev))", "ev"))
def cp24b(c: Chain) -> DataFrame:
    from panelwise.operators.groups import tier_for_count

    tier = c.ev.agg(tier_for_count(F.count_if("has_landmark")).alias("tier"))
    order = F.array(*map(F.lit, _TIERS))
    table = c.spark.createDataFrame(_PERMITTED, "analysis string, least_tier string")
    return table.join(F.broadcast(tier)).withColumn("permitted", F.array_position(order, F.col("tier")) >= F.array_position(order, F.col("least_tier")))


_Q5 = {"no_minutes_valid": "NOT (wear_minutes IS NULL AND valid_wear)", "no_minutes_analyzable": "NOT (wear_minutes IS NULL AND is_analyzable)", "no_steps_analyzable": "NOT (steps IS NULL AND is_analyzable)", "over_a_day_valid": "NOT (coalesce(wear_minutes, 0) > 1440 AND valid_wear)", "zero_minutes_valid": "NOT (coalesce(wear_minutes, 1) = 0 AND valid_wear)"}


_Q5_SQL = "SELECT rule, CAST(n AS BIGINT) AS n_broken FROM (SELECT sum(CASE WHEN wear_minutes IS NULL AND valid_wear THEN 1 ELSE 0 END) AS no_minutes_valid, sum(CASE WHEN wear_minutes IS NULL AND is_analyzable THEN 1 ELSE 0 END) AS no_minutes_analyzable, sum(CASE WHEN steps IS NULL AND is_analyzable THEN 1 ELSE 0 END) AS no_steps_analyzable, sum(CASE WHEN wear_minutes > 1440 AND valid_wear THEN 1 ELSE 0 END) AS over_a_day_valid, sum(CASE WHEN wear_minutes = 0 AND valid_wear THEN 1 ELSE 0 END) AS zero_minutes_valid FROM grid) UNPIVOT (n FOR rule IN (no_minutes_valid, no_minutes_analyzable, no_steps_analyzable, over_a_day_valid, zero_minutes_valid))"


@query("q05b_must_be_zero", sql(_Q5_SQL, "grid"))
def q05b(c: Chain) -> DataFrame:
    return A.invariants(c.grid, _rules(_Q5))


_ALT = ("early", "late", "weekday", "weekend", "s1", "s2", "s3", "s4")
_Q8 = {"never_zero": "baseline_steps IS NULL OR baseline_steps <> 0", "never_negative": "baseline_steps IS NULL OR baseline_steps > 0", "no_null_with_days": "baseline_steps IS NOT NULL OR n_valid_baseline_days = 0", "no_value_without_days": "baseline_steps IS NULL OR n_valid_baseline_days > 0",
       "seven_weekdays": "cardinality(baseline_dow_counts) = 7", "weekdays_add_up": "baseline_dow_counts[A0] + baseline_dow_counts[A1] + baseline_dow_counts[A2] + baseline_dow_counts[A3] + baseline_dow_counts[A4] + baseline_dow_counts[A5] + baseline_dow_counts[A6] = n_valid_baseline_days",
       "weekend_is_first_and_last": "baseline_dow_counts[A0] + baseline_dow_counts[A6] = n_valid_baseline_days_weekend", "band_with_value": "baseline_steps IS NULL OR baseline_band IS NOT NULL", "floor_with_value": "baseline_steps IS NULL OR meets_baseline_floor IS NOT NULL",
       "span_with_value": "baseline_steps IS NULL OR baseline_span_days > 0", "span_not_negative": "baseline_span_days >= 0", "span_within_window": f"baseline_span_days <= {P.baseline[1] - P.baseline[0] + 1}",
       **{f"{n}_never_zero": f"baseline_steps_{n} IS NULL OR baseline_steps_{n} <> 0" for n in _ALT}, **{f"{n}_value_with_days": f"(baseline_steps_{n} IS NULL) = (n_valid_baseline_days_{n} = 0)" for n in _ALT}}


_DOW = "list_sum(baseline_dow_counts)"
_Q8_BROKEN = {"never_zero": "baseline_steps = 0", "never_negative": "baseline_steps <= 0", "no_null_with_days": "baseline_steps IS NULL AND n_valid_baseline_days <> 0", "no_value_without_days": "baseline_steps IS NOT NULL AND n_valid_baseline_days < 1", "seven_weekdays": "len(baseline_dow_counts) <> 7",
              "weekdays_add_up": f"{_DOW} <> n_valid_baseline_days", "weekend_is_first_and_last": "list_first(baseline_dow_counts) + list_last(baseline_dow_counts) <> n_valid_baseline_days_weekend", "band_with_value": "baseline_steps IS NOT NULL AND baseline_band IS NULL", "floor_with_value": "baseline_steps IS NOT NULL AND meets_baseline_floor IS NULL",
              "span_with_value": "baseline_steps IS NOT NULL AND baseline_span_days <= 0", "span_not_negative": "baseline_span_days < 0", "span_within_window": f"baseline_span_days > {P.baseline[1] - P.baseline[0] + 1}"}
_Q8_BROKEN |= {f"{n}_never_zero": f"baseline_steps_{n} = 0" for n in _ALT} | {f"{n}_value_with_days": f"baseline_steps_{n} IS NULL AND n_valid_baseline_days_{n} > 0 OR baseline_steps_{n} IS NOT NULL AND n_valid_baseline_days_{n} = 0" for n in _ALT}


@query("q08b_baseline_rules", sql("SELECT rule, CAST(n AS BIGINT) AS n_broken FROM (SELECT " + ", ".join(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS {n}" for n, e in _Q8_BROKEN.items()) + f" FROM baseline) UNPIVOT (n FOR rule IN ({', '.join(_Q8_BROKEN)}))", "baseline"))
def q08b(c: Chain) -> DataFrame:
    return A.invariants(c.baseline, _rules({n: e.replace("[A", "[") for n, e in _Q8.items()}))


_Q9 = {"key_given": "episode_id IS NOT NULL AND post_day IS NOT NULL", "date_follows_day": "datediff('day', discharge_date, calendar_date) = post_day", "operative_day": "postoperative_day = post_day + los_days", "null_wear_not_valid": "wear_minutes IS NOT NULL OR NOT valid_wear",
       "null_steps_not_analyzable": "steps IS NOT NULL OR NOT is_analyzable", "unobserved_has_no_deficit": "day_kind = 'observed' OR deficit IS NULL", "unobserved_has_no_activity": "day_kind = 'observed' OR normalized_activity IS NULL", "observed_has_deficit": "day_kind <> 'observed' OR deficit IS NOT NULL",
       "truncated_is_clipped": "deficit IS NULL OR abs(deficit - greatest(0.0, deficit_untruncated)) < 0.000000001", "activity_is_complement": "deficit_untruncated IS NULL OR abs(1 - normalized_activity - deficit_untruncated) < 0.000000001", "baseline_positive": "baseline_steps > 0", "lag_in_range": "lagged_wear_fraction IS NULL OR lagged_wear_fraction BETWEEN 0 AND 1",
       "censored_after_last": "is_censored = (post_day > at_risk_last_day)", "censored_kind": "is_censored = (day_kind = 'censored')", "four_kinds": "day_kind_four IN ('censored', 'inpatient', 'observed', 'missing')", "three_kinds": "day_kind IN ('censored', 'observed', 'missing')", "inpatient_kind": "day_kind_four <> 'inpatient' OR is_inpatient",
       "observed_valid": "NOT is_analyzable OR valid_wear", "window_days": f"in_accrual_window = (post_day BETWEEN {P.accrual[0]} AND {P.accrual[1]})", "zero_steps_lose_all": "NOT (is_analyzable AND steps = 0) OR deficit = 1"}


@query("q09b_panel_rules", sql(_long(_Q9, "panel"), "panel"))
def q09b(c: Chain) -> DataFrame:
    return A.invariants(c.panel, _rules({n: e.replace("datediff('day', discharge_date, calendar_date)", "datediff(calendar_date, discharge_date)") for n, e in _Q9.items()}))


_Q15 = {"event_in_panel": "ev_day IS NULL OR post_day IS NOT NULL", "event_flag": "is_event = (ev_day IS NOT NULL)", "first_is_event": "NOT is_first OR is_event", "valid_agrees": "ev_valid IS NULL OR n_valid <= n_days", "calendar_days_at_most": f"n_calendar_days <= {P.lag_days}", "calendar_lag_given": "(calendar_lag IS NULL) = (n_calendar_days = 0)", "lag_needs_days": "landmark_lag IS NULL OR post_day > 3", "landmark_needs_days": "NOT has_landmark OR n_valid >= 2"}
_LM_EV = "(SELECT l.*, e.event_day AS ev_day, e.n_valid AS ev_valid FROM lm l LEFT JOIN ev e ON e.episode_id = l.episode_id AND e.event_day = l.post_day)"


_Q15_SQL = f"""SELECT rule, CAST(n AS BIGINT) AS n_broken FROM (SELECT sum(CASE WHEN ev_day IS NOT NULL AND post_day IS NULL THEN 1 ELSE 0 END) AS event_in_panel, sum(CASE WHEN is_event AND ev_day IS NULL OR NOT is_event AND ev_day IS NOT NULL THEN 1 ELSE 0 END) AS event_flag, sum(CASE WHEN is_first AND NOT is_event THEN 1 ELSE 0 END) AS first_is_event,
 sum(CASE WHEN ev_valid IS NOT NULL AND n_valid > n_days THEN 1 ELSE 0 END) AS valid_agrees, sum(CASE WHEN n_calendar_days > {P.lag_days} THEN 1 ELSE 0 END) AS calendar_days_at_most, sum(CASE WHEN calendar_lag IS NULL AND n_calendar_days > 0 OR calendar_lag IS NOT NULL AND n_calendar_days = 0 THEN 1 ELSE 0 END) AS calendar_lag_given,
 sum(CASE WHEN landmark_lag IS NOT NULL AND post_day <= 3 THEN 1 ELSE 0 END) AS lag_needs_days, sum(CASE WHEN has_landmark AND n_valid < 2 THEN 1 ELSE 0 END) AS landmark_needs_days FROM {_LM_EV})
 UNPIVOT (n FOR rule IN (event_in_panel, event_flag, first_is_event, valid_agrees, calendar_days_at_most, calendar_lag_given, lag_needs_days, landmark_needs_days))"""


@query("q15b_landmark_event_rules", sql(_Q15_SQL, "lm", "ev"))
def q15b(c: Chain) -> DataFrame:
    e = c.ev.select("episode_id", F.col("event_day").alias("post_day"), F.col("event_day").alias("ev_day"), F.col("n_valid").alias("ev_valid"))
    return A.invariants(c.lm.join(e, ["episode_id", "post_day"], "left"), _rules(_Q15))


@query("q14b_event_timing", sql("SELECT event_kind, CASE WHEN has_landmark THEN 'computable' WHEN no_window THEN 'no_window' ELSE 'no_signal' END AS state, count(*) AS n, min(event_day) AS first_day, median(event_day) AS median_day, max(event_day) AS last_day FROM ev WHERE is_first_event GROUP BY ALL", "ev"))
def q14b(c: Chain) -> DataFrame:
    """When first events fall, by whether their landmark can be computed: those deleted come early."""
    state = F.when(F.col("has_landmark"), "computable").when(F.col("no_window"), "no_window").otherwise("no_signal")
    return c.ev.where("is_first_event").groupBy("event_kind", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("event_day").alias("first_day"), F.median("event_day").alias("median_day"), F.max("event_day").alias("last_day"))


@query("q18b_early_members", sql("SELECT role, match_rung, CASE WHEN day <= 3 THEN 'before_window' WHEN day <= 5 THEN 'partial_window' ELSE 'whole_window' END AS route, count(*) AS n, count(DISTINCT set_id) AS n_sets FROM sets GROUP BY ALL", "sets"))
def q18b(c: Chain) -> DataFrame:
    route = F.when(F.col("day") <= 3, "before_window").when(F.col("day") <= 5, "partial_window").otherwise("whole_window")
    return c.sets.groupBy("role", "match_rung", route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("set_id").alias("n_sets"))


@query("q22b_identities", sql("SELECT identity, a AS \"left\", b AS \"right\", a = b AS holds FROM (SELECT unnest(['episodes', 'persons', 'eligible', 'panel_days', 'events', 'cases', 'sets', 'landmark_days']) AS identity, unnest([(SELECT count(*) FROM elig), (SELECT count(DISTINCT person_id) FROM elig), (SELECT count(*) FROM elig WHERE first_fail_step IS NULL), (SELECT count(*) FROM panel), (SELECT count(*) FROM ev), (SELECT count(*) FROM sets WHERE role = 'case'), (SELECT count(DISTINCT set_id) FROM sets), (SELECT count(*) FROM lm)]) AS a, "
       f"unnest([(SELECT count(*) FROM episodes), (SELECT count(DISTINCT person_id) FROM records JOIN codes USING (code)), (SELECT count(*) FROM elig) - (SELECT count(first_fail_step) FROM elig), {P.panel_days} * (SELECT count(*) FROM features), (SELECT count(DISTINCT event_id) FROM ev), (SELECT count(*) FROM ev WHERE is_first_event AND NOT no_window), (SELECT count(*) FROM sets WHERE role = 'case'), (SELECT count(*) FROM panel)]) AS b)", "elig", "panel", "ev", "sets", "lm", "records"))
def q22b(c: Chain) -> DataFrame:
    n = lambda d: d.agg(F.count(F.lit(1)))
    return ledgers.identities({
        "episodes": (n(c.elig), n(c.episodes)), "persons": (c.elig.agg(F.countDistinct("person_id")), c.records.join(c.codes, "code").agg(F.countDistinct("person_id"))),
        "eligible": (n(c.elig.where("is_eligible")), c.elig.agg(F.count(F.lit(1)) - F.count("first_fail_step"))), "panel_days": (n(c.panel), c.features.agg(F.count(F.lit(1)) * P.panel_days)),
        "events": (n(c.ev), c.ev.agg(F.countDistinct("event_id"))), "cases": (n(c.sets.where("role = 'case'")), n(c.ev.where("is_first_event AND NOT no_window"))),
        "sets": (c.sets.agg(F.countDistinct("set_id")), n(c.sets.where("role = 'case'"))), "landmark_days": (n(c.lm), n(c.panel))})


_Q25 = {"set_has_role": "role IN ('case', 'control')", "case_rung": "role <> 'case' OR match_rung = 1", "rung_known": "match_rung BETWEEN 1 AND 3", "set_named": "set_id IS NOT NULL", "member_named": "episode_id IS NOT NULL AND person_id IS NOT NULL"}


_Q25_SQL = "SELECT rule, CAST(n AS BIGINT) AS n_broken FROM (SELECT count(*) - sum(CASE WHEN role = 'case' OR role = 'control' THEN 1 ELSE 0 END) AS set_has_role, sum(CASE WHEN role = 'case' AND match_rung <> 1 THEN 1 ELSE 0 END) AS case_rung, sum(CASE WHEN match_rung IN (1, 2, 3) THEN 0 ELSE 1 END) AS rung_known, count(*) - count(set_id) AS set_named, sum(CASE WHEN episode_id IS NULL OR person_id IS NULL THEN 1 ELSE 0 END) AS member_named FROM sets) UNPIVOT (n FOR rule IN (set_has_role, case_rung, rung_known, set_named, member_named))"


@query("q25b_set_rules", sql(_Q25_SQL, "sets"))
def q25b(c: Chain) -> DataFrame:
    return A.invariants(c.sets, _rules(_Q25))


@query("q28b_event_day_range", sql(f"SELECT count(*) AS n, min(event_day) AS first_day, max(event_day) AS last_day, count_if(landmark_day <> event_day - {-P.landmark[1]}) AS n_off, min(event_day) >= 1 AS in_range FROM ev", "ev"))
def q28b(c: Chain) -> DataFrame:
    return c.ev.agg(F.count(F.lit(1)).alias("n"), F.min("event_day").alias("first_day"), F.max("event_day").alias("last_day"), F.count_if(F.col("landmark_day") != F.col("event_day") + P.landmark[1]).alias("n_off"), (F.min("event_day") >= 1).alias("in_range"))


@query("q31b_required_kinds", sql("SELECT kind, count(visit_occurrence_id) AS n, count(visit_occurrence_id) > 0 AS present FROM (VALUES ('inpatient'), ('emergency'), ('hospice')) r(kind) LEFT JOIN visits ON visit_kind = kind GROUP BY kind", "visits"))
def q31b(c: Chain) -> DataFrame:
    """Required kinds of visit and whether the table has any of each."""
    n = c.visits.groupBy(F.col("visit_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    need = c.spark.createDataFrame([("inpatient",), ("emergency",), ("hospice",)], "kind string")
    return need.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("present"))


@query("q33_stored_ledger", sql("SELECT n_controls, count(*) AS n_sets FROM (SELECT set_id, count_if(role = 'control') AS n_controls FROM sets GROUP BY set_id) GROUP BY n_controls", "sets"))
def q33(c: Chain) -> DataFrame:
    """A ledger that was stored, read through for comparison."""
    return c.kept("set_sizes", lambda: ledgers.set_size_ledger(c.sets))


@query("cp02b_exact_code_set", sql("SELECT c.code, c.region, c.procedure_class, count(r.code) AS n_records FROM codes c LEFT JOIN records r USING (code) GROUP BY ALL", "codes", "records"))
def cp02b(c: Chain) -> DataFrame:
    """The code list with its exact number of codes asserted, and how often each is used."""
    codes = A.exact_size(c.codes, 100)
    used = c.records.groupBy("code").agg(F.count(F.lit(1)).alias("n_records"))
    return codes.join(used, "code", "left").select("code", "region", "procedure_class", F.coalesce("n_records", F.lit(0)).alias("n_records"))


@query("cp03b_pattern_set_whole", sql("SELECT category, model FROM (SELECT DISTINCT model FROM devices), (VALUES ('any_view', '^VIEW'), ('odd', '[13579]$'), ('seven', '7')) p(category, pattern) WHERE regexp_matches(model, pattern)", "devices"))
def cp03b(c: Chain) -> DataFrame:
    """Every model with each category whose pattern it fits; refused if a category has none."""
    from panelwise.plans.cohort import _PATTERNS

    hits = F.array_compact(F.array(*[F.when(F.col("model").rlike(p), F.lit(n)) for n, p in _PATTERNS]))
    found = c.devices.select("model").distinct().select(F.explode(hits).alias("category"), "model")
    return A.all_levels(found, "category", [n for n, _ in _PATTERNS])


@query("cp05b_minutes_checked", sql("SELECT person_id, date, wear_minutes FROM minutes", "minutes"))
def cp05b(c: Chain) -> DataFrame:
    """Daily minutes with the check of impossible days on: the stand-ins have more of them than real tables
    (13 % of person-days), so the share that is refused is 25 % here and 5 % by default."""
    from panelwise.operators.daily import daily_minutes

    return daily_minutes(c.zones, c.spans, 0.25).select("person_id", "date", "wear_minutes")
