"""Composite cohort operators (CP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import daily, episodes, events, ledgers
from panelwise.operators.aggregates import missingness
from panelwise.params import SCALED as P
from panelwise.params import build_params
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query


@query("cp01_build_params", sql(f"SELECT max(procedure_date) AS source_cutoff, {P.panel_days} AS panel_days, '{P.rule}' AS rule, {P.baseline[0]} AS baseline_from FROM records", "records"))
def cp01(c: Chain) -> DataFrame:
    return build_params(c.spark, P, c.records, "procedure_date").select("source_cutoff", "panel_days", "rule", F.col("baseline")[0].alias("baseline_from"))


@query("cp02_code_set", sql("SELECT procedure_class, region, count(*) AS n, count(DISTINCT code) AS n_codes, count(*) = count(DISTINCT code) AS unique_codes FROM codes JOIN (SELECT DISTINCT code FROM records) USING (code) GROUP BY ALL", "codes", "records"))
def cp02(c: Chain) -> DataFrame:
    used = c.codes.join(c.records.select("code").distinct(), "code")
    return used.groupBy("procedure_class", "region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("n_codes"), (F.count(F.lit(1)) == F.countDistinct("code")).alias("unique_codes"))


_PATTERNS = (("any_view", "^VIEW"), ("odd", "[13579]$"), ("seven", "7"))


@query("cp03_pattern_set", sql("SELECT p.category, count(DISTINCT d.model) AS n_models FROM devices d JOIN (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _PATTERNS) + ") p(category, pattern) ON regexp_matches(d.model, p.pattern) GROUP BY p.category", "devices"))
def cp03(c: Chain) -> DataFrame:
    models = c.devices.select("model").distinct()
    hits = F.array_compact(F.array(*[F.when(F.col("model").rlike(p), F.lit(n)) for n, p in _PATTERNS]))
    return models.withColumn("category", F.explode(hits)).groupBy("category").agg(F.count(F.lit(1)).alias("n_models"))


_EP = "episode_id, person_id, index_date, n_records, n_primary_records, is_fusion, region, index_visit_id, discharge_date, los_days, episode_seq"


@query("cp04_episodes", sql(f"SELECT {_EP} FROM episodes", "episodes"))
def cp04(c: Chain) -> DataFrame:
    return c.episodes.select(*_EP.split(", "))


@query("cp05_daily_minutes", sql("SELECT person_id, date, wear_minutes, largest_zone, n_zones FROM minutes", "minutes"))
def cp05(c: Chain) -> DataFrame:
    return c.minutes


@query("cp06_daily_category", sql("SELECT d.person_id, device_date, array_to_string(list_sort(list(DISTINCT model)), ';') AS models FROM devices d JOIN spans s ON s.person_id = d.person_id AND device_date BETWEEN lo AND hi GROUP BY ALL", "devices", "spans"))
def cp06(c: Chain) -> DataFrame:
    return daily.daily_category(c.devices, c.spans).withColumn("models", F.array_join("models", ";"))


_GRID = "person_id, activity_date, steps, wear_minutes, valid_wear, valid_wear_s1, valid_wear_s2, valid_wear_s3, valid_wear_s4, is_analyzable, day_of_week, is_weekend"


@query("cp07_person_day_grid", sql(f"SELECT {_GRID} FROM grid", "grid"))
def cp07(c: Chain) -> DataFrame:
    return c.grid.select(*_GRID.split(", "))


_BASE = ["episode_id", "baseline_steps", "n_valid_baseline_days", "baseline_span_days", "baseline_band", "meets_baseline_floor", "has_any_wearable"] + [f"{a}_{n}" for n in ("weekday", "weekend", "early", "late", "s1", "s2", "s3", "s4") for a in ("baseline_steps", "n_valid_baseline_days")]


@query("cp08_baseline", sql(f"SELECT {', '.join(_BASE)}, array_to_string(baseline_dow_counts, ',') AS dow FROM baseline", "baseline"))
def cp08(c: Chain) -> DataFrame:
    return c.baseline.select(*_BASE, F.array_join(F.col("baseline_dow_counts").cast("array<string>"), ",").alias("dow"))


_ELIG = ["episode_id", *[f"x_{n}" for n in episodes.LADDER], "n_at_risk_days", "n_analyzable_days", "censor_date", "censor_reason", "first_fail_step"]


@query("cp09_eligibility", sql(f"SELECT {', '.join(_ELIG)}, first_fail_step IS NULL AS is_eligible FROM elig", "elig"))
def cp09(c: Chain) -> DataFrame:
    return c.elig.select(*_ELIG, "is_eligible")


@query("cp09a_emergency_before", sql(f"SELECT e.episode_id, array_to_string(list_sort(list(DISTINCT v.visit_occurrence_id)), ',') AS ed_visits FROM episodes e JOIN visits v ON v.person_id = e.person_id AND v.visit_kind = 'emergency' AND coalesce(v.visit_end_date, v.visit_start_date) BETWEEN e.index_date - {P.ed_days} AND e.index_date GROUP BY e.episode_id", "episodes", "visits"))
def cp09a(c: Chain) -> DataFrame:
    return episodes.emergency_before(c.episodes, c.visits, P.ed_days).select("episode_id", F.array_join(F.col("ed_visit_ids").cast("array<string>"), ",").alias("ed_visits"))


@query("cp09b_condition_flags", sql(f"SELECT e.episode_id, bool_or(coalesce(k.category = 'trauma', FALSE)) AS ind_trauma, bool_or(coalesce(k.category = 'malignancy', FALSE)) AS ind_malignancy FROM episodes e JOIN conditions k ON k.person_id = e.person_id AND k.condition_start_date BETWEEN e.index_date - {P.look_back} AND e.index_date GROUP BY e.episode_id", "episodes", "conditions"))
def cp09b(c: Chain) -> DataFrame:
    return episodes.look_back_flags(c.episodes, c.conditions, ["trauma", "malignancy"], P.look_back)


@query("cp09e_censoring", sql("SELECT episode_id, death_date, repeat_date, censor_date, censor_reason FROM cens", "cens"))
def cp09e(c: Chain) -> DataFrame:
    return episodes.censoring(c.episodes, c.deaths, c.observation)


@query("cp10_features", sql("SELECT * FROM features", "features"))
def cp10(c: Chain) -> DataFrame:
    return c.features


_PANEL = "episode_id, post_day, calendar_date, steps, wear_minutes, valid_wear, is_analyzable, is_censored, is_inpatient, in_accrual_window, postoperative_day, day_kind, day_kind_four"


@query("cp11_day_panel", sql(f"SELECT {_PANEL}, round(normalized_activity, 6) AS normalized_activity, round(deficit, 6) AS deficit, round(deficit_untruncated, 6) AS deficit_untruncated, round(lagged_wear_fraction, 6) AS lagged_wear_fraction FROM panel", "panel"))
def cp11(c: Chain) -> DataFrame:
    return rounded(c.panel, "normalized_activity", "deficit", "deficit_untruncated", "lagged_wear_fraction").select(*_PANEL.split(", "), "normalized_activity", "deficit", "deficit_untruncated", "lagged_wear_fraction")


_EV = "event_id, episode_id, event_date, event_day, event_kind, visit_occurrence_id, event_rank, is_first_event, landmark_day, landmark_dow, n_valid, n_days, has_landmark, no_window, no_signal"
_RATIOS = ("wear_fraction", "r_near", "r_last", "r_reference", "r_control", "local_change")


@query("cp12_events", sql(f"SELECT {_EV}, {', '.join(f'round({r}, 6) AS {r}' for r in _RATIOS)} FROM ev", "ev"))
def cp12(c: Chain) -> DataFrame:
    return rounded(c.ev, *_RATIOS).select(*_EV.split(", "), *_RATIOS)


@query("cp12n_events_strict", sql(f"SELECT e.episode_id, e.event_date, e.event_kind FROM ev e JOIN features f USING (episode_id) WHERE e.event_day <= f.at_risk_last_day", "ev"))
def cp12n(c: Chain) -> DataFrame:
    return events.events(c.features, c.visits, c.grid, P, "strict").select("episode_id", "event_date", "event_kind")


_LM = "episode_id, post_day, is_censored, n_valid, n_days, has_landmark, no_window, no_signal, n_calendar_days, is_event, is_first"


@query("cp13_landmark_panel", sql(f"SELECT {_LM}, round(landmark_lag, 6) AS landmark_lag, round(calendar_lag, 6) AS calendar_lag FROM lm", "lm"))
def cp13(c: Chain) -> DataFrame:
    return rounded(c.lm, "landmark_lag", "calendar_lag").select(*_LM.split(", "), "landmark_lag", "calendar_lag")


@query("cp13x_landmark_crosscheck", sql("SELECT l.episode_id, l.post_day, l.n_valid, e.n_valid AS ev_valid FROM lm l JOIN ev e ON e.episode_id = l.episode_id AND e.event_day = l.post_day WHERE l.n_valid <> e.n_valid", "lm"))
def cp13x(c: Chain) -> DataFrame:
    return events.landmark_disagreements(c.lm, c.ev)


@query("cp14_risk_sets", sql("SELECT set_id, role, episode_id, person_id, day, match_rung FROM sets", "sets"))
def cp14(c: Chain) -> DataFrame:
    return c.sets


_EXPOSURE = """SELECT m.set_id, m.episode_id, m.role, count_if({good}) AS n_valid, round(CASE WHEN count_if({good}) >= {least} THEN median(CASE WHEN {good} THEN g.steps END) / f.baseline_steps END, 6) AS ratio
FROM sets m JOIN features f USING (episode_id) LEFT JOIN grid g ON g.person_id = m.person_id AND g.activity_date BETWEEN f.discharge_date + CAST(m.day AS INTEGER) + ({lo}) AND f.discharge_date + CAST(m.day AS INTEGER) + ({hi}) GROUP BY m.set_id, m.episode_id, m.role, m.day, f.baseline_steps"""
_GOOD = "g.activity_date > f.discharge_date AND g.valid_wear AND g.steps IS NOT NULL"


@query("cp14e_member_exposure", sql(_EXPOSURE.format(good=_GOOD, least=1, lo=P.landmark[0], hi=P.landmark[1]), "sets", "grid"))
def cp14e(c: Chain) -> DataFrame:
    return rounded(events.member_exposure(c.sets, c.features, c.grid, P.landmark, 1), "ratio").select("set_id", "episode_id", "role", "n_valid", "ratio")


_STEPS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(episodes.LADDER, 3))


@query("cp15_attrition", sql(f"SELECT step, rung, n_in, n_dropped, n_in - n_dropped AS n_out FROM (SELECT s.step, s.rung, (SELECT count(*) FROM elig) - (SELECT count(*) FROM elig WHERE first_fail_step < s.step) AS n_in, (SELECT count(*) FROM elig WHERE first_fail_step = s.step) AS n_dropped FROM (VALUES {_STEPS}) s(step, rung))", "elig"))
def cp15(c: Chain) -> DataFrame:
    return ledgers.attrition(c.elig)


@query("cp16_reason_ledger", sql("SELECT reason, count_if(hit) AS n_any, count_if(hit AND alone = 1) AS n_alone FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in episodes.LADDER) + "]) AS reason, unnest([" + ", ".join(f"x_{n}" for n in episodes.LADDER) + "]) AS hit, " + " + ".join(f"CAST(x_{n} AS INTEGER)" for n in episodes.LADDER) + " AS alone FROM elig) GROUP BY reason", "elig"))
def cp16(c: Chain) -> DataFrame:
    return ledgers.reason_ledger(c.elig)


_DAYS = "count_if(NOT is_censored) AS n_at_risk, count_if(valid_wear AND NOT is_censored) AS n_valid, count_if(is_analyzable) AS n_analyzable, count_if(is_inpatient AND NOT is_censored) AS n_inpatient"


@query("cp17_availability_by_day", sql(f"SELECT ga AS region, gb AS is_weekend, post_day, {_DAYS} FROM (SELECT *, unnest([region, region, 'all', 'all']) AS ga, unnest([CASE WHEN dayofweek(calendar_date) IN (0, 6) THEN 'true' ELSE 'false' END, 'all', CASE WHEN dayofweek(calendar_date) IN (0, 6) THEN 'true' ELSE 'false' END, 'all']) AS gb FROM panel) GROUP BY ALL", "panel"))
def cp17(c: Chain) -> DataFrame:
    return ledgers.availability_by_day(c.panel.withColumn("is_weekend", F.col("day_of_week").isin(1, 7)), "region", "is_weekend")


@query("cp18_set_size_ledger", sql("SELECT n_controls, count(*) AS n_sets FROM (SELECT set_id, count_if(role = 'control') AS n_controls FROM sets GROUP BY set_id) GROUP BY n_controls", "sets"))
def cp18(c: Chain) -> DataFrame:
    return ledgers.set_size_ledger(c.sets)


@query("cp19_missingness_ledger", sql("SELECT 'deficit' AS variable, count_if(day_kind = 'observed') AS n, count_if(day_kind = 'observed' AND deficit IS NULL) AS n_missing FROM panel UNION ALL SELECT 'lagged_wear_fraction', count(*), count_if(lagged_wear_fraction IS NULL) FROM panel UNION ALL SELECT 'steps', count_if(NOT is_censored), count_if(NOT is_censored AND steps IS NULL) FROM panel", "panel"))
def cp19(c: Chain) -> DataFrame:
    return missingness(c.panel, {"deficit": F.col("day_kind") == "observed", "lagged_wear_fraction": F.lit(True), "steps": ~F.col("is_censored")})


@query("cp20_pregate_counts", sql("SELECT region, is_fusion, count(DISTINCT person_id) AS n_persons, count(DISTINCT CASE WHEN n_primary_records > 0 THEN person_id END) AS n_primary, count(DISTINCT CASE WHEN n_primary_records > 0 AND discharge_date IS NOT NULL THEN person_id END) AS n_discharged, count(DISTINCT CASE WHEN n_primary_records > 0 AND discharge_date IS NOT NULL AND n_valid_baseline_days >= 3 THEN person_id END) AS n_baseline FROM elig GROUP BY ALL", "elig"))
def cp20(c: Chain) -> DataFrame:
    primary = F.col("n_primary_records") > 0
    out = primary & F.col("discharge_date").isNotNull()
    d = c.episodes.join(c.baseline.select("episode_id", "n_valid_baseline_days"), "episode_id")
    one = lambda cond: F.countDistinct(F.when(cond, F.col("person_id")))
    return d.groupBy("region", "is_fusion").agg(F.countDistinct("person_id").alias("n_persons"), one(primary).alias("n_primary"), one(out).alias("n_discharged"), one(out & (F.col("n_valid_baseline_days") >= 3)).alias("n_baseline"))


@query("cp22_mapping_crosscheck", sql("SELECT coalesce(procedure_class, 'unmapped') AS procedure_class, count(*) AS n_records, count(DISTINCT r.code) AS n_codes FROM records r LEFT JOIN (SELECT * FROM codes WHERE vocabulary = 'A') c USING (code) GROUP BY ALL", "records", "codes"))
def cp22(c: Chain) -> DataFrame:
    j = c.records.join(c.codes.where("vocabulary = 'A'"), "code", "left")
    return j.groupBy(F.coalesce("procedure_class", F.lit("unmapped")).alias("procedure_class")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("code").alias("n_codes"))


@query("cp23_group_collapse", sql("SELECT min(n) AS smallest, CASE WHEN count(*) = 4 AND min(n) > 20 THEN 'four' WHEN min(m) > 20 THEN 'two' WHEN sum(n) > 20 THEN 'one' ELSE 'none' END AS level FROM (SELECT n, sum(n) OVER (PARTITION BY is_fusion) AS m FROM (SELECT is_fusion, sex = 'F' AS is_female, count(*) AS n FROM features GROUP BY ALL))", "features"))
def cp23(c: Chain) -> DataFrame:
    from panelwise.operators.groups import collapse_level

    return collapse_level(c.features.withColumn("is_female", F.col("sex") == "F"), "is_fusion", "is_female")


@query("cp24_tier", sql("SELECT count(*) AS n_events, CASE WHEN count(*) >= 100 THEN 'full' WHEN count(*) >= 50 THEN 'reduced' WHEN count(*) >= 20 THEN 'descriptive' ELSE 'none' END AS tier FROM ev WHERE has_landmark", "ev"))
def cp24(c: Chain) -> DataFrame:
    from panelwise.operators.groups import tier_for_count

    return c.ev.where("has_landmark").agg(F.count(F.lit(1)).alias("n_events")).withColumn("tier", tier_for_count(F.col("n_events")))


@query("cp25_gate_ledger", sql("SELECT 'a_events' AS stage, count(*) AS n FROM ev UNION ALL SELECT 'b_first', count_if(is_first_event) FROM ev UNION ALL SELECT 'c_window', count_if(is_first_event AND NOT no_window) FROM ev UNION ALL SELECT 'd_in_sets', count(DISTINCT set_id) FROM sets WHERE role = 'control'", "ev", "sets"))
def cp25(c: Chain) -> DataFrame:
    one = c.ev.agg(F.count(F.lit(1)).alias("a_events"), F.count_if("is_first_event").alias("b_first"), F.count_if(F.col("is_first_event") & ~F.col("no_window")).alias("c_window"))
    both = one.join(F.broadcast(c.sets.where("role = 'control'").agg(F.countDistinct("set_id").alias("d_in_sets"))))
    return both.unpivot([], both.columns, "stage", "n")


@query("cp26_event_curve", sql("SELECT m.role, g.activity_date - (f.discharge_date + CAST(m.day AS INTEGER)) AS rel_day, count(*) AS n_days, count(CASE WHEN g.is_analyzable THEN g.steps END) AS n_observed, round(median(CASE WHEN g.is_analyzable THEN g.steps / f.baseline_steps END), 6) AS median_ratio, round(avg(coalesce(g.wear_minutes, 0)), 6) AS mean_wear FROM sets m JOIN features f USING (episode_id) JOIN grid g ON g.person_id = m.person_id AND g.activity_date BETWEEN f.discharge_date + CAST(m.day AS INTEGER) - 14 AND f.discharge_date + CAST(m.day AS INTEGER) + 7 GROUP BY 1, 2", "sets", "grid"))
def cp26(c: Chain) -> DataFrame:
    return rounded(events.event_curve(c.sets, c.features, c.grid), "median_ratio", "mean_wear")


@query("cp27_set_model_frame", sql(_EXPOSURE.format(good=_GOOD, least=P.least_window_days, lo=P.reference[0], hi=P.reference[1]), "sets", "grid"))
def cp27(c: Chain) -> DataFrame:
    return rounded(events.member_exposure(c.sets, c.features, c.grid, P.reference, P.least_window_days), "ratio").select("set_id", "episode_id", "role", "n_valid", "ratio")


@query("cp28_negative_control", sql("SELECT * FROM (" + _EXPOSURE.format(good=_GOOD, least=P.least_window_days, lo=P.control[0], hi=P.control[1]) + ") x WHERE x.set_id IN (SELECT set_id FROM sets WHERE role = 'case' AND day > 8)", "sets", "grid"))
def cp28(c: Chain) -> DataFrame:
    late = c.sets.where("role = 'case' AND day > 8").select("set_id")
    m = c.sets.join(late, "set_id", "left_semi")
    return rounded(events.member_exposure(m, c.features, c.grid, P.control, P.least_window_days), "ratio").select("set_id", "episode_id", "role", "n_valid", "ratio")


@query("cp29_discrete_time_panel", sql("SELECT l.episode_id, l.post_day, l.n_valid, l.has_landmark, CASE WHEN l.post_day = x.first_event THEN 1 ELSE 0 END AS outcome FROM lm l LEFT JOIN (SELECT episode_id, min(event_day) AS first_event FROM ev GROUP BY episode_id) x USING (episode_id) WHERE NOT l.is_censored AND (x.first_event IS NULL OR l.post_day <= x.first_event)", "lm"))
def cp29(c: Chain) -> DataFrame:
    return events.discrete_time_panel(c.lm, c.ev).drop("person_id")


@query("cp30_model_panel", sql("SELECT dense_rank() OVER (ORDER BY episode_id) AS unit_index, post_day, round(deficit, 6) AS deficit FROM panel WHERE in_accrual_window", "panel"))
def cp30(c: Chain) -> DataFrame:
    from panelwise.operators.groups import with_surrogate

    return rounded(with_surrogate(c.panel.where("in_accrual_window"), "episode_id", "unit_index"), "deficit").select("unit_index", "post_day", "deficit")
