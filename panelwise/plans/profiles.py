"""Profiling, invariants, reconciliation (Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import RULES, band
from panelwise.operators import aggregates as A
from panelwise.operators import ledgers
from panelwise.operators.joins import orphans, reconcile
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query


def _long(pairs: dict[str, str], source: str) -> str:
    return "SELECT rule, n_broken FROM (SELECT " + ", ".join(f"count_if(NOT coalesce({e}, FALSE)) AS {n}" for n, e in pairs.items()) + f" FROM {source}) UNPIVOT (n_broken FOR rule IN ({', '.join(pairs)}))"


def _rules(pairs: dict[str, str]) -> dict:
    return {n: F.expr(e) for n, e in pairs.items()}


@query("q01_zone_partition", sql("SELECT count(*) AS n_days, count_if(total > 1440) AS n_over, count_if(n <> n_labels) AS n_repeated, count_if(nulls > 0) AS n_null, count_if(total = 0) AS n_zero FROM (SELECT person_id, date, sum(minute_in_zone) AS total, count(*) AS n, count(DISTINCT zone) AS n_labels, count_if(minute_in_zone IS NULL) AS nulls FROM zones GROUP BY ALL)", "zones"))
def q01(c: Chain) -> DataFrame:
    d = c.zones.groupBy("person_id", "date").agg(F.sum("minute_in_zone").alias("total"), F.count(F.lit(1)).alias("n"), F.countDistinct("zone").alias("n_labels"), F.count_if(F.col("minute_in_zone").isNull()).alias("nulls"))
    return d.agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("total") > 1440).alias("n_over"), F.count_if(F.col("n") != F.col("n_labels")).alias("n_repeated"), F.count_if(F.col("nulls") > 0).alias("n_null"), F.count_if(F.col("total") == 0).alias("n_zero"))


@query("q02_concept_distribution", sql("SELECT k.code, coalesce(c.region, 'unknown') AS region, count(*) AS n_rows, count(DISTINCT k.person_id) AS n_persons FROM conditions k LEFT JOIN codes c ON c.code = k.code AND c.is_add_on GROUP BY ALL", "conditions", "codes"))
def q02(c: Chain) -> DataFrame:
    j = c.conditions.join(c.codes.where("is_add_on").select("code", "region"), "code", "left")
    return j.groupBy("code", F.coalesce("region", F.lit("unknown")).alias("region")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("person_id").alias("n_persons"))


@query("q03_column_coverage", "SELECT 'event_type' AS \"column\", count(*) AS n, count_if(event_type IS NULL) AS n_null, count_if(event_type = '') AS n_empty, count(DISTINCT event_type) AS n_distinct, count_if(regexp_matches(event_type, '^[a-e]')) AS n_matched FROM events UNION ALL SELECT 'props', count(*), count_if(props IS NULL), count_if(props = ''), count(DISTINCT props), count_if(regexp_matches(props, '^[a-e]')) FROM events")
def q03(c: Chain) -> DataFrame:
    return A.column_coverage(c.spark.read.parquet(f"{c.sf}/events.parquet"), ["event_type", "props"], "^[a-e]")


@query("q04_value_distribution", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 50")
def q04(c: Chain) -> DataFrame:
    d = c.spark.read.parquet(f"{c.sf}/documents.parquet")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("lang"), F.asc_nulls_last("source")).limit(50)


@query("q05_presence_matrix", sql("SELECT seg, CASE WHEN wear_minutes IS NULL THEN 'none' WHEN wear_minutes = 0 THEN 'zero' ELSE 'some' END AS minutes, CASE WHEN steps IS NULL THEN 'none' WHEN steps = 0 THEN 'zero' ELSE 'some' END AS activity, count(*) AS n, count_if(is_analyzable) AS n_analyzable FROM (SELECT *, unnest([CAST(is_weekend AS VARCHAR), 'all']) AS seg FROM grid) GROUP BY ALL", "grid"))
def q05(c: Chain) -> DataFrame:
    state = lambda x: F.when(F.col(x).isNull(), "none").when(F.col(x) == 0, "zero").otherwise("some")
    d = A.with_all(c.grid.withColumn("seg", F.col("is_weekend").cast("string")), "seg")
    return d.groupBy("seg", state("wear_minutes").alias("minutes"), state("steps").alias("activity")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_analyzable").alias("n_analyzable"))


@query("q06_rule_agreement", sql("SELECT rule, valid_wear AS effective, flag, count(*) AS n FROM (SELECT valid_wear, unnest(['s1', 's2', 's3', 's4']) AS rule, unnest([valid_wear_s1, valid_wear_s2, valid_wear_s3, valid_wear_s4]) AS flag FROM grid) GROUP BY ALL", "grid"))
def q06(c: Chain) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"valid_wear_{r}").alias("flag")) for r in RULES if r != "primary"]))
    return c.grid.select(F.col("valid_wear").alias("effective"), pairs.alias("x")).groupBy("x.rule", "effective", "x.flag").agg(F.count(F.lit(1)).alias("n"))


@query("q07_baseline_distribution", sql("SELECT baseline_band, CAST(unnest(range(1, 8)) AS BIGINT) AS dow, unnest(baseline_dow_counts) AS n_days, episode_id FROM baseline", "baseline"))
def q07(c: Chain) -> DataFrame:
    return c.baseline.select("episode_id", "baseline_band", F.posexplode("baseline_dow_counts").alias("p", "n_days")).withColumn("dow", (F.col("p") + 1).cast("long")).drop("p")


_Q8 = {"band_only_with_value": "(baseline_steps IS NULL) = (baseline_band IS NULL)", "never_zero_for_missing": "n_valid_baseline_days > 0 OR baseline_steps IS NULL", "span_at_least_days": "baseline_span_days >= n_valid_baseline_days", "looser_rule_not_fewer": "n_valid_baseline_days_s3 >= n_valid_baseline_days", "stricter_rule_not_more": "n_valid_baseline_days_s4 <= n_valid_baseline_days", "week_parts_add_up": "n_valid_baseline_days_weekday + n_valid_baseline_days_weekend = n_valid_baseline_days"}


@query("q08_baseline_invariants", sql(_long(_Q8, "baseline"), "baseline"))
def q08(c: Chain) -> DataFrame:
    return A.invariants(c.baseline, _rules(_Q8))


_Q9 = {"deficit_only_if_observed": "(deficit IS NOT NULL) = (day_kind = 'observed')", "deficit_in_range": "deficit IS NULL OR deficit BETWEEN 0 AND 1", "zero_steps_is_one": "steps IS NULL OR steps <> 0 OR deficit IS NULL OR deficit = 1", "no_lag_on_first_day": "(post_day = 1) = (lagged_wear_fraction IS NULL)", "censored_not_observed": "NOT (is_censored AND is_analyzable)", "day_in_panel": f"post_day BETWEEN 1 AND {P.panel_days}"}


@query("q09_panel_invariants", sql(_long(_Q9, "panel"), "panel"))
def q09(c: Chain) -> DataFrame:
    return A.invariants(c.panel, _rules(_Q9))


@query("q10_panel_guards", sql("SELECT count(*) AS n_rows, count(DISTINCT concat(episode_id, '/', post_day)) AS n_keys, count_if(baseline_steps IS NULL OR baseline_steps <= 0) AS n_bad_baseline FROM panel", "panel"))
def q10(c: Chain) -> DataFrame:
    return c.panel.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("episode_id", "post_day").alias("n_keys"), F.count_if(F.col("baseline_steps").isNull() | (F.col("baseline_steps") <= 0)).alias("n_bad_baseline"))


@query("q11_availability_reconciled", sql("SELECT unnest(['only_a', 'only_b', 'differs_n_analyzable']) AS metric, unnest([count_if(b.post_day IS NULL), count_if(a.post_day IS NULL), count_if(a.n <> b.n)]) AS n FROM (SELECT post_day, sum(n) AS n FROM (SELECT post_day, region, dayofweek(calendar_date) IN (0, 6) AS wk, count_if(is_analyzable) AS n FROM panel GROUP BY ALL) GROUP BY post_day) a FULL JOIN (SELECT post_day, sum(CAST(is_analyzable AS INTEGER)) AS n FROM panel GROUP BY post_day) b USING (post_day)", "panel"))
def q11(c: Chain) -> DataFrame:
    ledger = ledgers.availability_by_day(c.panel.withColumn("wk", F.col("day_of_week").isin(1, 7)), "region", "wk").where("region = 'all' AND wk = 'all'").select("post_day", "n_analyzable")
    direct = c.panel.groupBy("post_day").agg(F.count_if("is_analyzable").alias("n_analyzable"))
    return reconcile(ledger, direct, ["post_day"], ["n_analyzable"])


@query("q12_day_kind_crosstab", sql("SELECT day_kind, day_kind_four, valid_wear, is_inpatient, in_accrual_window, count(*) AS n FROM panel GROUP BY ALL", "panel"))
def q12(c: Chain) -> DataFrame:
    return c.panel.groupBy("day_kind", "day_kind_four", "valid_wear", "is_inpatient", "in_accrual_window").agg(F.count(F.lit(1)).alias("n"))


@query("q13_lag_bands", sql("SELECT CASE WHEN lagged_wear_fraction IS NULL THEN NULL WHEN lagged_wear_fraction < 0.25 THEN 'a' WHEN lagged_wear_fraction < 0.75 THEN 'b' ELSE 'c' END AS band, count(*) AS n, count_if(is_analyzable) AS n_analyzable FROM panel GROUP BY ALL", "panel"))
def q13(c: Chain) -> DataFrame:
    return c.panel.groupBy(band(F.col("lagged_wear_fraction"), [0.25, 0.75], ["a", "b", "c"]).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_analyzable").alias("n_analyzable"))


@query("q14_landmark_conditions", sql("SELECT event_kind, is_first_event, count(*) AS n, count_if(has_landmark) AS n_landmark, count_if(no_window) AS n_no_window, count_if(no_signal) AS n_no_signal, min(event_day) AS first_day FROM ev GROUP BY ALL", "ev"))
def q14(c: Chain) -> DataFrame:
    return c.ev.groupBy("event_kind", "is_first_event").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_landmark").alias("n_landmark"), F.count_if("no_window").alias("n_no_window"), F.count_if("no_signal").alias("n_no_signal"), F.min("event_day").alias("first_day"))


_Q15 = {"one_state": "CAST(has_landmark AS INT) + CAST(no_window AS INT) + CAST(no_signal AS INT) = 1", "valid_within_days": "n_valid <= n_days", "three_days_at_most": "n_days <= 3", "early_days_have_no_window": "post_day > 4 OR no_window", "lag_in_range": "landmark_lag IS NULL OR landmark_lag BETWEEN 0 AND 1"}


@query("q15_landmark_invariants", sql(_long(_Q15, "lm"), "lm"))
def q15(c: Chain) -> DataFrame:
    return A.invariants(c.lm, _rules(_Q15))


@query("q16_landmark_by_day", sql("SELECT post_day, has_landmark, is_censored, count(*) AS n, count_if(is_event) AS n_events FROM lm GROUP BY ALL", "lm"))
def q16(c: Chain) -> DataFrame:
    return c.lm.groupBy("post_day", "has_landmark", "is_censored").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_event").alias("n_events"))


@query("q17_set_shape", sql("SELECT \"check\", n FROM (SELECT count_if(cases <> 1) AS not_one_case, count_if(controls > 5) AS too_many_controls, count_if(controls = 0) AS no_controls, (SELECT count_if(k > 3) FROM (SELECT count(*) AS k FROM sets WHERE role = 'control' GROUP BY person_id)) AS person_too_often FROM (SELECT set_id, count_if(role = 'case') AS cases, count_if(role = 'control') AS controls FROM sets GROUP BY set_id)) UNPIVOT (n FOR \"check\" IN (not_one_case, too_many_controls, no_controls, person_too_often))", "sets"))
def q17(c: Chain) -> DataFrame:
    return ledgers.set_problems(c.sets, P)


@query("q18_member_checks", sql("SELECT role, match_rung, count(*) AS n, count(DISTINCT person_id) AS n_persons, count_if(day <= 4) AS n_early FROM sets GROUP BY ALL", "sets"))
def q18(c: Chain) -> DataFrame:
    return c.sets.groupBy("role", "match_rung").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("n_persons"), F.count_if(F.col("day") <= 4).alias("n_early"))


@query("q19_control_participation", sql("SELECT k AS times, count(*) AS n_persons FROM (SELECT person_id, count(*) AS k FROM sets WHERE role = 'control' GROUP BY person_id) GROUP BY k", "sets"))
def q19(c: Chain) -> DataFrame:
    return c.sets.where("role = 'control'").groupBy("person_id").agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("n_persons"))


@query("q21_sums_to_total", sql("SELECT person_id, parts, total FROM (SELECT person_id, CAST(sum(minute_in_zone) AS BIGINT) AS parts, CAST(max(minute_in_zone) * 5 AS BIGINT) AS total FROM zones GROUP BY person_id) WHERE parts IS DISTINCT FROM total", "zones"))
def q21(c: Chain) -> DataFrame:
    top = c.zones.groupBy("person_id").agg((F.max("minute_in_zone") * 5).alias("total"))
    return A.sums_to_total(c.zones.join(top, "person_id"), ["person_id"], "minute_in_zone", "total")


_LADDER = "(SELECT step, coalesce(k, 0) AS n_dropped, total - sum(coalesce(k, 0)) OVER (ORDER BY step) + coalesce(k, 0) AS n_in, total - sum(coalesce(k, 0)) OVER (ORDER BY step) AS n_out FROM (SELECT unnest(range(3, 16)) AS step) s LEFT JOIN (SELECT first_fail_step AS step, count(*) AS k FROM elig GROUP BY ALL) USING (step), (SELECT count(*) AS total FROM elig))"


@query("q22_ladder_problems", sql(f"SELECT CAST(step AS INTEGER) AS step, problem FROM (SELECT step, unnest(['closes', 'carries', 'not_negative', 'falls']) AS problem, unnest([n_in - n_dropped = n_out, coalesce(lag(n_out) OVER (ORDER BY step), n_in) = n_in, least(n_in, n_dropped, n_out) >= 0, n_out <= n_in]) AS holds FROM {_LADDER}) WHERE NOT holds", "elig"))
def q22(c: Chain) -> DataFrame:
    return ledgers.ladder_problems(ledgers.attrition(c.elig))


_Q23 = {"code_known": "code BETWEEN 0 AND 99", "label_given": "region IS NOT NULL", "class_given": "procedure_class IN ('fusion', 'other')"}


@query("q23_code_assertions", sql(_long(_Q23, "(SELECT * FROM records LEFT JOIN codes USING (code))"), "records", "codes"))
def q23(c: Chain) -> DataFrame:
    return A.invariants(c.records.join(c.codes, "code", "left"), _rules(_Q23))


@query("q24_rate_per_1000", sql("SELECT region, round(1000.0 * count_if(e.event_id IS NOT NULL) / count(*), 4) AS rate FROM features f LEFT JOIN ev e ON e.episode_id = f.episode_id AND e.is_first_event GROUP BY region", "ev"))
def q24(c: Chain) -> DataFrame:
    first = c.ev.where("is_first_event").select("episode_id", "event_id")
    j = c.features.join(first, "episode_id", "left")
    return j.groupBy("region").agg(F.round(F.try_divide(1000.0 * F.count("event_id"), F.count(F.lit(1))), 4).alias("rate"))


_Q25 = {"effective_is_rule": "valid_wear = (wear_minutes IS NOT NULL AND wear_minutes BETWEEN 600 AND 1440)", "analyzable_is_valid": "NOT is_analyzable OR (valid_wear AND steps IS NOT NULL)", "s4_within_primary": "NOT valid_wear_s4 OR valid_wear"}


@query("q25_rule_sets", sql(_long(_Q25, "grid"), "grid"))
def q25(c: Chain) -> DataFrame:
    return A.invariants(c.grid, _rules(_Q25))


@query("q26_outcome_by_state", sql("SELECT CASE WHEN has_landmark THEN 'computable' WHEN no_window THEN 'no_window' ELSE 'no_signal' END AS state, n_valid, count(*) AS n, count_if(is_first) AS n_first FROM lm WHERE NOT is_censored GROUP BY ALL", "lm"))
def q26(c: Chain) -> DataFrame:
    state = F.when(F.col("has_landmark"), "computable").when(F.col("no_window"), "no_window").otherwise("no_signal")
    return c.lm.where("NOT is_censored").groupBy(state.alias("state"), "n_valid").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_first").alias("n_first"))


@query("q27_panel_summary", sql("SELECT has_landmark, n, round(crude, 6) AS crude, round(std, 6) AS standardised FROM (SELECT has_landmark, sum(n) AS n, sum(e) / sum(n) AS crude, sum(w * e / n) / sum(w) AS std FROM (SELECT post_day, has_landmark, count(*) AS n, count_if(is_event) AS e FROM lm WHERE NOT is_censored GROUP BY ALL) JOIN (SELECT post_day, count(*) AS w FROM lm WHERE NOT is_censored GROUP BY ALL) USING (post_day) GROUP BY has_landmark)", "lm"))
def q27(c: Chain) -> DataFrame:
    from panelwise.operators.estimators import standardised_rates

    d = c.lm.where("NOT is_censored").withColumn("y", F.col("is_event").cast("int"))
    return rounded(standardised_rates(d, F.col("post_day"), "has_landmark", "y"), "crude", "standardised")


@query("q28_set_size_quantiles", sql("SELECT count(*) AS n, quantile_cont(k, 0.25) AS q1, median(k) AS median, quantile_cont(k, 0.75) AS q3 FROM (SELECT set_id, count_if(role = 'control') AS k FROM sets GROUP BY set_id)", "sets"))
def q28(c: Chain) -> DataFrame:
    return A.weighted_quantiles(ledgers.set_size_ledger(c.sets), [], "n_controls", "n_sets")


@query("q29_gate_monotone", sql("SELECT CAST(count_if(n > before) AS INTEGER) AS n_rising FROM (SELECT n, lag(n) OVER (ORDER BY stage) AS before FROM (SELECT 1 AS stage, count(*) AS n FROM ev UNION ALL SELECT 2, count(DISTINCT episode_id) FROM ev UNION ALL SELECT 3, count(*) FROM ev WHERE event_rank = 1 AND n_days >= 2 UNION ALL SELECT 4, count(DISTINCT set_id) FROM sets WHERE role <> 'case'))", "ev", "sets"))
def q29(c: Chain) -> DataFrame:
    from panelwise.plans.cohort import cp25

    w = Window.orderBy("stage")
    return cp25(c).withColumn("last", F.lag("n").over(w)).agg(F.count_if(F.col("n") > F.col("last")).cast("int").alias("n_rising"))


@query("q30_segment_closure", sql("SELECT person_id, n_records AS start, kept + dropped AS parts, (n_records + 10) // 20 * 20 - ((kept + 10) // 20 * 20 + (dropped + 10) // 20 * 20) AS residual FROM (SELECT person_id, count(*) AS n_records, count_if(is_add_on) AS dropped, count_if(NOT is_add_on) AS kept FROM records JOIN codes USING (code) GROUP BY person_id)", "records", "codes"))
def q30(c: Chain) -> DataFrame:
    near = lambda x: F.floor((F.col(x) + 10) / 20) * 20
    g = c.records.join(c.codes, "code").groupBy("person_id").agg(F.count(F.lit(1)).alias("start"), F.count_if("is_add_on").alias("d"), F.count_if(~F.col("is_add_on")).alias("k"))
    return g.select("person_id", "start", (F.col("k") + F.col("d")).alias("parts"), (near("start") - near("k") - near("d")).alias("residual"))


@query("q31_category_profile", sql("SELECT visit_kind, count(*) AS n, count(*) > 0 AS present, count_if(origin = 'Emergency Room') > 0 AS acute FROM visits GROUP BY visit_kind", "visits"))
def q31(c: Chain) -> DataFrame:
    return c.visits.groupBy("visit_kind").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("present"), (F.count_if(F.col("origin") == "Emergency Room") > 0).alias("acute"))


@query("e25_join_guard", sql("SELECT count(*) AS n FROM panel WHERE episode_id NOT IN (SELECT episode_id FROM episodes) OR (deficit IS NOT NULL AND day_kind <> 'observed')", "panel"))
def e25(c: Chain) -> DataFrame:
    lost = orphans(c.panel.select("episode_id"), c.episodes, ["episode_id"]).agg(F.count(F.lit(1)).alias("a"))
    wrong = c.panel.agg(F.count_if(F.col("deficit").isNotNull() & (F.col("day_kind") != "observed")).alias("b"))
    return lost.join(F.broadcast(wrong)).select((F.col("a") + F.col("b")).alias("n"))
