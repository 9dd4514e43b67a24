"""The cohort's derived tables over the stand-ins, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators import daily, episodes, events
from panelwise.params import SCALED as P
from panelwise.plans.fits import newton_sql
from panelwise.sources import adapters as A
from panelwise.sources.shared import stored, stored_by


#: Derived tables that many queries read: each is built once for a session and folder, written to
#: the shared folder and read back, as the build of the reference tables does. The inputs are taken not to
#: change within a session; a table that has gone from its folder is built again.
_STORED = ("episodes", "minutes", "grid", "baseline", "cens", "elig", "features", "panel", "ev", "lm", "sets")
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


#: The largest side of a join that a query of the chain sends round, in bytes of its files.
BROADCAST = 1 << 20


def _bytes(size: str) -> int:
    """A size of Spark's settings in bytes."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


class Chain:
    """The derived tables for one folder, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir
        # The tables lie in buckets of the person, which serve joins on the person and more columns as well.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # So they need no broadcast, which would send to the driver whatever lies under Spark's bound in each join.
        if _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) > BROADCAST:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _MAKERS:
            raise AttributeError(name)
        made = self._stored(name) if name in _STORED else _MAKERS[name](self)
        setattr(self, name, made)
        return made

    def _stored(self, name: str) -> DataFrame:
        return self.kept(name, lambda: _MAKERS[name](self))

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is made once for the session and folder. It lies in buckets of the person, if it has one, so that
        joins and groups by person read it without an exchange."""
        key = (self.spark.sparkContext.applicationId, self.sf, name)
        if key not in _TABLES or not _there(self.spark, _TABLES[key]):
            made = make()
            _TABLES[key] = stored_by(made, "person_id", f"cohort_{name}") if "person_id" in made.columns else stored(made, f"cohort-{name}")
        return _TABLES[key]


def _there(spark: SparkSession, table: DataFrame) -> bool:
    """Whether a stored table is still in its folder."""
    files = table.inputFiles()
    if not files:
        return True  # empty: nothing to lose
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_MAKERS = {
    "zones": lambda c: A.zone_minutes(c.spark, c.sf),
    "activity": lambda c: A.activity(c.spark, c.sf),
    "records": lambda c: A.procedures(c.spark, c.sf),
    "codes": lambda c: A.code_set(c.spark),
    "visits": lambda c: A.visits(c.spark, c.sf),
    "conditions": lambda c: A.conditions(c.spark, c.sf),
    "measurements": lambda c: A.measurements(c.spark, c.sf),
    "devices": lambda c: A.devices(c.spark, c.sf),
    "observation": lambda c: A.observation(c.spark, c.sf),
    "deaths": lambda c: A.deaths(c.spark, c.sf),
    "persons": lambda c: A.persons(c.spark, c.sf),
    "episodes": lambda c: episodes.episodes(c.records, c.codes, c.visits),
    "spans": lambda c: daily.spans_of(c.episodes, -P.baseline_early[0], P.panel_days),
    "minutes": lambda c: daily.daily_minutes(c.zones, c.spans, 1.0),
    "grid": lambda c: daily.person_day_grid(c.spans, c.activity, c.minutes, P.rule),
    "baseline": lambda c: daily.baseline(c.episodes, c.grid, P),
    "cens": lambda c: episodes.censoring(c.episodes, c.deaths, c.observation, prior_days=P.prior_days),
    "elig": lambda c: episodes.eligibility(c.episodes, c.baseline, c.conditions, c.visits, c.deaths, c.observation, c.grid, P, c.cens),
    "features": lambda c: episodes.features(c.elig, c.persons, P, only_eligible=False),
    "panel": lambda c: daily.day_panel(c.features.select("episode_id", "person_id", "discharge_date", "los_days", "baseline_steps", "at_risk_last_day", "region"), c.grid, c.visits.where("visit_kind = 'inpatient'").select("person_id", "visit_start_date", "visit_end_date"), P),
    "ev": lambda c: events.events(c.features, c.visits, c.grid, P),
    "lm": lambda c: events.landmark_panel(c.panel, c.ev, c.grid, P),
    "sets": lambda c: events.risk_sets(c.features, c.ev, P, order="pair"),
}

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

#: name -> (tables it reads, its SQL)
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "zones": ((), "SELECT user_id AS person_id, CAST(ts AS DATE) AS date, event_type AS zone, CAST(round(value * 6) AS BIGINT) AS minute_in_zone FROM events"),
    "activity": ((), f"SELECT user_id AS person_id, CAST(ts AS DATE) AS date, CAST(sum({_K}) * 100 AS BIGINT) AS steps FROM events WHERE event_type <> 'error' GROUP BY ALL"),
    "records": ((), f"SELECT user_id AS person_id, CAST(ts AS DATE) AS procedure_date, event_id AS visit_occurrence_id, {_K} AS code FROM events WHERE event_type = 'purchase' AND value >= 60"),
    "codes": ((), "SELECT k AS code, CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS vocabulary, CASE WHEN k >= 50 THEN 'fusion' ELSE 'other' END AS procedure_class, CASE WHEN k % 11 = 10 THEN 'unspecified' WHEN k % 3 = 0 THEN 'cervical' WHEN k % 3 = 1 THEN 'lumbar' ELSE 'thoracic' END AS region, k % 7 = 0 AS is_add_on FROM range(100) AS r(k)"),
    "visits": ((), f"SELECT event_id AS visit_occurrence_id, user_id AS person_id, CASE WHEN event_type = 'signup' THEN 'inpatient' ELSE 'emergency' END AS visit_kind, CAST(ts AS DATE) AS visit_start_date, CASE WHEN event_id % 13 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) END AS visit_end_date, CASE WHEN {_K} % 5 = 0 THEN 'Ambulatory Clinic' WHEN {_K} % 5 = 1 THEN 'Home' ELSE 'Emergency Room' END AS origin FROM events WHERE event_type IN ('signup', 'error')"),
    "conditions": ((), f"SELECT user_id AS person_id, CAST(ts AS DATE) AS condition_start_date, event_id AS condition_id, {_K} AS code, CASE WHEN {_K} < 6 THEN 'trauma' WHEN {_K} < 10 THEN 'malignancy' WHEN {_K} < 12 THEN 'spinal_infection' WHEN {_K} BETWEEN 25 AND 60 THEN 'degenerative' END AS category FROM events WHERE event_type = 'click'"),
    "measurements": ((), f"SELECT event_id AS measurement_id, user_id AS person_id, CAST(ts AS DATE) AS measurement_date, CAST({_K} AS DOUBLE) AS value_as_number FROM events WHERE event_type = 'view'"),
    "devices": ((), f"SELECT user_id AS person_id, CAST(ts AS DATE) AS device_date, concat(upper(event_type), ' ', {_K}) AS model FROM events"),
    "observation": ((), "SELECT user_id AS person_id, max(CAST(ts AS DATE)) AS observation_period_end_date FROM events GROUP BY user_id"),
    "deaths": (("observation",), "SELECT person_id, observation_period_end_date AS death_date FROM observation WHERE person_id % 37 = 0"),
    "persons": (("observation",), "SELECT person_id, DATE '1940-01-01' + CAST(person_id * 97 % 18000 AS INTEGER) AS birth_date, CASE WHEN person_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM observation"),
    "bundles": (("records", "codes"), "SELECT person_id, procedure_date AS index_date, count(*) AS n_records, count_if(NOT is_add_on) AS n_primary_records, bool_or(procedure_class = 'fusion') AS is_fusion, CASE WHEN bool_or(region = 'cervical') AND bool_or(region = 'lumbar') THEN 'cervical_and_lumbar' WHEN bool_or(region = 'cervical') THEN 'cervical' WHEN bool_or(region = 'lumbar') THEN 'lumbar' WHEN bool_or(region = 'thoracic') THEN 'thoracic' ELSE 'unspecified' END AS region, list_sort(list(DISTINCT visit_occurrence_id)) AS visit_ids, concat(person_id, '-', strftime(procedure_date, '%Y%m%d')) AS episode_id FROM records JOIN codes USING (code) GROUP BY person_id, procedure_date"),
    "stays": (("bundles", "visits"), "SELECT * FROM (SELECT b.episode_id, v.visit_occurrence_id AS index_visit_id, coalesce(v.visit_end_date, v.visit_start_date) AS discharge_date, row_number() OVER (PARTITION BY b.episode_id ORDER BY list_contains(b.visit_ids, v.visit_occurrence_id) DESC, v.visit_start_date DESC, v.visit_occurrence_id) AS rn FROM bundles b JOIN visits v ON v.person_id = b.person_id AND v.visit_kind = 'inpatient' AND b.index_date BETWEEN v.visit_start_date AND coalesce(v.visit_end_date, v.visit_start_date)) WHERE rn = 1"),
    "episodes": (("bundles", "stays"), "SELECT b.*, s.index_visit_id, s.discharge_date, s.discharge_date - b.index_date AS los_days, row_number() OVER (PARTITION BY b.person_id ORDER BY b.index_date) AS episode_seq FROM bundles b LEFT JOIN stays s USING (episode_id)"),
    "spans": (("episodes",), f"SELECT person_id, min(index_date) - {-P.baseline_early[0]} AS lo, max(coalesce(discharge_date, index_date)) + {P.panel_days} AS hi FROM episodes GROUP BY person_id"),
    "minutes": (("zones", "spans"), "SELECT z.person_id, z.date, CAST(sum(minute_in_zone) AS BIGINT) AS wear_minutes, max(minute_in_zone) AS largest_zone, count(minute_in_zone) AS n_zones FROM zones z JOIN spans s ON s.person_id = z.person_id AND z.date BETWEEN s.lo AND s.hi GROUP BY z.person_id, z.date"),
    "grid": (("spans", "activity", "minutes"), "SELECT d.person_id, d.activity_date, a.steps, m.wear_minutes, coalesce(m.wear_minutes BETWEEN 600 AND 1440, FALSE) AS valid_wear, coalesce(m.wear_minutes BETWEEN 576 AND 1440, FALSE) AS valid_wear_s1, coalesce(m.wear_minutes BETWEEN 600 AND 1440 AND coalesce(a.steps, 0) >= 100, FALSE) AS valid_wear_s2, coalesce(m.wear_minutes BETWEEN 480 AND 1440, FALSE) AS valid_wear_s3, coalesce(m.wear_minutes BETWEEN 720 AND 1440, FALSE) AS valid_wear_s4, coalesce(m.wear_minutes BETWEEN 600 AND 1440, FALSE) AND a.steps IS NOT NULL AS is_analyzable, dayofweek(d.activity_date) + 1 AS day_of_week, dayofweek(d.activity_date) IN (0, 6) AS is_weekend FROM (SELECT person_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS activity_date FROM spans WHERE person_id IN (SELECT person_id FROM activity UNION SELECT person_id FROM minutes)) d LEFT JOIN activity a ON a.person_id = d.person_id AND a.date = d.activity_date LEFT JOIN minutes m ON m.person_id = d.person_id AND m.date = d.activity_date"),
}


def _baseline_sql() -> str:
    def w(win, flag, extra=""):  # noqa: ANN001, ANN202
        return f"rel_day BETWEEN {win[0]} AND {win[1]} AND {flag} AND steps IS NOT NULL{extra}"

    main = w(P.baseline, "valid_wear")
    named = {"weekday": w(P.baseline, "valid_wear", " AND day_of_week NOT IN (1, 7)"), "weekend": w(P.baseline, "valid_wear", " AND day_of_week IN (1, 7)"), "early": w(P.baseline_early, "valid_wear"), "late": w(P.baseline_late, "valid_wear")}
    named |= {r: w(P.baseline, f"valid_wear_{r}") for r in ("s1", "s2", "s3", "s4")}
    parts = ", ".join(f"median(CASE WHEN {c} THEN steps END) AS baseline_steps_{n}, count_if({c}) AS n_valid_baseline_days_{n}" for n, c in named.items())
    dow = ", ".join(f"count_if({main} AND day_of_week = {i})" for i in range(1, 8))
    return f"""SELECT a.*, CASE WHEN baseline_steps IS NULL THEN NULL WHEN baseline_steps < {P.bands[0]} THEN 'under_{P.bands[0]}' WHEN baseline_steps < {P.bands[1]} THEN '{P.bands[0]}_to_{P.bands[1] - 1}' ELSE '{P.bands[1]}_or_more' END AS baseline_band,
  baseline_steps >= {P.baseline_floor} AS meets_baseline_floor, person_id IN (SELECT person_id FROM grid) AS has_any_wearable FROM (
  SELECT episode_id, person_id, index_date, median(CASE WHEN {main} THEN steps END) AS baseline_steps, count_if({main}) AS n_valid_baseline_days,
  coalesce(max(CASE WHEN {main} THEN activity_date END) - min(CASE WHEN {main} THEN activity_date END) + 1, 0) AS baseline_span_days, [{dow}] AS baseline_dow_counts, {parts}
  FROM (SELECT e.episode_id, e.person_id, e.index_date, g.activity_date, g.steps, g.day_of_week, g.valid_wear, g.valid_wear_s1, g.valid_wear_s2, g.valid_wear_s3, g.valid_wear_s4, g.activity_date - e.index_date AS rel_day
        FROM episodes e LEFT JOIN grid g ON g.person_id = e.person_id AND g.activity_date BETWEEN e.index_date - {-min(P.baseline[0], P.baseline_early[0])} AND e.index_date - 1)
  GROUP BY episode_id, person_id, index_date) a"""


_SQL["baseline"] = (("episodes", "grid"), _baseline_sql())
_SQL["cens"] = (("episodes", "deaths", "observation"), "SELECT episode_id, death_date, repeat_date, least(death_date, repeat_date, observation_period_end_date) AS censor_date, CASE WHEN least(death_date, repeat_date, observation_period_end_date) IS NULL THEN 'none' WHEN death_date = least(death_date, repeat_date, observation_period_end_date) THEN 'death' WHEN repeat_date = least(death_date, repeat_date, observation_period_end_date) THEN 'repeat_operation' ELSE 'observation_end' END AS censor_reason FROM (SELECT e.episode_id, d.death_date, o.observation_period_end_date, (SELECT min(x.index_date) FROM episodes x WHERE x.person_id = e.person_id AND x.index_date > coalesce(e.discharge_date, e.index_date)) AS repeat_date FROM episodes e LEFT JOIN deaths d USING (person_id) LEFT JOIN observation o USING (person_id))")
#: The exclusion rules in the order of the ladder, which begins at step 3.
_RULES = {
    "indication": "ind", "ed_not_elective": "ed AND NOT coalesce(clinic, FALSE) AND NOT coalesce(deg, FALSE)", "prior_operation": "prior",
    "two_regions": "region = 'cervical_and_lumbar'", "unspecified": "region = 'unspecified'", "thoracic": "region = 'thoracic'", "add_on_only": "n_primary_records = 0",
    "no_discharge": "discharge_date IS NULL", "no_wearable": "NOT has_any_wearable",
    "baseline": f"baseline_steps IS NULL OR n_valid_baseline_days < {P.least_baseline_days} OR baseline_span_days < {P.least_baseline_span}",
}
_LATE = {"no_window": "least(n_at_risk_days, n_analyzable_days) = 0", "truncated": f"coalesce(censor_reason IN ('death', 'repeat_operation') AND censor_date <= discharge_date + {P.accrual[1]}, FALSE)"}
_ORDER = [*_RULES, "not_first", *_LATE]
_SQL["looks"] = (("episodes", "conditions", "visits"), f"""
SELECT e.episode_id, coalesce(max(CAST(c.grave AS INTEGER)), 0) = 1 AS ind, coalesce(max(CAST(c.deg AS INTEGER)), 0) = 1 AS deg, coalesce(max(CAST(v.ed AS INTEGER)), 0) = 1 AS ed, coalesce(max(CAST(v.clinic AS INTEGER)), 0) = 1 AS clinic
FROM episodes e
LEFT JOIN LATERAL (SELECT bool_or(category <> 'degenerative' AND e.index_date - condition_start_date BETWEEN 0 AND {P.look_back}) AS grave, bool_or(category = 'degenerative' AND e.index_date - condition_start_date BETWEEN 1 AND {P.prior_days}) AS deg FROM conditions WHERE person_id = e.person_id AND category IS NOT NULL) c ON TRUE
LEFT JOIN LATERAL (SELECT bool_or(visit_kind = 'emergency' AND e.index_date - coalesce(visit_end_date, visit_start_date) BETWEEN 0 AND {P.ed_days}) AS ed, bool_or(visit_occurrence_id = e.index_visit_id AND origin IN ('Ambulatory Clinic', 'Home')) AS clinic FROM visits WHERE person_id = e.person_id) v ON TRUE
GROUP BY e.episode_id""")
_SQL["wear"] = (("episodes", "cens", "grid"), f"""
SELECT e.episode_id, count(*) AS n_at_risk_days, count_if(g.is_analyzable) AS n_analyzable_days
FROM episodes e, cens c, grid g
WHERE c.episode_id = e.episode_id AND g.person_id = e.person_id AND g.activity_date - e.discharge_date BETWEEN {P.accrual[0]} AND {P.accrual[1]} AND g.activity_date <= coalesce(c.censor_date, g.activity_date) GROUP BY e.episode_id""")
_SQL["elig"] = (("episodes", "baseline", "looks", "cens", "wear"), f"""
SELECT *, nullif(coalesce(list_position([{', '.join(f'x_{n}' for n in _ORDER)}], TRUE), 0), 0) + 2 AS first_fail_step
FROM (SELECT *, clear AND row_number() OVER (PARTITION BY person_id, clear ORDER BY index_date) > 1 AS x_not_first
 FROM (SELECT *, NOT list_contains([{', '.join(f'x_{n}' for n in _RULES)}], TRUE) AS clear
  FROM (SELECT *, {', '.join(f'{e} AS x_{n}' for n, e in (_RULES | _LATE).items())}
   FROM (SELECT e.*, b.baseline_steps, b.n_valid_baseline_days, b.baseline_span_days, b.has_any_wearable, l.ind, l.deg, l.ed, l.clinic, c.censor_date, c.censor_reason,
          coalesce(e.index_date - lag(e.index_date) OVER (PARTITION BY e.person_id ORDER BY e.index_date) <= {P.prior_days}, FALSE) AS prior,
          coalesce(w.n_at_risk_days, 0) AS n_at_risk_days, coalesce(w.n_analyzable_days, 0) AS n_analyzable_days
         FROM episodes e JOIN baseline b USING (episode_id) JOIN looks l USING (episode_id) JOIN cens c USING (episode_id) LEFT JOIN wear w USING (episode_id)))))""")
_SQL["features"] = (("elig", "persons"), f"SELECT e.episode_id, e.person_id, e.index_date, e.discharge_date, e.los_days, e.region, e.is_fusion, e.baseline_steps, round((e.index_date - p.birth_date) / 365.25, 6) AS age, p.sex, greatest(0, least({P.panel_days}, coalesce(e.censor_date - e.discharge_date, {P.panel_days}))) AS at_risk_last_day FROM elig e LEFT JOIN persons p USING (person_id) WHERE e.discharge_date IS NOT NULL AND e.baseline_steps > 0")
_SQL["in_hospital"] = (("visits",), "SELECT DISTINCT person_id, visit_start_date, CAST(unnest(generate_series(visit_start_date, coalesce(visit_end_date, visit_start_date), INTERVAL 1 DAY)) AS DATE) AS night FROM visits WHERE visit_kind = 'inpatient'")
_SQL["panel"] = (("features", "grid", "in_hospital"), f"""
WITH days AS (SELECT episode_id, person_id, discharge_date, los_days, baseline_steps, at_risk_last_day, region, unnest(range(1, {P.panel_days} + 1)) AS post_day FROM features),
stay AS (SELECT f.episode_id, h.night - f.discharge_date AS post_day FROM features f JOIN in_hospital h USING (person_id) WHERE h.visit_start_date - f.discharge_date BETWEEN 1 AND {P.panel_days} GROUP BY ALL),
seen AS (SELECT d.*, d.discharge_date + CAST(d.post_day AS INTEGER) AS calendar_date, d.los_days + d.post_day AS postoperative_day, d.post_day BETWEEN {P.accrual[0]} AND {P.accrual[1]} AS in_accrual_window,
  (d.episode_id, d.post_day) IN (SELECT (episode_id, post_day) FROM stay) AS is_inpatient, d.post_day > d.at_risk_last_day AS is_censored FROM days d),
worn AS (SELECT s.*, g.steps, g.wear_minutes, g.valid_wear IS TRUE AS valid_wear, NOT s.is_censored AND g.is_analyzable IS TRUE AS is_analyzable, CASE WHEN NOT s.is_censored AND g.is_analyzable THEN g.steps / s.baseline_steps END AS normalized_activity FROM seen s LEFT JOIN grid g ON (g.person_id, g.activity_date) = (s.person_id, s.calendar_date)),
named AS (SELECT *, CASE WHEN is_censored THEN 'censored' WHEN is_analyzable THEN 'observed' ELSE 'missing' END AS day_kind FROM worn)
SELECT *, CASE WHEN is_inpatient AND day_kind <> 'censored' THEN 'inpatient' ELSE day_kind END AS day_kind_four, 1 - normalized_activity AS deficit_untruncated, CASE WHEN normalized_activity IS NOT NULL THEN greatest(0, 1 - normalized_activity) END AS deficit,
 avg(CAST(valid_wear AS INTEGER)) OVER (PARTITION BY episode_id ORDER BY post_day ROWS BETWEEN {P.lag_days} PRECEDING AND 1 PRECEDING) AS lagged_wear_fraction
FROM named""")


def _good(lo: int, hi: int) -> str:
    return f"g.activity_date - k.event_date BETWEEN {lo} AND {hi} AND g.activity_date > k.discharge_date AND g.valid_wear AND g.steps IS NOT NULL"


_near = f"g.activity_date - k.event_date BETWEEN {P.landmark[0]} AND {P.landmark[1]} AND g.activity_date > k.discharge_date"
_SQL["enc"] = (("features", "visits"), """
SELECT episode_id, person_id, discharge_date, baseline_steps, event_date, event_date - discharge_date AS event_day, first_visit AS visit_occurrence_id,
 CASE len(kinds) WHEN 2 THEN 'ed_then_inpatient' ELSE replace(kinds[1], 'emergency', 'emergency_department') END AS event_kind
FROM (SELECT f.episode_id, f.person_id, f.discharge_date, f.baseline_steps, v.visit_start_date AS event_date, min(v.visit_occurrence_id) AS first_visit, list(DISTINCT v.visit_kind) AS kinds,
       count_if(v.origin NOT IN ('Ambulatory Clinic', 'Home') OR v.visit_start_date - f.discharge_date > f.at_risk_last_day) AS unplanned
      FROM features f JOIN visits v USING (person_id) WHERE v.visit_start_date > f.discharge_date GROUP BY ALL)
WHERE unplanned > 0""")
_SQL["ev"] = (("enc", "grid"), f"""
SELECT *, event_rank = 1 AS is_first_event, n_valid >= {P.least_window_days} AS has_landmark, n_days < {P.least_window_days} AS no_window, n_days >= {P.least_window_days} AND n_valid < {P.least_window_days} AS no_signal,
 near_steps / baseline_steps AS r_near, last_steps / baseline_steps AS r_last, reference_steps / baseline_steps AS r_reference, control_steps / baseline_steps AS r_control, CASE WHEN near_steps > 0 AND reference_steps > 0 THEN ln(near_steps / reference_steps) END AS local_change
FROM (SELECT k.episode_id, k.person_id, k.discharge_date, k.baseline_steps, k.event_date, k.event_day, k.visit_occurrence_id, k.event_kind, concat(k.episode_id, '-', strftime(k.event_date, '%Y%m%d')) AS event_id, row_number() OVER (PARTITION BY k.episode_id ORDER BY k.event_date) AS event_rank,
 k.event_day + {P.landmark[1]} AS landmark_day, dayofweek(k.event_date - {-P.landmark[1]}) + 1 AS landmark_dow, median(CASE WHEN {_good(*P.landmark)} THEN g.steps END) AS near_steps, count_if({_good(*P.landmark)}) AS n_valid, count_if({_near}) AS n_days, avg(CASE WHEN {_near} THEN coalesce(g.wear_minutes, 0) / 1440 END) AS wear_fraction,
 median(CASE WHEN {_good(-3, -1)} THEN g.steps END) AS last_steps, median(CASE WHEN {_good(*P.reference)} THEN g.steps END) AS reference_steps, median(CASE WHEN {_good(*P.control)} THEN g.steps END) AS control_steps
 FROM enc k LEFT JOIN grid g ON g.person_id = k.person_id AND g.activity_date BETWEEN k.event_date - {-P.control[0]} AND k.event_date - 1
 GROUP BY k.episode_id, k.person_id, k.discharge_date, k.baseline_steps, k.event_date, k.event_day, k.visit_occurrence_id, k.event_kind)""")
_SQL["weeks"] = (("grid",), f"SELECT person_id, activity_date AS last_day, avg(CAST(valid_wear AS DOUBLE)) OVER week AS calendar_lag, count(*) OVER week AS n_calendar_days FROM grid WINDOW week AS (PARTITION BY person_id ORDER BY activity_date ROWS BETWEEN {P.lag_days - 1} PRECEDING AND CURRENT ROW)")
_SQL["lm"] = (("panel", "weeks", "ev"), f"""
WITH counted AS (SELECT episode_id, person_id, post_day, calendar_date, is_censored, count(*) FILTER (WHERE valid_wear AND steps IS NOT NULL) OVER before AS n_valid, count(*) OVER before AS n_days, max(lagged_wear_fraction) OVER landmark AS landmark_lag
 FROM panel WINDOW before AS (PARTITION BY episode_id ORDER BY post_day RANGE BETWEEN {-P.landmark[0]} PRECEDING AND {-P.landmark[1]} PRECEDING), landmark AS (PARTITION BY episode_id ORDER BY post_day RANGE BETWEEN {-P.landmark[1]} PRECEDING AND {-P.landmark[1]} PRECEDING)),
marks AS (SELECT episode_id, map(list(event_day), list(is_first_event)) AS at FROM (SELECT episode_id, event_day, bool_or(is_first_event) AS is_first_event FROM ev GROUP BY ALL) GROUP BY episode_id)
SELECT c.*, w.calendar_lag, coalesce(w.n_calendar_days, 0) AS n_calendar_days, coalesce(map_contains(m.at, c.post_day), FALSE) AS is_event, coalesce(m.at[c.post_day], FALSE) AS is_first,
 n_valid >= {P.least_window_days} AS has_landmark, n_days < {P.least_window_days} AS no_window, n_valid < {P.least_window_days} AND n_days >= {P.least_window_days} AS no_signal
FROM counted c LEFT JOIN weeks w ON w.person_id = c.person_id AND w.last_day = c.calendar_date - {1 - P.landmark[1]} LEFT JOIN marks m USING (episode_id)""")
#: A candidacy's rank is 1 on the case's day and weekday, 2 on a day of the same part of the week, else
#: 3. A set takes the candidates up to its second best rank: the strictest that leaves two of them.
_SQL["sets"] = (("features", "ev"), f"""
WITH cases AS (SELECT event_id AS set_id, episode_id AS own, person_id, event_day, landmark_dow FROM ev WHERE is_first_event AND NOT no_window),
free AS (SELECT f.episode_id, f.person_id, f.discharge_date, least(f.at_risk_last_day, min(e.event_day) - 1) AS last_day FROM features f LEFT JOIN ev e USING (episode_id) GROUP BY f.episode_id, f.person_id, f.discharge_date, f.at_risk_last_day),
offers AS (SELECT set_id, episode_id, person_id, day, abs(day - event_day) AS gap, md5(concat_ws('|', '{P.salt}', '{P.seed}', set_id, episode_id, day)) AS fingerprint,
  CASE WHEN day = event_day AND dow = landmark_dow THEN 1 WHEN (dow % 6 = 1) = (landmark_dow % 6 = 1) THEN 2 ELSE 3 END AS rank
 FROM (SELECT c.set_id, c.event_day, c.landmark_dow, p.episode_id, p.person_id, t.day, 1 + dayofweek(p.discharge_date + CAST(t.day + {P.landmark[1]} AS INTEGER)) AS dow
       FROM cases c JOIN range(1, {P.panel_days} + 1) t(day) ON t.day BETWEEN c.event_day - 2 AND c.event_day + 2 JOIN free p ON p.last_day >= t.day AND p.episode_id <> c.own)),
best AS (SELECT set_id, unnest(arg_min(o, (rank, gap, fingerprint))) FROM (SELECT set_id, episode_id, person_id, rank, gap, fingerprint, {{'episode_id': episode_id, 'person_id': person_id, 'day': day, 'rank': rank, 'fingerprint': fingerprint}} AS o FROM offers) GROUP BY set_id, episode_id),
allowed AS (SELECT set_id, coalesce(list_sort(list(rank))[2], 3) AS match_rung FROM best GROUP BY set_id),
taken AS (SELECT b.*, a.match_rung FROM best b JOIN allowed a ON a.set_id = b.set_id AND b.rank <= a.match_rung QUALIFY row_number() OVER (PARTITION BY b.set_id ORDER BY b.fingerprint) <= {P.per_set})
SELECT set_id, 'case' AS role, own AS episode_id, person_id, event_day AS day, 1 AS match_rung FROM cases
UNION ALL FROM (SELECT set_id, 'control', episode_id, person_id, day, match_rung FROM taken QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY fingerprint) <= {P.per_person})""")


_SQL["days"] = (("panel", "features"), "SELECT p.*, p.wear_minutes / 1440.0 AS w, (p.post_day - 5) / 5.0 AS day, CAST(dayofweek(p.calendar_date) IN (0, 6) AS DOUBLE) AS weekend, CAST(f.is_fusion AS DOUBLE) AS fusion, CAST(p.is_analyzable AS DOUBLE) AS y FROM panel p JOIN features f ON f.episode_id = p.episode_id WHERE p.in_accrual_window AND NOT p.is_censored")
_SQL["observed_fit"] = (("days",), newton_sql("days", ["1", "day", "weekend"], "y"))
_SQL["weighted"] = (("days", "observed_fit"), "SELECT *, CASE WHEN is_analyzable THEN greatest(quantile_cont(raw, 0.01) OVER (), least(quantile_cont(raw, 0.99) OVER (), raw)) END AS weight FROM (SELECT *, CASE WHEN is_analyzable THEN avg(y) OVER (PARTITION BY region) / observed END AS raw FROM (SELECT d.*, 1 / (1 + exp(-(b0 + b1 * day + b2 * weekend))) AS observed FROM days d, observed_fit))")
_SQL["deficit_fit"] = (("weighted",), newton_sql("weighted WHERE deficit IS NOT NULL", ["1", "day", "fusion"], "deficit", "weight"))
_SQL["fitted"] = (("weighted", "deficit_fit"), "SELECT w.*, 1 / (1 + exp(-(b0 + b1 * day + b2 * fusion))) AS pred FROM weighted w, deficit_fit")


def with_tables(body: str, *names: str) -> str:
    """``body`` behind the common table expressions of the named tables and all they read."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _SQL[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_SQL[n][1]})" for n in order) + "\n" + body


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
