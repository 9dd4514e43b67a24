"""Projections, predicates, generators and scalar functions (PF, G, D, S, M, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions import columns as K
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query

_RULES = (("A", "12", False, "exact_twelve"), ("A", "3", True, "thirties"), ("B", "7", True, "seventies"))


@query("pf01_classify_codes", sql("SELECT CASE WHEN vocabulary = 'A' AND CAST(code AS VARCHAR) = '12' THEN 'exact_twelve' WHEN vocabulary = 'A' AND substr(CAST(code AS VARCHAR), 1, 1) = '3' THEN 'thirties' WHEN vocabulary = 'B' AND substr(CAST(code AS VARCHAR), 1, 1) = '7' THEN 'seventies' END AS label, count(*) AS n FROM records JOIN codes USING (code) GROUP BY ALL", "records", "codes"))
def pf01(c: Chain) -> DataFrame:
    return c.records.join(c.codes, "code").groupBy(K.classify_code(F.col("vocabulary"), F.col("code").cast("string"), _RULES).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("pf02_alternate_map", sql("SELECT code, region AS primary_label, CASE WHEN region = 'thoracic' THEN 'lumbar' ELSE region END AS mirrored_label, region = 'thoracic' AS moved FROM codes WHERE code IN (SELECT code FROM records)", "records", "codes"))
def pf02(c: Chain) -> DataFrame:
    mirrored = F.when(F.col("region") == "thoracic", "lumbar").otherwise(F.col("region"))
    used = c.codes.join(c.records, "code", "left_semi")
    return used.select("code", F.col("region").alias("primary_label"), mirrored.alias("mirrored_label"), (mirrored != F.col("region")).alias("moved"))


@query("pf03_set_filter", sql("SELECT code, count(*) AS n FROM records WHERE code IN (3, 5, 8, 13, 21, 34, 55, 89) OR substr(CAST(code AS VARCHAR), 1, 1) = '4' GROUP BY code", "records"))
def pf03(c: Chain) -> DataFrame:
    return c.records.where(F.col("code").isin(3, 5, 8, 13, 21, 34, 55, 89) | (F.substring(F.col("code").cast("string"), 1, 1) == "4")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("pf04_regex_class", sql("SELECT CASE WHEN regexp_matches(model, '^(VIEW|CLICK) ') THEN 'passive' WHEN regexp_matches(model, 'ERR') THEN 'error' ELSE 'other' END AS class, count(*) AS n FROM devices GROUP BY ALL", "devices"))
def pf04(c: Chain) -> DataFrame:
    cls = F.when(F.col("model").rlike("^(VIEW|CLICK) "), "passive").when(F.col("model").rlike("ERR"), "error").otherwise("other")
    return c.devices.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("pf05_is_in_ci", sql("SELECT visit_kind, lower(coalesce(origin, '')) IN ('home', 'ambulatory clinic') AS ambulatory, count(*) AS n FROM visits GROUP BY ALL", "visits"))
def pf05(c: Chain) -> DataFrame:
    return c.visits.groupBy("visit_kind", K.is_in_ci(F.col("origin"), ("HOME", "Ambulatory Clinic")).alias("ambulatory")).agg(F.count(F.lit(1)).alias("n"))


@query("pf06_valid_day", sql("SELECT count_if(valid_wear) AS primary_n, count_if(valid_wear_s1) AS s1, count_if(valid_wear_s2) AS s2, count_if(valid_wear_s3) AS s3, count_if(valid_wear_s4) AS s4, count(*) AS n FROM grid", "grid"))
def pf06(c: Chain) -> DataFrame:
    ok = lambda r: F.count_if(K.valid_day(F.col("wear_minutes"), F.col("steps"), r))
    return c.grid.agg(ok("primary").alias("primary_n"), ok("s1").alias("s1"), ok("s2").alias("s2"), ok("s3").alias("s3"), ok("s4").alias("s4"), F.count(F.lit(1)).alias("n"))


@query("pf07_bands", sql("SELECT CASE WHEN steps IS NULL THEN NULL WHEN steps < 5000 THEN 'low' WHEN steps < 15000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM grid GROUP BY ALL", "grid"))
def pf07(c: Chain) -> DataFrame:
    return c.grid.groupBy(K.band(F.col("steps"), [5000, 15000], ["low", "middle", "high"]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("pf08_day_window_label", sql(f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN g.activity_date BETWEEN e.index_date + ({P.baseline[0]}) AND e.index_date + ({P.baseline[1]}) THEN 'baseline' WHEN g.activity_date BETWEEN e.discharge_date + {P.accrual[0]} AND e.discharge_date + {P.accrual[1]} THEN 'accrual' WHEN g.activity_date BETWEEN e.discharge_date + {P.accrual[1] + 1} AND e.discharge_date + {P.panel_days} THEN 'tail' ELSE 'outside' END AS label FROM episodes e JOIN grid g USING (person_id)) GROUP BY label", "grid"))
def pf08(c: Chain) -> DataFrame:
    j = c.episodes.join(c.grid, "person_id")
    label = K.day_window_label(F.col("activity_date"), F.col("index_date"), F.col("discharge_date"), P.baseline, P.accrual, P.panel_days)
    return j.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("pf09_first_fail", sql("SELECT first_fail_step, count(*) AS n FROM elig GROUP BY ALL", "elig"))
def pf09(c: Chain) -> DataFrame:
    return c.elig.groupBy("first_fail_step").agg(F.count(F.lit(1)).alias("n"))


@query("pf10b_all_but_whole", sql("SELECT * EXCLUDE (zone) FROM zones", "zones"))
def pf10b(c: Chain) -> DataFrame:
    """All columns but one of every zone row."""
    return c.zones.drop("zone")


@query("pf11_plausible_range", sql("SELECT count(*) AS n, count_if(value_as_number BETWEEN 10 AND 80) AS n_plausible FROM measurements", "measurements"))
def pf11(c: Chain) -> DataFrame:
    return c.measurements.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value_as_number").between(10, 80)).alias("n_plausible"))


@query("pf12_earliest_of", sql("SELECT censor_reason, count(*) AS n, min(censor_date) AS first_date FROM cens GROUP BY ALL", "cens"))
def pf12(c: Chain) -> DataFrame:
    from panelwise.operators.episodes import censoring

    return censoring(c.episodes, c.deaths, c.observation).groupBy("censor_reason").agg(F.count(F.lit(1)).alias("n"), F.min("censor_date").alias("first_date"))


@query("pf13_clamp", sql("SELECT episode_id, greatest(0, least(10, coalesce(los_days, 10))) AS days FROM episodes", "episodes"))
def pf13(c: Chain) -> DataFrame:
    return c.episodes.select("episode_id", K.clamp(F.col("los_days"), 0, 10, 10).alias("days"))


@query("pf14_deficit", sql("SELECT person_id, activity_date, round(CASE WHEN wear_minutes > 0 THEN steps / wear_minutes END, 6) AS r, round(CASE WHEN wear_minutes > 0 AND steps IS NOT NULL THEN greatest(0, 1 - steps / wear_minutes) END, 6) AS d, round(CASE WHEN wear_minutes > 0 AND steps IS NOT NULL THEN 1 - steps / wear_minutes END, 6) AS u FROM grid", "grid"))
def pf14(c: Chain) -> DataFrame:
    s, w = F.col("steps"), F.col("wear_minutes")
    return c.grid.select("person_id", "activity_date", F.round(K.ratio(s, w), 6).alias("r"), F.round(K.deficit(s, w), 6).alias("d"), F.round(K.deficit(s, w, False), 6).alias("u"))


@query("g1_date_sequence", sql("SELECT person_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM spans", "spans"))
def g1(c: Chain) -> DataFrame:
    return c.spans.select("person_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))


@query("g2_number_sequence", sql("SELECT episode_id, unnest(generate_series(-2, 2)) AS k FROM episodes", "episodes"))
def g2(c: Chain) -> DataFrame:
    return c.episodes.select("episode_id", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("k"))


@query("g3_with_offset", sql("SELECT episode_id, unnest(visit_ids) AS visit_id, unnest(range(len(visit_ids))) AS pos FROM episodes", "episodes"))
def g3(c: Chain) -> DataFrame:
    return c.episodes.select("episode_id", F.posexplode("visit_ids").alias("pos", "visit_id"))


@query("g4_arrays", sql("SELECT person_id, len(list(code)) AS n, list_sort(list(code))[1] AS first, list_sort(list(code))[3] AS third, CAST(sum(code) AS BIGINT) AS total FROM records GROUP BY person_id", "records"))
def g4(c: Chain) -> DataFrame:
    a = c.records.groupBy("person_id").agg(F.array_sort(F.collect_list("code")).alias("a"))
    return a.select("person_id", F.size("a").alias("n"), F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(2)).alias("third"), F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query("d_dates", sql("SELECT person_id, activity_date, activity_date + 7 AS week_on, activity_date - 7 AS week_back, activity_date - DATE '2024-01-01' AS days, dayofweek(activity_date) + 1 AS dow, year(activity_date) AS y, strftime(activity_date, '%Y%m%d') AS ymd, activity_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AS era FROM grid", "grid"))
def d_dates(c: Chain) -> DataFrame:
    d = F.col("activity_date")
    return c.grid.select("person_id", d, F.date_add(d, 7).alias("week_on"), F.date_sub(d, 7).alias("week_back"), F.datediff(d, F.lit("2024-01-01")).alias("days"), F.dayofweek(d).alias("dow"), F.year(d).alias("y"), F.date_format(d, "yyyyMMdd").alias("ymd"), d.between(F.lit("2024-01-10"), F.lit("2024-01-20")).alias("era"))


@query("d4_age", sql("SELECT person_id, round((DATE '2024-01-15' - birth_date) / 365.25, 6) AS age FROM persons", "persons"))
def d4(c: Chain) -> DataFrame:
    return c.persons.select("person_id", F.round(K.age_years(F.col("birth_date"), F.lit("2024-01-15").cast("date")), 6).alias("age"))


@query("s2_device_family", sql("SELECT CASE WHEN regexp_extract(upper(coalesce(model, '')), '[A-Z]+') IN ('VIEW', 'CLICK') THEN regexp_extract(upper(model), '[A-Z]+') ELSE 'OTHER' END AS family, count(*) AS n FROM devices GROUP BY ALL", "devices"))
def s2(c: Chain) -> DataFrame:
    return c.devices.groupBy(K.leading_family(F.col("model"), ("VIEW", "CLICK")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("m1_safe_math", sql("SELECT person_id, date, round(CASE WHEN n_zones - 3 <> 0 THEN wear_minutes / (n_zones - 3) END, 6) AS q, TRY_CAST(concat(wear_minutes, CASE WHEN n_zones > 3 THEN 'x' ELSE '' END) AS BIGINT) AS c, wear_minutes % 7 AS m, wear_minutes // 7 AS d, abs(wear_minutes - 600) AS a, round(ln(nullif(wear_minutes, 0)), 6) AS l FROM minutes", "minutes"))
def m1(c: Chain) -> DataFrame:
    w, n = F.col("wear_minutes"), F.col("n_zones")
    text = F.concat(w.cast("string"), F.when(n > 3, "x").otherwise(""))
    return c.minutes.select("person_id", "date", F.round(F.try_divide(w, n - 3), 6).alias("q"), text.try_cast("bigint").alias("c"), (w % 7).alias("m"), F.expr("wear_minutes div 7").alias("d"), F.abs(w - 600).alias("a"), F.round(F.ln(F.nullif(w, F.lit(0))), 6).alias("l"))


@query("m3_log_ratio", sql("SELECT episode_id, round(CASE WHEN baseline_steps_late > 0 AND baseline_steps_early > 0 THEN ln(baseline_steps_late / baseline_steps_early) END, 6) AS lr FROM baseline", "baseline"))
def m3(c: Chain) -> DataFrame:
    return c.baseline.select("episode_id", F.round(K.log_ratio(F.col("baseline_steps_late"), F.col("baseline_steps_early")), 6).alias("lr"))


@query("m4_expit_logit", sql("SELECT episode_id, post_day, round(1 / (1 + exp(-normalized_activity)), 6) AS e, round(CASE WHEN deficit IS NOT NULL THEN ln(least(greatest(deficit, 1e-6), 1 - 1e-6) / (1 - least(greatest(deficit, 1e-6), 1 - 1e-6))) END, 5) AS l FROM panel", "panel"))
def m4(c: Chain) -> DataFrame:
    return c.panel.select("episode_id", "post_day", F.round(K.expit(F.col("normalized_activity")), 6).alias("e"), F.round(K.logit(F.col("deficit")), 5).alias("l"))


def _spline_sql(x: str, knots: tuple[float, ...]) -> list[str]:
    last, before, scale = knots[-1], knots[-2], (knots[-1] - knots[0]) ** 2
    cube = lambda t: f"pow(greatest({x} - {t}, 0), 3)"
    return [f"({cube(t)} - {cube(before)} * {(last - t) / (last - before)} + {cube(last)} * {(before - t) / (last - before)}) / {scale}" for t in knots[:-2]]


_KNOTS = (25.0, 40.0, 55.0, 75.0)


@query("m5_spline", sql(f"SELECT episode_id, round(age, 4) AS s0, round({_spline_sql('age', _KNOTS)[0]}, 4) AS s1, round({_spline_sql('age', _KNOTS)[1]}, 4) AS s2 FROM features", "features"))
def m5(c: Chain) -> DataFrame:
    return c.features.select("episode_id", *[F.round(s, 4).alias(f"s{i}") for i, s in enumerate(K.spline_basis(F.col("age"), _KNOTS))])


@query("h_md5_order", sql("SELECT episode_id, md5(concat_ws('|', 'panel', '1', episode_id)) AS fingerprint FROM episodes", "episodes"))
def h_md5(c: Chain) -> DataFrame:
    return c.episodes.select("episode_id", F.md5(F.concat_ws("|", F.lit("panel"), F.lit("1"), "episode_id")).alias("fingerprint"))
