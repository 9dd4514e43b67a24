"""Episodes from coded records, and their eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import earliest_of, first_fail, is_in_ci
from panelwise.operators.aggregates import hierarchical_score
from panelwise.operators.joins import contained_join, in_list, latest_first, neighbours, window_join
from panelwise.params import CohortParams

AMBULATORY = ("ambulatory clinic", "outpatient", "home")
#: Joins and groups by episode name the person first: tables in buckets of the person then meet where they lie.
BY_PERSON = ("person_id", "episode_id")


def episodes(records: DataFrame, codes: DataFrame, visits: DataFrame) -> DataFrame:
    """One episode per person and date of coded records, with its class, region, flags, index stay,
    length of stay and sequence number. The code list is small and broadcast by its measured size."""
    b = (records.join(codes, "code").groupBy("person_id", F.col("procedure_date").alias("index_date")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(~F.col("is_add_on")).alias("n_primary_records"),
        F.bool_or(F.col("procedure_class") == "fusion").alias("is_fusion"), F.bool_or(F.col("region") == "cervical").alias("_c"), F.bool_or(F.col("region") == "lumbar").alias("_l"),
        F.bool_or(F.col("region") == "thoracic").alias("_t"), F.array_sort(F.collect_set("visit_occurrence_id")).alias("visit_ids")))
    region = F.when(F.col("_c") & F.col("_l"), "cervical_and_lumbar").when(F.col("_c"), "cervical").when(F.col("_l"), "lumbar").when(F.col("_t"), "thoracic").otherwise("unspecified")
    key = F.format_string("%d-%s", F.col("person_id"), F.date_format("index_date", "yyyyMMdd"))
    b = b.withColumns({"region": region, "episode_id": key}).drop("_c", "_l", "_t")
    stays = visits.where("visit_kind = 'inpatient'").select("person_id", F.col("visit_occurrence_id").alias("index_visit_id"), "visit_start_date", "visit_end_date")
    inside = contained_join(b.select("episode_id", "person_id", "index_date", "visit_ids"), stays, "person_id", "index_date", "visit_start_date", "visit_end_date")
    pick = latest_first(inside, BY_PERSON, [in_list(F.col("index_visit_id"), F.col("visit_ids")).desc(), F.col("visit_start_date").desc(), F.col("index_visit_id").asc()])
    pick = pick.select(*BY_PERSON, "index_visit_id", F.coalesce("visit_end_date", "visit_start_date").alias("discharge_date"))
    seq = Window.partitionBy("person_id").orderBy("index_date")
    out = b.join(pick, list(BY_PERSON), "left").select(*[c for c in b.columns], "index_visit_id", "discharge_date")
    return out.withColumns({"los_days": F.datediff("discharge_date", "index_date"), "episode_seq": F.row_number().over(seq)})


def look_back_flags(ep: DataFrame, conditions: DataFrame, categories: list[str], days: int) -> DataFrame:
    """For each episode whether a condition of each category lies in the ``days`` before it."""
    c = window_join(ep.select("episode_id", "person_id", "index_date"), conditions.select("person_id", "condition_start_date", "category"), "person_id", "index_date", "condition_start_date", -days, 0)
    return c.groupBy("episode_id").agg(*[F.bool_or(F.coalesce(F.col("category") == x, F.lit(False))).alias(f"ind_{x}") for x in categories])


def emergency_before(ep: DataFrame, visits: DataFrame, days: int) -> DataFrame:
    """Episodes with an emergency visit that ended 0..days before the index date, and those visits."""
    v = visits.where("visit_kind = 'emergency'").select("person_id", "visit_occurrence_id", F.coalesce("visit_end_date", "visit_start_date").alias("_end"))
    near = window_join(ep.select("episode_id", "person_id", "index_date"), v, "person_id", "index_date", "_end", -days, 0)
    return near.groupBy("episode_id").agg(F.array_sort(F.collect_set("visit_occurrence_id")).alias("ed_visit_ids"), F.lit(True).alias("has_ed"))


def censoring(ep: DataFrame, deaths: DataFrame, observation: DataFrame, cutoff: Column | None = None, prior_days: int | None = None) -> DataFrame:
    """The first of death, a repeat episode after discharge and the end of observation, with its cause. With ``prior_days``
    also the person, and whether another episode lies in the days before (``has_prior``)."""
    nxt = neighbours(ep, "person_id", "episode_id", "index_date", "discharge_date", prior_days or 1, keep_on=True).withColumnRenamed("next_date", "repeat_date")
    c = ep.select("episode_id", "person_id").join(deaths, "person_id", "left").join(observation, "person_id", "left").join(nxt, list(BY_PERSON), "left")
    end = F.col("observation_period_end_date") if cutoff is None else F.coalesce("observation_period_end_date", cutoff)
    date, why = earliest_of([("death", F.col("death_date")), ("repeat_operation", F.col("repeat_date")), ("observation_end", end)])
    more = ["person_id", "has_prior"] if prior_days else []
    return c.select("episode_id", "death_date", "repeat_date", date.alias("censor_date"), why.alias("censor_reason"), *more)


def eligibility(ep: DataFrame, base: DataFrame, conditions: DataFrame, visits: DataFrame, deaths: DataFrame, observation: DataFrame, grid: DataFrame, p: CohortParams, cens: DataFrame | None = None) -> DataFrame:
    """Thirteen exclusion flags, null taken as false, the first that fails, and the first-eligible rule.

    What the rules look back on is gathered as rows of (person, episode) and folded by one aggregate, so a task
    holds few sorted tables at once. ``cens``: ``censoring`` with ``prior_days``, if it is at hand.
    """
    by = list(BY_PERSON)
    cens = censoring(ep, deaths, observation, prior_days=p.prior_days) if cens is None else cens
    key = ep.select(*by, "index_date")
    c = window_join(key, conditions.where("category IS NOT NULL").select("person_id", "condition_start_date", "category"), "person_id", "index_date", "condition_start_date", -max(p.look_back, p.prior_days), 0)
    grave = {f"ind_{x}": (F.col("category") == x) & (F.col("rel_day") >= -p.look_back) for x in ("trauma", "malignancy", "spinal_infection")}
    deg = (F.col("category") == "degenerative") & F.col("rel_day").between(-p.prior_days, -1)
    v = visits.where("visit_kind = 'emergency'").select("person_id", F.coalesce("visit_end_date", "visit_start_date").alias("_end"))
    ed = window_join(key, v, "person_id", "index_date", "_end", -p.ed_days, 0)
    origin = ep.select(*by, "index_visit_id").join(visits.select("person_id", F.col("visit_occurrence_id").alias("index_visit_id"), "origin"), ["person_id", "index_visit_id"])
    days = cens.select(*by, "censor_date").join(ep.select(*by, "discharge_date").where("discharge_date IS NOT NULL"), by)
    wear = window_join(days, grid.select("person_id", "activity_date", "is_analyzable"), "person_id", "discharge_date", "activity_date", *p.accrual).where("censor_date IS NULL OR activity_date <= censor_date")
    flags = ("ind_trauma", "ind_malignancy", "ind_spinal_infection", "deg_before", "has_ed", "elective_origin")
    seen = (c.select(*by, *[x.alias(n) for n, x in grave.items()], deg.alias("deg_before"))
            .unionByName(ed.select(*by, F.lit(True).alias("has_ed")), allowMissingColumns=True)
            .unionByName(origin.select(*by, is_in_ci(F.col("origin"), AMBULATORY).alias("elective_origin")), allowMissingColumns=True)
            .unionByName(wear.select(*by, F.lit(1).alias("n_at_risk_days"), F.col("is_analyzable").cast("int").alias("n_analyzable_days")), allowMissingColumns=True))
    seen = seen.groupBy(*by).agg(*[F.bool_or(n).alias(n) for n in flags], *[F.sum(n).alias(n) for n in ("n_at_risk_days", "n_analyzable_days")])
    e = ep.join(base.select(*by, "baseline_steps", "n_valid_baseline_days", "baseline_span_days", "has_any_wearable"), by).join(cens, by, "left").join(seen, by, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    e = e.withColumns({"n_at_risk_days": zero("n_at_risk_days"), "n_analyzable_days": zero("n_analyzable_days")})
    early = F.coalesce(F.col("censor_reason").isin("death", "repeat_operation") & (F.col("censor_date") <= F.date_add("discharge_date", p.accrual[1])), F.lit(False))
    x = {
        "x_indication": yes("ind_trauma") | yes("ind_malignancy") | yes("ind_spinal_infection"),
        "x_ed_not_elective": yes("has_ed") & ~(yes("elective_origin") | yes("deg_before")),
        "x_prior_operation": yes("has_prior"),
        "x_two_regions": F.col("region") == "cervical_and_lumbar",
        "x_unspecified": F.col("region") == "unspecified",
        "x_thoracic": F.col("region") == "thoracic",
        "x_add_on_only": F.col("n_primary_records") == 0,
        "x_no_discharge": F.col("discharge_date").isNull(),
        "x_no_wearable": ~F.col("has_any_wearable"),
        "x_baseline": F.col("baseline_steps").isNull() | (F.col("n_valid_baseline_days") < p.least_baseline_days) | (F.col("baseline_span_days") < p.least_baseline_span),
    }
    e = e.withColumns(x)
    passes = F.lit(True)
    for name in x:
        passes = passes & ~F.col(name)
    running = Window.partitionBy("person_id").orderBy("index_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("_passes", passes).withColumn("_rank", F.sum(F.col("_passes").cast("int")).over(running))
    e = e.withColumns({"x_not_first": F.col("_passes") & (F.col("_rank") > 1), "x_no_window": (F.col("n_analyzable_days") == 0) | (F.col("n_at_risk_days") == 0), "x_truncated": early})
    names = [*x, "x_not_first", "x_no_window", "x_truncated"]
    step, slug = first_fail([(i, n.removeprefix("x_"), F.col(n)) for i, n in enumerate(names, 3)])
    return e.drop("_passes", "_rank", "has_ed").withColumns({"first_fail_step": step, "first_fail": slug}).withColumn("is_eligible", F.col("first_fail_step").isNull())


LADDER = ("indication", "ed_not_elective", "prior_operation", "two_regions", "unspecified", "thoracic", "add_on_only", "no_discharge", "no_wearable", "baseline", "not_first", "no_window", "truncated")


def features(elig: DataFrame, persons: DataFrame, p: CohortParams, only_eligible: bool = True) -> DataFrame:
    """Age and the last day at risk (0..panel_days) of eligible episodes (or all with a discharge)."""
    e = elig.where("is_eligible") if only_eligible else elig.where("discharge_date IS NOT NULL AND baseline_steps > 0")
    last = F.greatest(F.lit(0), F.least(F.lit(p.panel_days), F.coalesce(F.datediff("censor_date", "discharge_date"), F.lit(p.panel_days))))
    return (e.join(persons, "person_id", "left").select("episode_id", "person_id", "index_date", "discharge_date", "los_days", "region", "is_fusion", "baseline_steps",
            F.round(F.datediff("index_date", "birth_date") / 365.25, 6).alias("age"), "sex", last.alias("at_risk_last_day")))


#: Comorbidity weights and which category takes the place of which (inputs of ``full_features``).
WEIGHTS = {"malignancy": 2, "trauma": 6, "spinal_infection": 3, "degenerative": 1}
TRUMPS = {"trauma": "malignancy", "spinal_infection": "degenerative"}
#: A measurement outside this range is an error of transcription.
PLAUSIBLE = (10, 80)


def full_features(elig: DataFrame, persons: DataFrame, base: DataFrame, conditions: DataFrame, measurements: DataFrame, devices: DataFrame, p: CohortParams, era: tuple[str, str], days: int = 365) -> DataFrame:
    """The covariates of eligible episodes: comorbidity score and its ordinal, the nearest plausible measurement
    with the median in place of a missing one, the device family at baseline and whether it changed, year, era,
    week-part baselines, the share of the window observed and the last day at risk.

    Each look-back is one join on the person; a score or flag that no row supports says so in its own column.
    """
    e = features(elig, persons, p).join(elig.select("episode_id", "n_analyzable_days", "n_at_risk_days", "censor_reason"), "episode_id")
    key = e.select("episode_id", "person_id", "index_date", "discharge_date")
    hits = window_join(key.drop("discharge_date"), conditions.select("person_id", "condition_start_date", "category"), "person_id", "index_date", "condition_start_date", -days, 0)
    score = hierarchical_score(hits, "episode_id", "category", WEIGHTS, TRUMPS).select("episode_id", "score")
    near = window_join(key.drop("discharge_date"), measurements.where(F.col("value_as_number").between(*PLAUSIBLE)), "person_id", "index_date", "measurement_date", -days, 0)
    value = latest_first(near, ["episode_id"], [F.desc("measurement_date"), F.asc("measurement_id")]).select("episode_id", F.col("value_as_number").alias("bmi"))
    middle = value.agg(F.median("bmi").alias("_median"))
    family = devices.select("person_id", "device_date", F.regexp_extract(F.upper("model"), "[A-Z]+", 0).alias("family"))
    lo = -p.look_back
    seen = window_join(key, family, "person_id", "index_date", "device_date", lo, p.panel_days * 3)
    at_base = seen.where("rel_day <= 0").groupBy("episode_id", "family").agg(F.count(F.lit(1)).alias("n"), F.max("device_date").alias("last"))
    mode = latest_first(at_base, ["episode_id"], [F.desc("n"), F.desc("last"), F.asc("family")]).select("episode_id", F.col("family").alias("device_family"))
    changed = seen.where(F.col("device_date") <= F.date_add("discharge_date", p.panel_days)).groupBy("episode_id").agg((F.countDistinct("family") > 1).alias("device_changed"))
    parts = base.select("episode_id", "n_valid_baseline_days", "baseline_band", "meets_baseline_floor", *[f"{a}_{w}" for w in ("weekday", "weekend") for a in ("baseline_steps", "n_valid_baseline_days")])
    for part in (score, value, mode, changed, parts):
        e = e.join(part, "episode_id", "left")
    points = F.coalesce("score", F.lit(0))
    width = p.accrual[1] - p.accrual[0] + 1
    return e.join(F.broadcast(middle)).withColumns({
        "score_missing": F.col("score").isNull(), "score_ordinal": F.when(points >= 3, "3_or_more").otherwise(points.cast("string")), "bmi_missing": F.col("bmi").isNull(), "bmi_imputed": F.coalesce("bmi", "_median"),
        "index_year": F.year("index_date"), "in_era": F.col("index_date").between(*[F.lit(x).cast("date") for x in era]), "device_family": F.coalesce("device_family", F.lit("other_or_unknown")), "device_changed": F.coalesce("device_changed", F.lit(False)),
        "share_window_observed": F.col("n_analyzable_days") / width, "near_complete_window": F.col("n_analyzable_days") >= 0.8 * width}).withColumn("score", points).drop("_median")
