"""Person-days: minutes, the dense grid, personal baselines, the panel after an anchor date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import DAY_MINUTES, RULES, band, deficit, ratio, valid_day
from panelwise.operators.joins import window_join
from panelwise.params import CohortParams


def daily_minutes(zones: DataFrame, spans: DataFrame, share: float = 0.05, column: str = "minute_in_zone") -> DataFrame:
    """Sum, largest and number of zone rows per person-day inside the person's span. Refuses if more
    than ``share`` of the person-days exceed a whole day (an action: it reads the result once)."""
    inside = zones.join(spans, "person_id").where(F.col("date").between(F.col("lo"), F.col("hi")))
    days = inside.groupBy("person_id", "date").agg(F.sum(column).alias("wear_minutes"), F.max(column).alias("largest_zone"), F.count(column).alias("n_zones"))
    if share < 1:
        r = days.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wear_minutes") > DAY_MINUTES).alias("over")).first()
        if r["n"] and r["over"] > share * r["n"]:
            raise ValueError(f"{r['over']} of {r['n']} person-days exceed {DAY_MINUTES} minutes")
    return days


def daily_category(devices: DataFrame | None, spans: DataFrame, column: str = "model") -> DataFrame:
    """The device models of a person-day; an empty table of the same type without a source column."""
    schema = "person_id bigint, device_date date, models array<string>"
    if devices is None or column not in devices.columns:
        return spans.sparkSession.createDataFrame([], schema)
    inside = devices.join(spans, "person_id").where(F.col("device_date").between(F.col("lo"), F.col("hi")))
    return inside.groupBy("person_id", "device_date").agg(F.array_sort(F.collect_set(column)).alias("models"))


def spans_of(episodes: DataFrame, before: int, after: int) -> DataFrame:
    return episodes.groupBy("person_id").agg(F.date_sub(F.min("index_date"), before).alias("lo"), F.date_add(F.max(F.coalesce("discharge_date", "index_date")), after).alias("hi"))


def person_day_grid(spans: DataFrame, activity: DataFrame, minutes: DataFrame, rule: str = "primary") -> DataFrame:
    """One row per linked person and day of the span; null where nothing was recorded. A day without
    minutes is never valid and a day without steps is not analyzable, though zero steps are."""
    linked = activity.select("person_id").union(minutes.select("person_id")).distinct()
    days = (spans.join(linked, "person_id", "left_semi").select("person_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("activity_date")))
    a = activity.select("person_id", F.col("date").alias("activity_date"), "steps")
    m = minutes.select("person_id", F.col("date").alias("activity_date"), "wear_minutes")
    g = days.join(a, ["person_id", "activity_date"], "left").join(m, ["person_id", "activity_date"], "left")
    flags = {("valid_wear" if r == "primary" else f"valid_wear_{r}"): valid_day(F.col("wear_minutes"), F.col("steps"), r) for r in RULES}
    g = g.withColumns(flags)
    effective = F.col("valid_wear" if rule == "primary" else f"valid_wear_{rule}")
    dow = F.dayofweek("activity_date")
    return g.withColumns({"is_analyzable": effective & F.col("steps").isNotNull(), "day_of_week": dow, "is_weekend": dow.isin(1, 7)})


def baseline(episodes: DataFrame, grid: DataFrame, p: CohortParams) -> DataFrame:
    """Medians and day counts of three windows, five validity rules and week parts, in one aggregate.
    A baseline without valid days is null, never 0."""
    lo = min(p.baseline[0], p.baseline_early[0], p.baseline_late[0])
    d = window_join(episodes.select("episode_id", "person_id", "index_date"), grid, "person_id", "index_date", "activity_date", lo, -1, "left")

    def days(window: tuple[int, int], flag: str, extra: Column | None = None) -> Column:
        c = F.col("rel_day").between(*window) & F.col(flag) & F.col("steps").isNotNull()
        return c if extra is None else c & extra

    def median(c: Column) -> Column:
        return F.median(F.when(c, F.col("steps")))

    main = days(p.baseline, "valid_wear")
    weekend = F.col("day_of_week").isin(1, 7)
    aggs = [median(main).alias("baseline_steps"), F.count_if(main).alias("n_valid_baseline_days"),
            F.coalesce(F.datediff(F.max(F.when(main, F.col("activity_date"))), F.min(F.when(main, F.col("activity_date")))) + 1, F.lit(0)).alias("baseline_span_days"),
            F.array(*[F.count_if(main & (F.col("day_of_week") == i)) for i in range(1, 8)]).alias("baseline_dow_counts")]
    named = {"weekday": days(p.baseline, "valid_wear", ~weekend), "weekend": days(p.baseline, "valid_wear", weekend), "early": days(p.baseline_early, "valid_wear"), "late": days(p.baseline_late, "valid_wear")}
    named |= {r: days(p.baseline, f"valid_wear_{r}") for r in RULES if r != "primary"}
    for name, c in named.items():
        aggs += [median(c).alias(f"baseline_steps_{name}"), F.count_if(c).alias(f"n_valid_baseline_days_{name}")]
    aggs.append(F.count("activity_date").alias("_seen"))
    out = d.groupBy("episode_id", "person_id", "index_date").agg(*aggs)
    linked = grid.select("person_id").distinct().withColumn("has_any_wearable", F.lit(True))
    low, high = p.bands
    slug = band(F.col("baseline_steps"), [low, high], [f"under_{low}", f"{low}_to_{high - 1}", f"{high}_or_more"])
    return (out.drop("_seen").withColumns({"baseline_band": slug, "meets_baseline_floor": F.col("baseline_steps") >= p.baseline_floor})
            .join(linked, "person_id", "left").withColumn("has_any_wearable", F.coalesce("has_any_wearable", F.lit(False))))


def day_panel(features: DataFrame, grid: DataFrame, stays: DataFrame, p: CohortParams) -> DataFrame:
    """Days 1..panel_days after discharge of each episode, with day kinds, deficits and the strictly
    lagged share of valid days. ``features``: episode_id, person_id, discharge_date, los_days,
    baseline_steps, at_risk_last_day. A deficit is null on an unobserved day."""
    g = (features.where("discharge_date IS NOT NULL").withColumn("post_day", F.explode(F.sequence(F.lit(1), F.lit(p.panel_days))))
         .withColumn("calendar_date", F.date_add("discharge_date", F.col("post_day"))))
    d = grid.select("person_id", F.col("activity_date").alias("calendar_date"), "steps", "wear_minutes", "valid_wear", F.col("is_analyzable").alias("_an"))
    g = g.join(d, ["person_id", "calendar_date"], "left")
    after = features.select("episode_id", "person_id", "discharge_date").join(stays, "person_id").where(
        F.col("visit_start_date").between(F.date_add("discharge_date", 1), F.date_add("discharge_date", p.panel_days)))
    inside = after.select("person_id", "episode_id", F.explode(F.sequence("visit_start_date", F.coalesce("visit_end_date", "visit_start_date"))).alias("calendar_date")).distinct().withColumn("is_inpatient", F.lit(True))
    g = g.join(inside, ["person_id", "episode_id", "calendar_date"], "left")
    valid = F.coalesce("valid_wear", F.lit(False))
    g = g.withColumns({"valid_wear": valid, "is_inpatient": F.coalesce("is_inpatient", F.lit(False)), "is_censored": F.col("post_day") > F.col("at_risk_last_day"),
                       "is_analyzable": F.coalesce("_an", F.lit(False)) & (F.col("post_day") <= F.col("at_risk_last_day")), "day_of_week": F.dayofweek("calendar_date"),
                       "in_accrual_window": F.col("post_day").between(*p.accrual), "postoperative_day": F.col("los_days") + F.col("post_day")})
    kind = F.when(F.col("is_censored"), "censored")
    lag = Window.partitionBy("person_id", "episode_id").orderBy("post_day").rowsBetween(-p.lag_days, -1)
    observed = F.col("is_analyzable")
    return g.drop("_an").withColumns({
        "day_kind": kind.when(observed, "observed").otherwise("missing"),
        "day_kind_four": kind.when(F.col("is_inpatient"), "inpatient").when(observed, "observed").otherwise("missing"),
        "normalized_activity": F.when(observed, ratio(F.col("steps"), F.col("baseline_steps"))),
        "deficit": F.when(observed, deficit(F.col("steps"), F.col("baseline_steps"))),
        "deficit_untruncated": F.when(observed, deficit(F.col("steps"), F.col("baseline_steps"), False)),
        "lagged_wear_fraction": F.avg(F.when(F.col("valid_wear"), 1.0).otherwise(0.0)).over(lag)})
