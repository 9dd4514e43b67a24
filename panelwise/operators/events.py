"""Events after discharge, landmark windows, risk sets and curves around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import is_in_ci, log_ratio, ratio
from panelwise.operators.episodes import AMBULATORY
from panelwise.operators.joins import latest_first, window_join
from panelwise.operators.matching import next_on_ring, ring_place
from panelwise.params import CohortParams
from panelwise.sources.shared import stored


def _window_steps(lo: int, hi: int) -> Column:
    """Days of the window that lie after discharge."""
    return F.col("rel_day").between(lo, hi) & (F.col("activity_date") > F.col("discharge_date"))


def _good(c: Column) -> Column:
    return c & F.col("valid_wear") & F.col("steps").isNotNull()


def events(features: DataFrame, visits: DataFrame, grid: DataFrame, p: CohortParams, bound: str = "reference") -> DataFrame:
    """One event per episode and date of an emergency or inpatient visit after discharge, without dates
    on which every visit is elective, and its windows of days before.

    ``bound="reference"``: beyond the last day at risk a visit's origin is unknown, so it counts as not
    elective and stays. ``bound="strict"`` drops visits beyond that day.
    """
    f = features.select("episode_id", "person_id", "discharge_date", "baseline_steps", "at_risk_last_day")
    v = visits.where("visit_kind IN ('emergency', 'inpatient')").select("person_id", "visit_occurrence_id", F.col("visit_start_date").alias("event_date"), "visit_kind", "origin")
    e = f.join(v, "person_id").where("event_date > discharge_date").withColumn("event_day", F.datediff("event_date", "discharge_date"))
    late = F.col("event_day") > F.col("at_risk_last_day")
    if bound == "strict":
        e = e.where(~late)
    e = e.withColumn("_elective", F.when(late, F.lit(False)).otherwise(is_in_ci(F.col("origin"), AMBULATORY)))
    ed, stay = F.bool_or(F.col("visit_kind") == "emergency"), F.bool_or(F.col("visit_kind") == "inpatient")
    kind = F.when(ed & stay, "ed_then_inpatient").when(ed, "emergency_department").otherwise("inpatient")
    k = (e.groupBy("episode_id", "person_id", "discharge_date", "baseline_steps", "event_date", "event_day")
         .agg(F.min("visit_occurrence_id").alias("visit_occurrence_id"), kind.alias("event_kind"), F.every("_elective").alias("_all")).where("NOT _all").drop("_all"))
    lo = min(p.control[0], p.reference[0], p.landmark[0])
    keys = ["episode_id", "event_date", "person_id", "discharge_date", "baseline_steps", "event_day", "visit_occurrence_id", "event_kind"]
    d = window_join(k.select(*keys), grid.select("person_id", "activity_date", "steps", "wear_minutes", "valid_wear"), "person_id", "event_date", "activity_date", lo, -1, "left")
    near = _window_steps(*p.landmark)

    def median(c: Column) -> Column:
        return F.median(F.when(_good(c), F.col("steps")))

    out = d.groupBy(*keys).agg(
        median(near).alias("near_steps"), F.count_if(_good(near)).alias("n_valid"), F.count_if(near).alias("n_days"),
        F.avg(F.when(near, F.coalesce("wear_minutes", F.lit(0)) / 1440)).alias("wear_fraction"), median(_window_steps(-3, -1)).alias("last_steps"),
        median(_window_steps(*p.reference)).alias("reference_steps"), median(_window_steps(*p.control)).alias("control_steps"))
    rank = Window.partitionBy("person_id", "episode_id").orderBy("event_date")
    at = F.date_sub("event_date", -p.landmark[1])
    out = out.withColumns({
        "event_id": F.concat_ws("-", "episode_id", F.date_format("event_date", "yyyyMMdd")), "event_rank": F.row_number().over(rank),
        "landmark_day": F.col("event_day") + p.landmark[1], "landmark_dow": F.dayofweek(at),
        "r_near": ratio(F.col("near_steps"), F.col("baseline_steps")), "r_last": ratio(F.col("last_steps"), F.col("baseline_steps")),
        "r_reference": ratio(F.col("reference_steps"), F.col("baseline_steps")), "r_control": ratio(F.col("control_steps"), F.col("baseline_steps")), "local_change": log_ratio(F.col("near_steps"), F.col("reference_steps"))})
    least = p.least_window_days
    return out.withColumns({"is_first_event": F.col("event_rank") == 1, "has_landmark": F.col("n_valid") >= least, "no_window": F.col("n_days") < least,
                            "no_signal": (F.col("n_days") >= least) & (F.col("n_valid") < least)})


def landmark_panel(panel: DataFrame, ev: DataFrame, grid: DataFrame, p: CohortParams) -> DataFrame:
    """For each panel day the valid and existing days of the landmark window before it, and the share of
    valid days in the week before the landmark, on the panel and on the calendar.

    The panel's days are dense, so the window is a range over the day number, not a self join; so are the
    grid's days, whose week is a range over the date and meets the panel on its last day.
    """
    near = Window.partitionBy("person_id", "episode_id").orderBy("post_day").rangeBetween(*p.landmark)
    at = Window.partitionBy("person_id", "episode_id").orderBy("post_day").rangeBetween(p.landmark[1], p.landmark[1])
    good = (F.col("valid_wear") & F.col("steps").isNotNull()).cast("int")
    w = panel.select("episode_id", "person_id", "post_day", "calendar_date", "is_censored", "valid_wear", "steps", "lagged_wear_fraction").withColumns({
        "n_valid": F.coalesce(F.sum(good).over(near), F.lit(0)), "n_days": F.count("post_day").over(near), "landmark_lag": F.max("lagged_wear_fraction").over(at)})
    week = Window.partitionBy("person_id").orderBy(F.unix_date("activity_date")).rangeBetween(1 - p.lag_days, 0)
    back = grid.select("person_id", F.date_add("activity_date", 1 - p.landmark[1]).alias("calendar_date"), F.avg(F.col("valid_wear").cast("double")).over(week).alias("calendar_lag"), F.count(F.lit(1)).over(week).alias("n_calendar_days"))
    days = ev.groupBy("person_id", "episode_id", F.col("event_day").alias("post_day")).agg(F.lit(True).alias("is_event"), F.bool_or("is_first_event").alias("is_first"))
    out = w.drop("valid_wear", "steps", "lagged_wear_fraction").join(back, ["person_id", "calendar_date"], "left").join(days, ["person_id", "episode_id", "post_day"], "left")
    least = p.least_window_days
    return out.withColumns({"has_landmark": F.col("n_valid") >= least, "no_window": F.col("n_days") < least, "no_signal": (F.col("n_days") >= least) & (F.col("n_valid") < least),
                            "n_calendar_days": F.coalesce("n_calendar_days", F.lit(0)), "is_event": F.coalesce("is_event", F.lit(False)), "is_first": F.coalesce("is_first", F.lit(False))})


def landmark_disagreements(lm: DataFrame, ev: DataFrame) -> DataFrame:
    """Events whose own window counts differ from the panel's for the same day: expected to be none."""
    a = ev.select("person_id", "episode_id", F.col("event_day").alias("post_day"), F.col("n_valid").alias("ev_valid"))
    return lm.join(a, ["person_id", "episode_id", "post_day"]).where("n_valid <> ev_valid").select("episode_id", "post_day", "n_valid", "ev_valid")


def risk_set_candidates(features: DataFrame, ev: DataFrame, p: CohortParams, reach: int = 2) -> tuple[DataFrame, DataFrame]:
    """Cases (``set_id`` and who and when they are) and, for each set and rung, at least the first few candidates in the set's
    order: ``set_id, episode_id, person_id, rung, day, distance``.

    What a candidate offers a set follows from the weekday of its discharge and its last day free of events alone.
    So the pool is sorted in classes of (weekday, last day), and a set asks each class for its next keys on the
    ring. Last days beyond the reach are all alike to a set: they are asked for by blocks of 1, 2, 4, ... days, of
    which some four hold an episode and at most log2(panel_days) are asked. Candidates made
    are at most a fixed number for each case, however large the pool is.
    """
    c = ev.where("is_first_event AND NOT no_window").select(F.col("event_id").alias("set_id"), F.col("episode_id").alias("case_episode"), F.col("person_id").alias("case_person"), F.col("event_day").alias("case_day"), F.col("landmark_dow").alias("case_dow"))
    first = ev.groupBy("episode_id").agg(F.min("event_day").alias("first_event"))
    last = F.least(F.col("at_risk_last_day"), F.coalesce(F.col("first_event") - 1, F.col("at_risk_last_day"))).cast("int")
    pool = features.select("episode_id", "person_id", "discharge_date", "at_risk_last_day").join(first, "episode_id", "left").withColumn("last", last).where("last >= 1")
    depth = (p.panel_days + reach).bit_length()

    def class_of(dow: Column, level: Column, block: Column) -> Column:
        return (dow * 64 + level).cast("long") * (1 << 32) + block.cast("long")

    key = [F.lit(p.salt), F.lit(str(p.seed))]
    held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda j: F.struct(j.alias("level"), F.floor(F.col("last") / F.pow(F.lit(2.0), j)).cast("int").alias("block"))), lambda b: (b["level"] == 0) | (b["block"] % 2 == 1))
    items = pool.withColumn("b", F.explode(held)).select(class_of(F.dayofweek("discharge_date"), F.col("b.level"), F.col("b.block")).alias("class"), ring_place(*key, "episode_id").alias("place"), F.struct("episode_id", "person_id").alias("item"))

    def offer(dow: Column, up_to: Column) -> Column:
        """The best of the days that a candidate with this weekday, free up to a day, offers the case."""
        def one(day: Column) -> Column:
            of_day = F.pmod(dow - 1 + day + p.landmark[1], F.lit(7)) + 1
            rung = F.when((day == F.col("case_day")) & (of_day == F.col("case_dow")), 1).when(of_day.isin(1, 7) == F.col("case_dow").isin(1, 7), 2).otherwise(3)
            return F.struct(rung.alias("rung"), F.abs(day - F.col("case_day")).alias("gap"), day.alias("day"))
        return F.array_min(F.transform(F.sequence(F.greatest(F.lit(1), F.col("case_day") - reach), up_to), one))

    low, high = F.greatest(F.lit(1), F.col("case_day") - reach), F.col("case_day") + reach
    single = F.transform(F.sequence(low, high - 1), lambda day: F.struct(F.lit(0).alias("level"), day.alias("block"), day.alias("up_to")))
    beyond = F.filter(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda j: F.struct(j.alias("level"), (F.floor((high - 1) / F.pow(F.lit(2.0), j)).cast("int") + 1).alias("block"), high.alias("up_to"))), lambda b: b["block"] % 2 == 1)
    asks = c.withColumn("dow", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("b", F.explode(F.concat(single, beyond))).withColumn("o", offer(F.col("dow"), F.col("b.up_to")))
    asked = asks.select(class_of(F.col("dow"), F.col("b.level"), F.col("b.block")).alias("class"), ring_place(*key, "set_id").alias("place"), F.struct("set_id", "case_episode", "o.rung", "o.day").alias("ask"))
    met = next_on_ring(items, asked, max(p.per_set, 2) + 1).where("item.episode_id <> ask.case_episode")  # one more, for the case itself
    return c, met.select("ask.set_id", "item.episode_id", "item.person_id", "ask.rung", "ask.day", "distance")


def pair_candidates(features: DataFrame, ev: DataFrame, p: CohortParams, reach: int = 2, ample: int = 40) -> tuple[DataFrame, DataFrame]:
    """Cases, and for each set its first candidates by the MD5 of the pair and day: ``set_id, episode_id, person_id, day,
    match_rung, fingerprint``. Every admissible pair of a case and a pool episode has its fingerprint computed.

    What an episode offers a set follows from the weekday of its discharge and its last free day, so a set's rung and its
    number of candidates come from counts of those classes, without pairs. The pairs of that rung are then made in
    parts of the pool, and of them only those stay whose fingerprint lies below a bound that some ``ample`` candidates of
    a set pass. A set for which too few passed is asked again without the bound, so the result is exact.
    """
    spark = features.sparkSession
    c = ev.where("is_first_event AND NOT no_window").select(F.col("event_id").alias("set_id"), F.col("episode_id").alias("case_episode"), F.col("person_id").alias("case_person"), F.col("event_day").cast("int").alias("case_day"), F.col("landmark_dow").alias("case_dow"))
    first = ev.groupBy("episode_id").agg(F.min("event_day").alias("first_event"))
    last = F.least(F.col("at_risk_last_day"), F.coalesce(F.col("first_event") - 1, F.col("at_risk_last_day"))).cast("int")
    pool = stored(features.join(first, "episode_id", "left").select("episode_id", "person_id", F.dayofweek("discharge_date").alias("dow"), last.alias("last")).where("last >= 1"), "pool")

    low, high = F.greatest(F.lit(1), F.col("case_day") - reach), F.col("case_day") + reach

    def one(day: Column) -> Column:
        of_day = F.pmod(F.col("dow") - 1 + day + p.landmark[1], F.lit(7)) + 1
        rung = F.when((day == F.col("case_day")) & (of_day == F.col("case_dow")), 1).when(of_day.isin(1, 7) == F.col("case_dow").isin(1, 7), 2).otherwise(3)
        return F.struct(rung.alias("rung"), F.abs(day - F.col("case_day")).alias("gap"), day.alias("day"))

    # For each kind of case and weekday: the best offer of an episode that is free up to a day, and the days that share it.
    kinds = c.select("case_day", "case_dow").distinct().withColumn("dow", F.explode(F.sequence(F.lit(1), F.lit(7)))).where(low <= high).withColumn("up_to", F.explode(F.sequence(low, high)))
    kinds = kinds.withColumn("all", F.array_sort(F.transform(F.sequence(low, F.col("up_to")), one))).withColumn("days", F.transform(F.filter("all", lambda o: (o["rung"] == F.col("all")[0]["rung"]) & (o["gap"] == F.col("all")[0]["gap"])), lambda o: o["day"]))
    kinds = kinds.select("case_day", "case_dow", "dow", F.col("up_to").alias("from_last"), F.when(F.col("up_to") < high, F.col("up_to")).alias("to_last"), F.col("all")[0]["rung"].alias("rung"), F.col("days")[0].alias("day"), F.get("days", F.lit(1)).alias("other_day"))
    kinds = kinds.groupBy("case_day", "case_dow", "dow", "rung", "day", "other_day").agg(F.min("from_last").alias("from_last"), F.max(F.coalesce("to_last", F.lit(2**31 - 1))).alias("to_last"))
    classes = pool.groupBy("dow", "last").agg(F.count(F.lit(1)).alias("n"))
    sized = kinds.join(F.broadcast(classes), "dow").where("last BETWEEN from_last AND to_last").groupBy("case_day", "case_dow").agg(*[F.sum(F.when(F.col("rung") == r, F.col("n")).otherwise(0)).alias(f"n{r}") for r in (1, 2, 3)])
    own = c.join(pool.select(F.col("episode_id").alias("case_episode"), "dow", "last"), "case_episode").join(F.broadcast(kinds), ["case_day", "case_dow", "dow"]).where("last BETWEEN from_last AND to_last").select("set_id", F.col("rung").alias("own_rung"))
    ranked = c.join(F.broadcast(sized), ["case_day", "case_dow"]).join(own, "set_id", "left")
    left = {r: F.col(f"n{r}") - F.coalesce((F.col("own_rung") == r).cast("int"), F.lit(0)) for r in (1, 2, 3)}
    ranked = ranked.withColumn("match_rung", F.when(left[1] >= 2, 1).when(left[1] + left[2] >= 2, 2).otherwise(3))
    size = left[1] + F.when(F.col("match_rung") >= 2, left[2]).otherwise(0) + F.when(F.col("match_rung") == 3, left[3]).otherwise(0)
    ranked = ranked.withColumn("size", size).where("size > 0")
    bound = F.when(F.col("size") > ample, F.lpad(F.lower(F.hex(F.floor(F.lit(float(1 << 52)) * ample / F.col("size")).cast("long"))), 13, "0")).otherwise(F.lit("g"))
    asks = ranked.withColumn("bound", bound).join(F.broadcast(kinds), ["case_day", "case_dow"]).where("rung <= match_rung").select("set_id", "case_episode", "dow", "from_last", "to_last", "day", "other_day", "match_rung", "size", "bound")

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = max(1, 2 * parts // 7)
    part = (F.col("dow") * salts + F.col("salt")).cast("long").alias("part")
    dealt = pool.withColumn("salt", F.pmod(F.xxhash64("episode_id"), F.lit(salts))).select(part, "episode_id", "person_id", "last").repartition(parts, "part")

    def paired(asked: DataFrame) -> DataFrame:
        a = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(part, "set_id", "case_episode", "from_last", "to_last", "day", "other_day", "match_rung", "bound").repartition(parts, "part")
        met = a.join(dealt.hint("shuffle_hash"), "part").where("last BETWEEN from_last AND to_last AND episode_id <> case_episode")
        fingerprint = {d: F.md5(F.concat_ws("|", F.lit(p.salt), F.lit(str(p.seed)), "set_id", "episode_id", F.col(d).cast("string"))) for d in ("day", "other_day")}
        best = F.least(F.struct(fingerprint["day"].alias("fingerprint"), F.col("day").alias("day")), F.when(F.col("other_day").isNotNull(), F.struct(fingerprint["other_day"].alias("fingerprint"), F.col("other_day").alias("day"))))
        return met.select("set_id", "episode_id", "person_id", "match_rung", "bound", best.alias("o")).where("o.fingerprint < bound").select("set_id", "episode_id", "person_id", "o.day", "match_rung", "o.fingerprint")

    asks = stored(asks, "asks")
    found = stored(paired(asks), "pairs")
    passed = found.groupBy("set_id").agg(F.count(F.lit(1)).alias("passed"))
    few = asks.join(passed, "set_id", "left").where(F.coalesce("passed", F.lit(0)) < F.least(F.lit(p.per_set), F.col("size")))
    again = paired(few.select(*asks.columns).withColumn("bound", F.lit("g")))
    return c, found.join(few.select("set_id").distinct(), "set_id", "left_anti").unionByName(again)


def risk_sets(features: DataFrame, ev: DataFrame, p: CohortParams, reach: int = 2, order: str = "ring") -> DataFrame:
    """Incidence-density sampling in long form, one case and its controls per set.

    A control is at risk, without an event up to then, on a day within ``reach`` of the case's; of its
    days the one that matches best counts: the case's day and weekday, then the same part of the week,
    then any, then the nearest. A set takes the strictest rung that leaves two controls, five of them, and a
    person serves three times.

    ``order="pair"`` is the reference's: each set has an order of its own, the MD5 of set, episode and day, which also
    decides between days that match alike, see ``pair_candidates``. ``order="ring"`` takes the distance on a ring of hashed
    episodes from the set's place and the earlier day: only the next few keys of the sorted pool are met, see
    ``risk_set_candidates``, but neighbours on the ring share their controls, so the cap by person drops more of them.
    """
    if order == "pair":
        c, met = pair_candidates(features, ev, p, reach)
        chosen = latest_first(latest_first(met, ["set_id"], [F.asc("fingerprint")], p.per_set), ["person_id"], [F.asc("fingerprint")], p.per_person)
    elif order == "ring":
        c, met = risk_set_candidates(features, ev, p, reach)
        by = [F.asc("distance"), F.asc("episode_id")]
        few = latest_first(met, ["set_id", "rung"], by, max(p.per_set, 2))
        ranked = few.withColumn("match_rung", F.coalesce(F.get(F.array_sort(F.collect_list("rung").over(Window.partitionBy("set_id"))), F.lit(1)), F.lit(3)))
        chosen = latest_first(ranked.where("rung <= match_rung"), ["set_id"], by, p.per_set)
        chosen = latest_first(chosen, ["person_id"], [F.asc("distance"), F.asc("set_id"), F.asc("episode_id")], p.per_person)
    else:
        raise ValueError(f"unknown order {order}")
    cases = c.select("set_id", F.lit("case").alias("role"), F.col("case_episode").alias("episode_id"), F.col("case_person").alias("person_id"), F.col("case_day").alias("day"), F.lit(1).alias("match_rung"))
    return cases.unionByName(chosen.select("set_id", F.lit("control").alias("role"), "episode_id", "person_id", "day", "match_rung"))


def member_exposure(members: DataFrame, features: DataFrame, grid: DataFrame, window: tuple[int, int], least: int) -> DataFrame:
    """Each member's median steps in a window before its own day, over its baseline (``least`` valid days)."""
    m = members.join(features.select("episode_id", "discharge_date", "baseline_steps"), "episode_id").withColumn("at", F.date_add("discharge_date", "day"))
    d = window_join(m.select("set_id", "episode_id", "person_id", "role", "day", "match_rung", "at", "discharge_date", "baseline_steps"), grid.select("person_id", "activity_date", "steps", "valid_wear"), "person_id", "at", "activity_date", *window, "left")
    c = F.col("activity_date") > F.col("discharge_date")
    g = d.groupBy("set_id", "episode_id", "person_id", "role", "day", "match_rung", "baseline_steps").agg(F.median(F.when(_good(c), F.col("steps"))).alias("steps"), F.count_if(_good(c)).alias("n_valid"))
    return g.withColumn("ratio", F.when(F.col("n_valid") >= least, ratio(F.col("steps"), F.col("baseline_steps"))))


def event_curve(members: DataFrame, features: DataFrame, grid: DataFrame, lo: int = -14, hi: int = 7) -> DataFrame:
    """Per role and day around the member's day: n, median of steps over baseline, mean wear."""
    m = members.select("set_id", "episode_id", "person_id", "role", "day").join(features.select("episode_id", "discharge_date", "baseline_steps"), "episode_id").withColumn("at", F.date_add("discharge_date", "day"))
    d = window_join(m, grid.select("person_id", "activity_date", "steps", "wear_minutes", "is_analyzable"), "person_id", "at", "activity_date", lo, hi)
    r = F.when(F.col("is_analyzable"), ratio(F.col("steps"), F.col("baseline_steps")))
    return d.groupBy("role", "rel_day").agg(F.count(F.lit(1)).alias("n_days"), F.count(r).alias("n_observed"), F.median(r).alias("median_ratio"), F.avg(F.coalesce("wear_minutes", F.lit(0))).alias("mean_wear"))


def discrete_time_panel(lm: DataFrame, ev: DataFrame) -> DataFrame:
    """Days at risk up to and with the first event, the outcome, and whether the landmark is computable."""
    first = ev.groupBy("episode_id").agg(F.min("event_day").alias("first_event"))
    d = lm.where("NOT is_censored").join(first, "episode_id", "left").where("first_event IS NULL OR post_day <= first_event")
    return d.select("episode_id", "person_id", "post_day", "n_valid", "has_landmark", (F.col("post_day") == F.coalesce("first_event", F.lit(-1))).cast("int").alias("outcome"))
