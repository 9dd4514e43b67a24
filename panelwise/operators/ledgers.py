"""Ladders and ledgers of a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.operators.aggregates import overlap_groups
from panelwise.operators.episodes import LADDER


def attrition(elig: DataFrame) -> DataFrame:
    """One row per rung: episodes in, dropped and out, and persons left; rungs without drops stay.

    One aggregate by first failing step, then running totals over the rungs (a fixed, small number).
    """
    steps = elig.sparkSession.createDataFrame([(i, n) for i, n in enumerate(LADDER, 3)], "step int, rung string")
    counts = elig.groupBy(F.col("first_fail_step").alias("step")).agg(F.count(F.lit(1)).alias("n_dropped"))
    total = elig.agg(F.count(F.lit(1)).alias("n_all"))
    rows = steps.join(F.broadcast(counts), "step", "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0))).join(F.broadcast(total))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_in", F.col("n_all") - F.coalesce(F.sum("n_dropped").over(before), F.lit(0)))
    return rows.select("step", "rung", "n_in", "n_dropped", (F.col("n_in") - F.col("n_dropped")).alias("n_out"))


def ladder_problems(ladder: DataFrame) -> DataFrame:
    """Rungs that do not close: in - dropped = out, in = previous out, nothing negative, never rising."""
    last = F.lag("n_out").over(Window.orderBy("step"))
    rows = ladder.withColumn("_last", last)
    rules = {"closes": F.col("n_in") - F.col("n_dropped") == F.col("n_out"), "carries": F.coalesce(F.col("_last"), F.col("n_in")) == F.col("n_in"),
             "not_negative": (F.col("n_in") >= 0) & (F.col("n_dropped") >= 0) & (F.col("n_out") >= 0), "falls": F.col("n_out") <= F.col("n_in")}
    found = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select("step", F.explode(found).alias("problem"))


def reason_ledger(elig: DataFrame) -> DataFrame:
    """How many episodes each reason touches, alone or not: reasons overlap."""
    names = [f"x_{n}" for n in LADDER]
    alone = sum((F.col(n).cast("int") for n in names), F.lit(0))
    aggs = [F.struct(F.count_if(F.col(n)).alias("n_any"), F.count_if(F.col(n) & (alone == 1)).alias("n_alone")).alias(n) for n in names]
    one = elig.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n.removeprefix("x_")).alias("reason"), F.col(f"{n}.n_any").alias("n_any"), F.col(f"{n}.n_alone").alias("n_alone")) for n in names])).alias("x")).select("x.*")


def availability_by_day(panel: DataFrame, a: str, b: str) -> DataFrame:
    """At-risk, valid, analyzable and inpatient days per group, margin, total and panel day."""
    aggs = [F.count_if(~F.col("is_censored")).alias("n_at_risk"), F.count_if(F.col("valid_wear") & ~F.col("is_censored")).alias("n_valid"),
            F.count_if("is_analyzable").alias("n_analyzable"), F.count_if(F.col("is_inpatient") & ~F.col("is_censored")).alias("n_inpatient")]
    return overlap_groups_by_day(panel, a, b, aggs)


def overlap_groups_by_day(panel: DataFrame, a: str, b: str, aggs: list) -> DataFrame:
    cells = F.array(*[F.struct(x.alias("ga"), y.alias("gb")) for x in (F.col(a).cast("string"), F.lit("all")) for y in (F.col(b).cast("string"), F.lit("all"))])
    return panel.withColumn("_g", F.explode(cells)).groupBy(F.col("_g.ga").alias(a), F.col("_g.gb").alias(b), "post_day").agg(*aggs)


def set_size_ledger(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("set_id").agg(F.count_if(F.col("role") == "control").alias("n_controls"))
    return sizes.groupBy("n_controls").agg(F.count(F.lit(1)).alias("n_sets"))


def set_problems(members: DataFrame, p) -> DataFrame:  # noqa: ANN001
    """Sets without exactly one case, too many controls, or persons used too often."""
    per_set = members.groupBy("set_id").agg(F.count_if(F.col("role") == "case").alias("cases"), F.count_if(F.col("role") == "control").alias("controls"))
    per_person = members.where("role = 'control'").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    one = per_set.agg(F.count_if(F.col("cases") != 1).alias("not_one_case"), F.count_if(F.col("controls") > p.per_set).alias("too_many_controls"), F.count_if(F.col("controls") == 0).alias("no_controls"))
    two = per_person.agg(F.count_if(F.col("n") > p.per_person).alias("person_too_often"))
    both = one.join(F.broadcast(two))
    return both.unpivot([], both.columns, "check", "n")


def availability_totals(panel: DataFrame, a: str, b: str) -> DataFrame:
    return overlap_groups(panel, a, b, [F.count(F.lit(1)).alias("n")])


#: Rungs around those of LADDER: step, slug, kind, unit.
FRAME = ((1, "program_participants", "exclusion", "persons"), (2, "episode_construction", "conversion", "persons to episodes"), (16, "analytic_cohort", "terminal", "episodes"),
         (17, "events_identified", "conversion", "episodes to events"), (18, "event_without_landmark", "exclusion", "events"), (19, "events_analyzable", "terminal", "events"))


def full_ladder(elig: DataFrame, persons: DataFrame, ev: DataFrame) -> DataFrame:
    """The whole ladder, persons to episodes to events: per rung in, dropped, out and whether it closes with
    the rung before. Conversions change the unit and drop nothing; terminal rungs repeat what is left."""
    spark = elig.sparkSession
    own = ev.join(elig.where("is_eligible").select("episode_id"), "episode_id", "left_semi")
    counts = (persons.agg(F.count(F.lit(1)).alias("all_persons")).join(F.broadcast(elig.agg(F.countDistinct("person_id").alias("with_records"), F.count(F.lit(1)).alias("episodes"), F.count_if("is_eligible").alias("analytic"))))
              .join(F.broadcast(own.agg(F.count(F.lit(1)).alias("events"), F.count_if("has_landmark").alias("computable")))))
    n = {1: ("all_persons", "with_records"), 2: ("with_records", "episodes"), 16: ("analytic", "analytic"), 17: ("analytic", "events"), 18: ("events", "computable"), 19: ("computable", "computable")}
    framed = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(slug).alias("slug"), F.lit(kind).alias("kind"), F.lit(unit).alias("unit"), F.col(n[i][0]).alias("n_in"), F.col(n[i][1]).alias("n_out")) for i, slug, kind, unit in FRAME])).alias("x")).select("x.*")
    middle = attrition(elig).select("step", F.col("rung").alias("slug"), F.lit("exclusion").alias("kind"), F.lit("episodes").alias("unit"), "n_in", "n_out")
    rows = framed.unionByName(middle).withColumn("n_dropped", F.when(F.col("kind") == "exclusion", F.col("n_in") - F.col("n_out")))
    before = F.lag("n_out").over(Window.orderBy("step"))
    carries = F.coalesce(before == F.col("n_in"), F.lit(True))
    return rows.withColumn("closes", carries & F.coalesce(F.col("n_dropped") >= 0, F.lit(True)) & ((F.col("kind") != "terminal") | (F.col("n_in") == F.col("n_out"))))


def reasons_by_rung(elig: DataFrame, reasons: dict[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """``slug, reason, n, n_denominator``: overlapping reasons below the ladder's rungs, each with the rows it is
    counted among; all in one aggregate."""
    aggs = [F.struct(F.lit(s).alias("slug"), F.lit(r).alias("reason"), F.count_if(c).alias("n"), F.count_if(d).alias("n_denominator")) for (s, r), (c, d) in reasons.items()]
    one = elig.agg(*[a.alias(f"r{i}") for i, a in enumerate(aggs)])
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


def identities(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Numbers that two ways of counting must agree on: ``identity, left, right, holds``, each from a one-row frame."""
    out = None
    for name, (a, b) in pairs.items():
        one = a.toDF("left").join(F.broadcast(b.toDF("right"))).select(F.lit(name).alias("identity"), "left", "right", F.col("left").eqNullSafe(F.col("right")).alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out
