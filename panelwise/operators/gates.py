"""Checks that stand between one part of an analysis and the next: partitions of the day, ledgers, catalogues, print targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.disclosure import is_legal_count

#: Bands of a day's summed minutes.
VALID, TOP, CEILING = 600, 1380, 1440

#: Analyses in the protocol's order, each with the tiers that permit it (1 has the most events).
CATALOGUE = (
    ("gate_ledger", (1, 2, 3, 4)),
    ("structurally_deleted_event_timing", (1, 2, 3, 4)),
    ("landmark_condition_comparison", (1, 2, 3)),
    ("matched_set_size_distribution", (1, 2, 3)),
    ("event_centered_description", (1, 2, 3)),
    ("unadjusted_association", (1, 2, 3)),
    ("adjusted_conditional_logistic_model", (1, 2)),
    ("observation_weighted_sensitivity", (1, 2)),
    ("absolute_risk_translation", (1, 2)),
    ("negative_control_window", (1, 2)),
    ("clustered_bootstrap_validation", (1, 2)),
    ("secondary_seven_day_horizon", (1, 2)),
    ("internal_validation", (1,)),
    ("temporal_validation", (1,)),
    ("performance_panel", (1,)),
    ("median_lead_time", (1,)),
    ("alert_burden", (1,)),
    ("multidomain_model", (1,)),
    ("broad_feature_selection", ()),
)

#: Bands of the share of valid days before a day.
LAG_BANDS = ("unavailable", "none", "below_quarter", "quarter_to_half", "half_to_three_quarters", "three_quarters_to_all", "all")


def long_counts(one: DataFrame, block: str) -> DataFrame:
    """``block, label, n`` from a row of counts."""
    return one.unpivot([], one.columns, "label", "n").select(F.lit(block).alias("block"), "label", F.col("n").cast("long").alias("n"))


def zone_bands(rows: DataFrame, person: str, day: str, zone: str, minutes: str) -> DataFrame:
    """``block, label, n``: person-days by band of their summed minutes, with a repeated or null-minute zone and
    without any minutes, and rows by zone label.

    Only counts leave the aggregate, no person-day's own sum. A row without a label counts as a repeated one, since
    it names no zone of its own. An empty table gives zero bands and no labels.
    """
    total = F.col("total")
    days = rows.groupBy(person, day).agg(F.sum(minutes).alias("total"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(zone).alias("n_zones"), F.count_if(F.col(minutes).isNull()).alias("n_null"))
    one = days.agg(F.count(F.lit(1)).alias("person_days"), F.countDistinct(person).alias("persons"), F.count_if(total < VALID).alias("below_valid"), F.count_if(total.between(VALID, CEILING)).alias("valid"),
                   F.count_if(total > CEILING).alias("above_ceiling"), F.count_if(total.between(TOP, CEILING)).alias("top"), F.count_if(F.col("n_rows") > F.col("n_zones")).alias("repeated_label"),
                   F.count_if(F.col("n_null") > 0).alias("null_minutes"), F.count_if(total.isNull()).alias("no_total"))
    labels = rows.groupBy(F.col(zone).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("zone").alias("block"), "label", "n")
    return long_counts(one, "minutes").unionByName(labels)


def zone_verdict(bands: DataFrame) -> DataFrame:
    """``verdict, n``: what ``zone_bands`` says of the zones, and the person-days it rests on.

    ``repeated_label`` (double counts by repeated rows, to be mended before anything else is read), ``above_ceiling`` (zones overlap:
    not wearing a device only takes minutes away), ``partition`` (days reach the top band and none goes beyond it),
    ``inconclusive`` (no day reaches the top band, so nothing rules overlap out), ``not_run`` (no person-days, or a band is missing).
    """
    band = lambda name: F.max(F.when((F.col("block") == "minutes") & (F.col("label") == name), F.col("n")))
    names = ("person_days", "above_ceiling", "top", "repeated_label")
    one = bands.agg(*[band(n).alias(n) for n in names])
    known = F.coalesce(F.col("person_days") > 0, F.lit(False))
    for n in names[1:]:
        known = known & F.col(n).isNotNull()
    verdict = (F.when(~known, "not_run").when(F.col("repeated_label") > 0, "repeated_label").when(F.col("above_ceiling") > 0, "above_ceiling").when(F.col("top") > 0, "partition").otherwise("inconclusive"))
    return one.select(verdict.alias("verdict"), F.coalesce("person_days", F.lit(0)).alias("n"))


def tier_number(n: Column) -> Column:
    """1 to 4 by the number of events; each bound belongs to the better tier."""
    return F.when(n >= 100, 1).when(n >= 50, 2).when(n >= 20, 3).otherwise(4)


def permitted(strata: DataFrame, catalogue: DataFrame, n: str) -> DataFrame:
    """Each stratum with each analysis of ``catalogue`` (analysis, tiers): ``tier, permitted, why``. An analysis without
    tiers is never permitted. The catalogue is a short fixed list, so it is joined by broadcast."""
    tier = tier_number(F.col(n))
    out = strata.withColumn("tier", tier).join(F.broadcast(catalogue), F.lit(True))
    ok = F.array_contains("tiers", F.col("tier"))
    why = F.when(F.size("tiers") == 0, "never").when(ok, "permitted").otherwise("too_few_events")
    return out.withColumns({"permitted": ok, "why": why}).drop("tiers")


def catalogue(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(a, list(t)) for a, t in CATALOGUE], "analysis string, tiers array<int>")


def stage_problems(ledger: DataFrame, order: Sequence[str], whole: str, parts: str, leaf: Column) -> DataFrame:
    """``rule, stage, expected, found``: what is wrong with a ledger of ``stage, part, stratum, n``.

    ``unknown_stage``: not in ``order``. ``absent_stage``: no total of it. ``repeated_row``: a (stage, part, stratum) more than once.
    ``rises``: its total is above that of the stage before it that has one. ``split_differs``: the strata ``leaf`` of stage
    ``parts`` do not sum to the total of stage ``whole``. The ledger holds a few rows a stratum; it is small whatever it was counted from.
    """
    total = ledger.where("part = 'total' AND stratum = 'all'").groupBy("stage").agg(F.max("n").alias("n"))
    row = lambda rule, stage, expected, found: [F.lit(rule).alias("rule"), stage.alias("stage"), expected.cast("long").alias("expected"), found.cast("long").alias("found")]
    named = ledger.sparkSession.createDataFrame([(i, s) for i, s in enumerate(order)], "at int, stage string")
    unknown = ledger.join(F.broadcast(named), "stage", "left_anti").groupBy("stage").agg(F.count(F.lit(1)).alias("k")).select(*row("unknown_stage", F.col("stage"), F.lit(0), F.col("k")))
    all_stages = named.join(total, "stage", "left")
    absent = all_stages.where("n IS NULL").select(*row("absent_stage", F.col("stage"), F.lit(1), F.lit(0)))
    twice = ledger.groupBy("stage", "part", "stratum").agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("stage").agg(F.max("k").alias("k")).select(*row("repeated_row", F.col("stage"), F.lit(1), F.col("k")))
    last = F.last("n", ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rises = all_stages.withColumn("last", last).where("n > last").select(*row("rises", F.col("stage"), F.col("last"), F.col("n")))
    split = ledger.where((F.col("stage") == parts) & leaf).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found")).join(F.broadcast(total.where(F.col("stage") == whole)))
    split = split.where("n <> found").select(*row("split_differs", F.lit(parts), F.col("n"), F.col("found")))
    return unknown.unionByName(absent).unionByName(twice).unionByName(rises).unionByName(split)


def lag_band(share: Column) -> Column:
    """The band of LAG_BANDS that a share of valid days falls into; null is ``unavailable``."""
    return (F.when(share.isNull(), LAG_BANDS[0]).when(share <= 0, LAG_BANDS[1]).when(share < 0.25, LAG_BANDS[2]).when(share < 0.5, LAG_BANDS[3])
            .when(share < 0.75, LAG_BANDS[4]).when(share < 1, LAG_BANDS[5]).otherwise(LAG_BANDS[6]))


def lag_band_ledger(panel: DataFrame) -> DataFrame:
    """``band, n_days, n_at_risk, n_analyzable, n_first_day`` of a day panel."""
    return panel.groupBy(lag_band(F.col("lagged_wear_fraction")).alias("band")).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(~F.col("is_censored")).alias("n_at_risk"), F.count_if("is_analyzable").alias("n_analyzable"), F.count_if(F.col("post_day") == 1).alias("n_first_day"))


def observation_problems(bands: DataFrame) -> DataFrame:
    """``rule, n``: broken rules of the input of an observation model, given ``lag_band_ledger``: bands outside the vocabulary, more
    analyzable than at-risk days, more at-risk days than days, a lag on a first day, and no first day at all."""
    rules = {"unknown_band": F.count_if(~F.col("band").isin(*LAG_BANDS)), "analyzable_over_at_risk": F.count_if(F.col("n_analyzable") > F.col("n_at_risk")), "at_risk_over_days": F.count_if(F.col("n_at_risk") > F.col("n_days")),
             "lag_on_first_day": F.coalesce(F.sum(F.when(F.col("band") != LAG_BANDS[0], F.col("n_first_day"))), F.lit(0)), "no_first_day": (F.coalesce(F.sum("n_first_day"), F.lit(0)) == 0).cast("int")}
    return _broken(bands.agg(*[c.cast("long").alias(n) for n, c in rules.items()]))


def missingness_problems(ledger: DataFrame, variables: Sequence[str], complete: Sequence[str]) -> DataFrame:
    """``rule, n``: broken rules of a ledger of ``variable, n, n_missing``: it is empty, holds a variable that nobody declared, lacks a
    declared one or holds it twice, counts more missing than rows or below zero, or finds a gap in a variable that an
    earlier step made ``complete``."""
    named = F.col("variable").isin(*variables)
    rules = {"empty": (F.count(F.lit(1)) == 0).cast("int"), "undeclared": F.count_if(~F.coalesce(named, F.lit(False))), "absent": F.lit(len(variables)) - F.countDistinct(F.when(named, F.col("variable"))),
             "repeated": F.count_if(named) - F.countDistinct(F.when(named, F.col("variable"))), "missing_over_rows": F.count_if(F.col("n_missing") > F.col("n")),
             "negative": F.count_if((F.col("n") < 0) | (F.col("n_missing") < 0)), "gap_in_complete": F.count_if(F.col("variable").isin(*complete) & (F.coalesce("n_missing", F.lit(0)) != 0))}
    return _broken(ledger.agg(*[c.cast("long").alias(n) for n, c in rules.items()]))


def _broken(one: DataFrame) -> DataFrame:
    return one.unpivot([], one.columns, "rule", "n").where("n > 0")


def print_problems(table: DataFrame, counts: Sequence[str], metadata: Sequence[str], banned: str = "[‒-―]") -> DataFrame:
    """``rule, column, n``: why an aggregate may not be printed: a column declared as count and as metadata, not declared, or
    declared and not there; a count that is no legal disclosed one (null is hidden and legal); a date, by type or by its
    text; a banned dash in a header or a text. Unlike an export's gate it does not ask for columns that name their rows:
    a table by code has one row for each. All cells are looked at in one aggregate."""
    spark, cols = table.sparkSession, table.columns
    told = [("declared_twice", c, 1) for c in sorted(set(counts) & set(metadata))] + [("undeclared", c, 1) for c in cols if c not in {*counts, *metadata}]
    told += [("absent", c, 1) for c in sorted({*counts, *metadata} - set(cols))]
    cells: list[tuple[str, str, Column]] = []
    for c, kind in table.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            told.append(("date", c, 1))
        if kind == "string":
            cells += [("date", c, F.count_if(x.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"))), ("banned_dash", c, F.count_if(x.rlike(banned)))]
        if c in counts:
            number = x.try_cast("double")
            cells.append(("illegal_count", c, F.count_if(x.isNotNull() & ~F.coalesce(is_legal_count(number), F.lit(False)))))
        if any("‒" <= ch <= "―" for ch in c):
            told.append(("banned_dash", c, 1))
    out = spark.createDataFrame(told, "rule string, column string, n long")
    if cells:
        one = table.agg(*[n.alias(f"a{i}") for i, (_, _, n) in enumerate(cells)])
        long = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(f"a{i}").alias("n")) for i, (r, c, _) in enumerate(cells)]))
        out = out.unionByName(one.select(long.alias("x")).select("x.*").where("n > 0"))
    return out


def compared(stored: DataFrame, made: DataFrame, key: str, value: str) -> DataFrame:
    """``key, stored, made, agrees``: a stored ledger beside the same ledger counted again; a key that only one of them has does not agree."""
    j = stored.select(key, F.col(value).alias("stored")).join(made.select(key, F.col(value).alias("made")), key, "full")
    return j.withColumn("agrees", F.col("stored").eqNullSafe(F.col("made")))
