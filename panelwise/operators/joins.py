"""Joins on a person and a window of days, as-of joins, semi and anti joins, reconciliation.

Each has an equality on the person (or episode), so Spark hashes on it and checks the window as a
residual; rows of one person are few. ``by_bucket`` adds a day bucket to the key for persons with
very many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_join(anchors: DataFrame, facts: DataFrame, on: str, anchor_date: str, fact_date: str, lo: int, hi: int, how: str = "inner") -> DataFrame:
    """Facts from ``lo`` to ``hi`` days around each anchor; adds rel_day."""
    f = facts.withColumnRenamed(on, "_on")
    inside = (F.col(on) == F.col("_on")) & F.col(fact_date).between(F.date_add(anchor_date, lo), F.date_add(anchor_date, hi))
    return anchors.join(f, inside, how).drop("_on").withColumn("rel_day", F.datediff(fact_date, anchor_date))


def by_bucket(anchors: DataFrame, facts: DataFrame, on: str, anchor_date: str, fact_date: str, lo: int, hi: int) -> DataFrame:
    """The inner ``window_join`` with (person, week) as key: for persons with very many rows."""
    days = F.explode(F.sequence(F.floor(F.datediff(F.date_add(anchor_date, lo), F.lit("1970-01-01")) / 7), F.floor(F.datediff(F.date_add(anchor_date, hi), F.lit("1970-01-01")) / 7)))
    a = anchors.withColumn("_week", days)
    f = facts.withColumnRenamed(on, "_on").withColumn("_week2", F.floor(F.datediff(fact_date, F.lit("1970-01-01")) / 7))
    inside = (F.col(on) == F.col("_on")) & (F.col("_week") == F.col("_week2")) & F.col(fact_date).between(F.date_add(anchor_date, lo), F.date_add(anchor_date, hi))
    return a.join(f, inside).drop("_on", "_week", "_week2").withColumn("rel_day", F.datediff(fact_date, anchor_date))


def contained_join(points: DataFrame, spans: DataFrame, on: str, date: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Spans that hold a date; a span without an end is its first day."""
    s = spans.withColumnRenamed(on, "_on")
    return points.join(s, (F.col(on) == F.col("_on")) & F.col(date).between(F.col(start), F.coalesce(end, start)), how).drop("_on")


def nearest_before(anchors: DataFrame, facts: DataFrame, on: str, key: str, anchor_date: str, fact_date: str, value: str, days: int, tie: str) -> DataFrame:
    """The latest value on or before each anchor, at most ``days`` back; on ties the largest ``tie``."""
    near = window_join(anchors, facts, on, anchor_date, fact_date, -days, 0)
    return near.groupBy(key).agg(F.max_by(value, F.struct(fact_date, tie)).alias(value), F.max(fact_date).alias(fact_date))


def neighbours(rows: DataFrame, on: str, key: str, date: str, end: str, days: int, keep_on: bool = False) -> DataFrame:
    """For each row: whether another of the person lies 1..days before it, and the next one after its end; with the
    person, if ``keep_on``.

    Two range windows over the person's days: a row is a day that others see, and a question asked from
    the day of its end.
    """
    day = lambda c: F.unix_date(c)
    prior = F.count(F.lit(1)).over(Window.partitionBy(on).orderBy("_day").rangeBetween(-days, -1)) > 0
    has = rows.withColumn("_day", day(F.col(date))).select(on, key, prior.alias("has_prior"))
    asked = rows.select(on, F.col(key).alias("_key"), day(F.coalesce(end, date)).alias("_day"), F.lit(None).cast("date").alias("_date"))
    seen = rows.select(on, F.lit(None).cast(rows.schema[key].dataType).alias("_key"), day(F.col(date)).alias("_day"), F.col(date).alias("_date"))
    later = F.min("_date").over(Window.partitionBy(on).orderBy("_day").rangeBetween(1, Window.unboundedFollowing))
    nxt = asked.unionByName(seen).withColumn("next_date", later).where("_key IS NOT NULL").select(F.col(on).alias("_on"), F.col("_key").alias("_key"), "next_date")
    both = has.join(nxt, F.col(on).eqNullSafe(F.col("_on")) & (F.col(key) == F.col("_key"))).drop("_on", "_key")
    return both if keep_on else both.drop(on)


def having_within(rows: DataFrame, spans: DataFrame, on: str, date: str, start: str, end: str) -> DataFrame:
    """Rows whose date lies in some span of theirs (semi join)."""
    s = spans.select(F.col(on).alias("_on"), F.col(start).alias("_s"), F.coalesce(end, start).alias("_e"))
    return rows.join(s, (F.col(on) == F.col("_on")) & F.col(date).between(F.col("_s"), F.col("_e")), "left_semi")


def orphans(rows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(known.select(*on).distinct(), list(on), "left_anti")


def in_list(value: Column, array: Column) -> Column:
    """Membership in an array column; null in either gives false."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full outer comparison: rows on one side only and disagreements by column, as metric rows."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    counts = [F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")]
    counts += [F.count_if(F.col("_a") & F.col("_b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"differs_{c}") for c in cols]
    one = both.agg(*counts)
    return one.unpivot([], one.columns, "metric", "n")


def latest_first(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each partition in the given order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")
