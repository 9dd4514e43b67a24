"""Group levels, tiers and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.disclosure import FLOOR
from panelwise.operators.running import running_sums


def collapse_level(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Four groups (a x b), two (a), one or none, by the smallest cell that must clear the floor."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("m", F.sum("n").over(Window.partitionBy(a)))
    level = (F.when((F.count(F.lit(1)) == 4) & (F.min("n") > FLOOR), "four").when(F.min("m") > FLOOR, "two").when(F.sum("n") > FLOOR, "one").otherwise("none"))
    return cells.agg(F.min("n").alias("smallest"), level.alias("level"))


def tier_for_count(n: Column) -> Column:
    """Fixed bands of the number of events: what analyses it allows."""
    return F.when(n >= 100, "full").when(n >= 50, "reduced").when(n >= 20, "descriptive").otherwise("none")


def with_surrogate(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers 1.. in the order of the key in place of an identifier.

    Keys are numbered in ranges, written once, so neither one task nor a second, differing sampling of
    the ranges decides a number.
    """
    numbered = running_sums(rows.select(key).distinct(), [], [F.col(key).asc()], {name: F.lit(1)})
    return rows.join(numbered.select(key, F.col(name).cast("long").alias(name)), key)
