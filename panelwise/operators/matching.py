"""A pair order that can be searched: for each question the next items of a class on a ring.

Items and questions have a place on a ring of hashed keys, and a question's order of the items is the
distance from its own place onwards. So its first few items of a class are the next keys of a sorted
list, and no question meets an item that it does not take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.operators.running import running_sums
from panelwise.sources.shared import stored

#: Places on the ring; thirteen hexadecimal digits.
RING = 1 << 52


def ring_place(*parts: Column | str) -> Column:
    """The place of a key: the first 52 bits of the MD5 of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def ring_distance(start: Column, to: Column) -> Column:
    return F.pmod(to - start, F.lit(RING))


def next_on_ring(items: DataFrame, asked: DataFrame, take: int) -> DataFrame:
    """Pairs ``ask, item, distance``: for each row of ``asked`` (class, place, ask) the next ``take`` rows of ``items``
    (class, place, item) of its class, or all of them where there are fewer.

    Items are ranked once, by class and place, in ranges; a question's rank among them is where it would stand, and
    its pairs are an equi join on the ranks that follow, around the ring. Pairs made are rows of ``asked`` times
    ``take`` at most, whatever the number of items. Items that tie in place come in their own order. Rows
    with a null class or place have no partners.
    """
    of = items.schema["item"].dataType
    what = asked.schema["ask"].dataType
    rows = items.select("class", "place", F.lit(1).alias("is_item"), "item", F.lit(None).cast(what).alias("ask")).unionByName(
        asked.select("class", "place", F.lit(0).alias("is_item"), F.lit(None).cast(of).alias("item"), "ask")).where("class IS NOT NULL AND place IS NOT NULL")
    order = [F.asc(c) for c in ("class", "place", "is_item", "item", "ask")]
    ranked = stored(running_sums(rows, [], order, {"rank": F.col("is_item")}), "ring")
    ranks = ranked.where("is_item = 1")
    classes = ranks.groupBy("class").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size"))
    known = ranked.where("is_item = 0").select("class", F.col("place").alias("start"), "ask", "rank").join(classes, "class")
    step = F.explode(F.sequence(F.lit(0), F.least(F.lit(take), F.col("size")).cast("int") - 1))
    wanted = known.withColumn("step", step).select("ask", "start", (F.col("first") + F.pmod(F.col("rank") - F.col("first") + 1 + F.col("step"), "size")).alias("rank"))
    return wanted.join(ranks.select("rank", "place", "item"), "rank").select("ask", "item", ring_distance(F.col("start"), F.col("place")).alias("distance"))
