"""Exact duplicates: a heavy-hitter split by Misra-Gries, then ordinary shuffling for the rest.

DataFrame functions only. Rows are compared by the SHA-256 of their text in UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import heavy_values, written


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Of rows with the same text the one with the largest id stays. Null text is the empty text.
    A null id is smaller than any other. Rows that repeat an id and a text count in group_size
    and only one of them is kept. An empty table gives an empty result. Other columns are ignored.

    Digests that fill a large share of the rows are found by a Misra-Gries summary; their winner
    and exact size come from a map-side aggregate and are broadcast (at most HEAVY_ITEMS rows), so
    their rows never meet in one task. All other digests are shuffled and ranked by a window.
    """
    keyed = written(docs.select(F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("_d"),
                                F.monotonically_increasing_id().alias("_n")), "digests")
    heavy = written(heavy_values(keyed, "_d"), "heavy")
    mine = F.struct("_id", "_n")
    winners = (keyed.join(F.broadcast(heavy), "_d", "left_semi")
               .groupBy("_d").agg(F.max(mine).alias("_w"), F.count(F.lit(1)).alias("group_size")))
    winners = written(winners, "winners")
    whole = Window.partitionBy("_d")
    light = (keyed.join(F.broadcast(heavy), "_d", "left_anti")
             .withColumns({"_w": F.max(mine).over(whole), "group_size": F.count(F.lit(1)).over(whole)}))
    hot = keyed.join(F.broadcast(winners), "_d")
    return hot.unionByName(light).select(
        F.col("_id").alias(id_col), F.col("_w._id").alias("keep_id"), "group_size",
        (F.col("_n") == F.col("_w._n")).alias("kept"), F.col("_d").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``duplicate_classes`` keeps, with all their columns and whole texts.

    Heavy digests are reduced on the map side to one row for each task; the others are shuffled
    by digest with their rows, once. Of rows with equal id and text any one stays.
    """
    cols = docs.columns
    packed = docs.select(text_digest(F.col(text_col)).alias("_d"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("_row"))
    id_at = f"_row.c{cols.index(id_col)}"
    heavy = written(heavy_values(packed.select("_d"), "_d"), "heavy")
    first = (packed.join(F.broadcast(heavy), "_d", "left_semi")
             .groupBy("_d").agg(F.max_by("_row", F.struct(F.col(id_at).isNotNull(), F.col(id_at))).alias("_row")))
    order = Window.partitionBy("_d").orderBy(F.col(id_at).desc_nulls_last())
    rest = (packed.join(F.broadcast(heavy), "_d", "left_anti")
            .withColumn("_k", F.row_number().over(order)).where("_k = 1").select("_d", "_row"))
    return first.unionByName(rest).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(cols)])
