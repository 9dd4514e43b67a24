"""Running sums and ranks over tables of any size: ranges in parallel, offsets by small aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.sources.shared import shared_folder


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the same ``by`` up to this one in ``order``.

    Rows are dealt by range once and written, so that a lost executor cannot deal them anew; each range is
    summed by itself, and what the ranges before it hold is added from one row for each range and group.
    ``order`` must tell rows of a group apart, or rows that tie are summed in any order.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    valued = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
    valued.repartitionByRange(parts, *[F.col(c).asc() for c in by], *order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranged.groupBy("_p", *by).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_p", *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = {f"_w_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}
    joined = ranged.withColumns(within).join(offsets.withColumnRenamed("_p", "_q"), _on(by))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums])


def _on(by: Sequence[str]) -> Column:
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return same
