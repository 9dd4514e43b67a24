"""Re-fits of one model under changed definitions: every variant is a part of one stored design, and all are fitted in step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.operators.estimators import fit_logit_each, patterns
from panelwise.operators.joins import window_join
from panelwise.sources.shared import stored


def kept_device(episodes: DataFrame, devices: DataFrame, look_back: int, panel_days: int) -> DataFrame:
    """``episode_id`` of the episodes whose person shows one model at most from ``look_back`` days before the operation to the
    end of the panel; episodes without any device are kept. Models are counted, not families of them."""
    key = episodes.select("episode_id", "person_id", "index_date", "discharge_date")
    longest = panel_days * 3
    seen = window_join(key, devices.select("person_id", "device_date", "model"), "person_id", "index_date", "device_date", -look_back, longest)
    moved = seen.where(F.col("device_date") <= F.date_add("discharge_date", panel_days)).groupBy("episode_id").agg(F.countDistinct("model").alias("k")).where("k > 1")
    return key.select("episode_id").join(moved, "episode_id", "left_anti")


def plain_flag(episodes: DataFrame, records: DataFrame, codes: DataFrame, wanted: Column) -> DataFrame:
    """``episode_id, flag``: whether a record that can define an operation by itself (no add-on) is ``wanted``."""
    own = records.join(codes, "code").where(~F.col("is_add_on")).groupBy("person_id", F.col("procedure_date").alias("index_date")).agg(F.max(wanted.cast("int")).alias("_f"))
    return episodes.select("episode_id", "person_id", "index_date").join(own, ["person_id", "index_date"], "left").select("episode_id", (F.coalesce("_f", F.lit(0)) == 1).alias("flag"))


def long_design(rows: DataFrame, variants: dict[str, tuple[Column | None, dict[str, Column], Column, Column]]) -> DataFrame:
    """``variant, unit, x.., y, w``: each row once for every variant that takes it, from one pass over ``rows``.

    A variant is (which rows, terms by name, response, weight). A row without a response or a positive weight is left out of that variant.
    """
    parts = []
    for k, (where, x, y, w) in enumerate(variants.values()):
        told = F.struct(F.lit(k).alias("variant"), *[c.cast("double").alias(n) for n, c in x.items()], y.cast("double").alias("y"), w.cast("double").alias("w"))
        parts.append(F.when(F.lit(True) if where is None else where, told))
    return rows.select(F.col("episode_id").alias("unit"), F.explode(F.array(*parts)).alias("v")).where("v IS NOT NULL").select("unit", "v.*").where("y IS NOT NULL AND w > 0")


def fit_variants(design: DataFrame, names: Sequence[str], x: Sequence[str], term: str) -> DataFrame:
    """``variant, n_rows, n_units, coefficient``: the coefficient of ``term`` in every variant, null where the fit is singular or
    passes the ceiling, or the variant has no rows.

    Rows that agree in all terms are one, with their weights summed; what is left is written once and each Newton step is one aggregate over it for
    all variants together.
    """
    spark = design.sparkSession
    small = stored(patterns(design, "variant", x, "y", "w").withColumns({"y": F.col("wy") / F.col("n"), "w": F.col("n")}), "variants")
    found = fit_logit_each(small, "variant", range(len(names)), x, "y", "w")
    at = list(x).index(term)
    fits = spark.createDataFrame([(k, n, None if found[k] is None else float(found[k][at])) for k, n in enumerate(names)], "k int, variant string, coefficient double")
    counts = design.groupBy(F.col("variant").alias("k")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("unit").alias("n_units"))
    zero = F.lit(0)
    return fits.join(F.broadcast(counts), "k", "left").select("variant", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_units", zero).alias("n_units"), "coefficient")
