"""Stand-ins for the canonical tables, made from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*cols)


def _k():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("long")


def zone_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "user_id", "ts", "event_type", "value").select(
        F.col("user_id").alias("person_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("zone"), F.round(F.col("value") * 6).cast("long").alias("minute_in_zone"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (events(spark, sf_dir, "user_id", "ts", "event_type", "props").where("event_type <> 'error'")
            .groupBy(F.col("user_id").alias("person_id"), F.to_date("ts").alias("date")).agg((F.sum(_k()) * 100).alias("steps")))


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_id", "user_id", "ts", "event_type", "value", "props").where("event_type = 'purchase' AND value >= 60").select(
        F.col("user_id").alias("person_id"), F.to_date("ts").alias("procedure_date"), F.col("event_id").alias("visit_occurrence_id"), _k().alias("code"))


def code_set(spark: SparkSession) -> DataFrame:
    """Codes 0..99: class, region and the add-on flag."""
    k = F.col("id")
    region = F.when(k % 11 == 10, "unspecified").when(k % 3 == 0, "cervical").when(k % 3 == 1, "lumbar").otherwise("thoracic")
    return spark.range(100).select(k.alias("code"), F.when(k % 2 == 0, "A").otherwise("B").alias("vocabulary"), F.when(k >= 50, "fusion").otherwise("other").alias("procedure_class"),
                                   region.alias("region"), (k % 7 == 0).alias("is_add_on"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_date("ts")
    return events(spark, sf_dir, "event_id", "user_id", "ts", "event_type", "props").where("event_type IN ('signup', 'error')").select(
        F.col("event_id").alias("visit_occurrence_id"), F.col("user_id").alias("person_id"), F.when(F.col("event_type") == "signup", "inpatient").otherwise("emergency").alias("visit_kind"),
        start.alias("visit_start_date"), F.when(F.col("event_id") % 13 != 0, F.date_add(start, (F.col("event_id") % 4).cast("int"))).alias("visit_end_date"),
        F.when(_k() % 5 == 0, "Ambulatory Clinic").when(_k() % 5 == 1, "Home").otherwise("Emergency Room").alias("origin"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    category = (F.when(k < 6, "trauma").when(k < 10, "malignancy").when(k < 12, "spinal_infection").when(k.between(25, 60), "degenerative"))
    return events(spark, sf_dir, "event_id", "user_id", "ts", "event_type", "props").where("event_type = 'click'").select(
        F.col("user_id").alias("person_id"), F.to_date("ts").alias("condition_start_date"), F.col("event_id").alias("condition_id"), k.alias("code"), category.alias("category"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_id", "user_id", "ts", "event_type", "props").where("event_type = 'view'").select(
        F.col("event_id").alias("measurement_id"), F.col("user_id").alias("person_id"), F.to_date("ts").alias("measurement_date"), _k().cast("double").alias("value_as_number"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "user_id", "ts", "event_type", "props").select(
        F.col("user_id").alias("person_id"), F.to_date("ts").alias("device_date"), F.concat(F.upper("event_type"), F.lit(" "), _k().cast("string")).alias("model"))


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "user_id", "ts").groupBy(F.col("user_id").alias("person_id")).agg(F.max(F.to_date("ts")).alias("observation_period_end_date"))


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation(spark, sf_dir).where("person_id % 37 = 0").withColumnRenamed("observation_period_end_date", "death_date")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    birth = F.date_add(F.lit("1940-01-01").cast("date"), (F.col("person_id") * 97 % 18000).cast("int"))
    return observation(spark, sf_dir).select("person_id", birth.alias("birth_date"), F.when(F.col("person_id") % 2 == 0, "F").otherwise("M").alias("sex"))
