"""Joins of the chain by the person, what they send to the driver, and writers that deal a large part over several tasks."""

import glob

from pyspark.sql import functions as F

from panelwise.operators import episodes
from panelwise.params import SCALED
from panelwise.plans import chain, registry
from panelwise.sources import io

SF = "/root/testdata/sf0.001"


def test_a_chain_bounds_what_its_joins_broadcast(spark):
    assert [chain._bytes(x) for x in ("10485760b", "10MB", "256k", "-1")] == [10485760, 10485760, 262144, -1]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for given, kept in (("10MB", chain.BROADCAST), ("256k", 262144), ("-1", -1)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
            chain.Chain(spark, SF)
            assert chain._bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) == kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_eligibility_holds_few_sorted_tables_in_a_task(spark):
    c = chain.Chain(spark, SF)
    e = episodes.eligibility(c.episodes, c.baseline, c.conditions, c.visits, c.deaths, c.observation, c.grid, SCALED, c.cens)
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 8


def test_panel_meets_itself_where_it_lies(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["j08_panel_offset"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_a_large_month_or_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(200000).select("id", F.lit(7).alias("day"), F.expr("date'2024-01-01' + cast(id % 5 as int)").alias("date"), F.md5(F.col("id").cast("string")).alias("x")).repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        io.write_by_bucket(rows, f"{tmp_path}/b", "day")
        io.write_by_month(rows, f"{tmp_path}/m", "date")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{tmp_path}/b/bucket=5/*.parquet")) > 1 and len(glob.glob(f"{tmp_path}/m/month=2024-01/*.parquet")) > 1
    assert io.read_bucket(spark, f"{tmp_path}/b", "day", 3, 11).count() == 200000 == spark.read.parquet(f"{tmp_path}/m").count()
