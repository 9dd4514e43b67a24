"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where the session names none, a folder of this machine serves, but
    only for a local master: on a cluster the executors could not see it, so that is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        found = getattr(sc, "_panelwise_tables", None) or tempfile.mkdtemp(prefix="panelwise-tables-")
        sc._panelwise_tables = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that what is built on it does not make it anew
    and a lost executor takes nothing of it away."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str, buckets: int = 0) -> DataFrame:
    """``stored`` as a table in the session's catalogue, in buckets of ``key`` and sorted by it: what groups by the key,
    or joins on it with a table of as many buckets, reads it where it lies. Buckets are as many as the session's
    shuffle partitions unless told otherwise."""
    spark = df.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    writer.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
