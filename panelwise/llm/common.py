"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.sources.shared import shared_folder

#: A value is heavy if the Misra-Gries summary finds it in about this share of all rows or more.
HEAVY_ITEMS = 1000
HEAVY_TRACKED = 8192

#: Sources (or any other dimension) up to this many rows are joined by broadcast.
BROADCAST_ROWS = 10_000

#: Text that a Python worker takes up at a time.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows and bytes of the Arrow batches that go to Python workers, where the session has Spark's own
    numbers: those are for short rows, and texts are long."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)


def short_plans(spark: SparkSession) -> None:
    """Fields of a node that the text of a plan shows, where the session has Spark's own number: the driver keeps the text of
    a thousand plans, each with the whole text of its literals, of which the merge table of a tokenizer is some megabytes."""
    if spark.conf.get("spark.sql.debug.maxToStringFields", "25") == "25":
        spark.conf.set("spark.sql.debug.maxToStringFields", "2")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, with its file system's name, so that whoever opens a path in it
    goes to that file system and not to a disk of its own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/panelwise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs do not recompute it, and
    no lost executor can take it away."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/panelwise/" in file:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def heavy_values(df: DataFrame, column: str) -> DataFrame:
    """At most HEAVY_ITEMS values of ``column`` that fill a large share of the rows: one row each.

    ``approx_top_k`` keeps a Misra-Gries summary (counters that are all lowered when the table of
    counters is full) in every task and merges the summaries; it returns only values whose count
    it can guarantee to be above its error, about 1/3000 of the rows. Its size is fixed, so the
    result may be broadcast. Which values it finds only decides the path of a row, never a result.
    """
    top = df.where(F.col(column).isNotNull()).select(
        F.expr(f"approx_top_k({column}, {HEAVY_ITEMS}, {HEAVY_TRACKED})").alias("t"))
    return top.select(F.explode("t.item").alias(column))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers, mixed one to one so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of ``size`` bytes of ``column``, or of one row if that is longer, so
    that what is made of a piece stays small whatever the texts' lengths."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
