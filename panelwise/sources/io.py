"""Catalog reads, role resolution, sinks and the restartable build."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.functions.disclosure import is_legal_count
from panelwise.operators.aggregates import table_digest
from panelwise.operators.disclosure import export_refusals
from panelwise.sources.shared import shared_folder, stored  # noqa: F401


def scan(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def schema_rows(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, type string, nullable boolean")


def table_rows(tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Row counts of the tables whose name fits a pattern."""
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.where(F.col("table").rlike(pattern))


def table_sizes(tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    """``table, n_rows, n_files, n_bytes`` of the tables whose name fits a pattern; sizes are those of the files that the scan
    reads, so a table that lies in no files has none."""
    out = None
    for name, df in tables.items():
        if not re.search(pattern, name):
            continue
        files = df.groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("n"))
        one = files.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no table fits {pattern}")
    return out


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_roles(df: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Each role takes the column that the first fitting name pattern finds; none or several refuse."""
    import re

    chosen = {}
    for role, patterns in rules.items():
        for pattern in patterns:
            found = [c for c in df.columns if re.fullmatch(pattern, c, re.IGNORECASE)]
            if len(found) > 1:
                raise ValueError(f"{role}: {', '.join(found)} all fit {pattern}")
            if found:
                chosen[role] = found[0]
                break
        else:
            raise ValueError(f"{role}: no column fits")
    return df.select(*[F.col(f"`{c}`").alias(role) for role, c in chosen.items()])


def write_clustered(df: DataFrame, path: str, key: str) -> None:
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_by_month(df: DataFrame, path: str, date: str) -> None:
    """Partitioned by month: daily partitions of person-days would be many small files. A month that is large is dealt over
    several tasks, each with a file of its own, so that no task writes it alone."""
    df.withColumn("month", F.date_format(date, "yyyy-MM")).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def write_by_bucket(df: DataFrame, path: str, col: str, width: int = 5) -> None:
    df.withColumn("bucket", (F.floor(F.col(col) / width) * width).cast("int")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, col: str, lo: int, hi: int, width: int = 5) -> DataFrame:
    """Reads only the partitions that can hold lo..hi."""
    return spark.read.parquet(path).where(F.col("bucket").between(lo // width * width, hi // width * width) & F.col(col).between(lo, hi)).drop("bucket")


def build_tables(spark: SparkSession, stages: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], folder: str, start_at: str = "") -> dict[str, DataFrame]:
    """Build tables in order, each written and read back; from ``start_at`` on, those before are read."""
    if start_at and start_at not in stages:
        raise ValueError(f"no stage {start_at}")
    done: dict[str, DataFrame] = {}
    running = not start_at
    for name, make in stages.items():
        running = running or name == start_at
        if running:
            make(done).write.mode("overwrite").parquet(f"{folder}/{name}")
        done[name] = spark.read.parquet(f"{folder}/{name}")
    return done


def stamped(df: DataFrame, source: DataFrame, date: str, params: dict | None = None) -> DataFrame:
    """Adds the build time, the source's last date and, if given, the parameters as JSON."""
    cutoff = source.agg(F.max(date).alias("source_cutoff"))
    told = {"params": F.lit(json.dumps(params, sort_keys=True, default=str))} if params is not None else {}
    return df.withColumns({"built_at": F.current_timestamp(), **told}).join(F.broadcast(cutoff))


@dataclass(frozen=True)
class Stage:
    """One table of a build: how it is made from those that it reads, and the parameters that decide its content."""

    make: Callable[[dict[str, DataFrame]], DataFrame]
    reads: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


def stage_stamps(stages: dict[str, Stage], cutoff: str) -> dict[str, str]:
    """A signature for each stage: its name, its parameters, the source's cutoff and the signatures of what it reads."""
    out: dict[str, str] = {}
    for name, stage in stages.items():
        unknown = [r for r in stage.reads if r not in out]
        if unknown:
            raise ValueError(f"{name} reads {', '.join(unknown)}, which no earlier stage makes")
        told = [name, stage.params, cutoff, [out[r] for r in stage.reads]]
        out[name] = hashlib.md5(json.dumps(told, sort_keys=True, default=str).encode(), usedforsecurity=False).hexdigest()
    return out


def build_signed(spark: SparkSession, stages: dict[str, Stage], folder: str, cutoff: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Build the tables whose signature is not there yet, in order; those that are there are read.

    A table lies in a folder named by its signature, so a changed parameter or cutoff makes that stage and all that read it
    anew and none before it, and an attempt that broke off leaves no marker of success and is made again.
    Returns the tables and the names of those that were built.
    """
    done: dict[str, DataFrame] = {}
    built = []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, stamp in stage_stamps(stages, cutoff).items():
        path = f"{folder}/{name}-{stamp}"
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(hadoop).exists(marker):
            stages[name].make({r: done[r] for r in stages[name].reads}).write.mode("overwrite").parquet(path)
            built.append(name)
        done[name] = spark.read.parquet(path)
    return done, built


def csv_text(df: DataFrame) -> DataFrame:
    """Columns as they are written: whole floats as integers, others with six significant digits."""
    out = {}
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            out[c] = F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.6g", x.cast("double")))
        else:
            out[c] = x.cast("string")
    return df.withColumns(out)


def gated_export(df: DataFrame, path: str, counts: Sequence[str] = (), percents: dict[str, str] | None = None, texts: Sequence[str] = (), partitions: dict[str, Sequence[str]] | None = None, kind: str = "table") -> None:
    """Write one CSV of an aggregate, unless one of the seven classes of refusals finds something. ``partitions`` names for a
    count the columns within which its cells sum to a shown total. All findings are named, not the first only."""
    found = export_refusals(df, "export.csv", kind, counts, percents, partitions, texts).collect()
    if found:
        raise ValueError("refused: " + "; ".join(f"{r['class']} in {r['column']} ({r['n']})" for r in found))
    csv_text(df).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def manifest(tables: dict[str, DataFrame], counts: dict[str, str]) -> DataFrame:
    """Per table: rows, hidden cells, the least count shown and a digest of its text."""
    out = None
    for name, df in tables.items():
        c = F.col(counts[name])
        row = table_digest(csv_text(df), df.columns, ",", "\n").select(F.col("digest").alias("md5"))
        facts = df.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_hidden"), F.min(F.when(c > 0, c)).alias("least_count"))
        one = facts.join(F.broadcast(row))
        out = one if out is None else out.unionByName(one)
    return out


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, bytes, md5`` of every CSV file of a bundle, from the files' bytes; a file is named by its exhibit's folder and its own name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
    name = F.regexp_extract(F.col("path"), "([^/]+/[^/]+)$", 1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5")).where(~F.col("file").startswith("manifest/"))


def file_facts(spark: SparkSession, folder: str, counts: dict[str, str]) -> DataFrame:
    """``file, n_rows, n_hidden, n_illegal``: what the files of each exhibit hold, counted from the files."""
    out = None
    for exhibit, column in counts.items():
        d = spark.read.option("header", True).csv(f"{folder}/{exhibit}").select("*", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1).alias("file"))
        n = F.col(f"`{column}`").try_cast("double")
        one = d.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(n.isNull()).alias("n_hidden"), F.count_if(n.isNotNull() & ~is_legal_count(n)).alias("n_illegal"))
        out = one if out is None else out.unionByName(one)
    return out


def write_bundle(tables: dict[str, DataFrame], counts: dict[str, str], folder: str) -> DataFrame:
    """Write each exhibit through the refusal rules, then a manifest of the files as they lie: ``file, bytes, md5, n_rows, n_hidden``."""
    for exhibit, df in tables.items():
        gated_export(df, f"{folder}/{exhibit}", counts=[counts[exhibit]])
    spark = next(iter(tables.values())).sparkSession
    told = bundle_files(spark, folder).join(file_facts(spark, folder, counts).drop("n_illegal"), "file", "left").na.fill(0, ["n_rows", "n_hidden"])
    told.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/manifest")
    return spark.read.option("header", True).schema("file string, bytes long, md5 string, n_rows long, n_hidden long").csv(f"{folder}/manifest")


def bundle_problems(spark: SparkSession, folder: str, manifest: DataFrame, counts: dict[str, str], budget: int | None = None) -> DataFrame:
    """``file, problem``: what a bundle's files and its manifest disagree about, read from the files.

    missing: listed and not there; extra: there and not listed; damaged: another MD5; recount: other numbers of rows or
    hidden cells than listed; illegal_count: a count that may not be shown; over_budget: the bundle as
    a whole (file '*') has more bytes than ``budget``. An untouched bundle gives no rows.
    """
    listed = manifest.select("file", *[F.col(c).alias(f"_{c}") for c in ("bytes", "md5", "n_rows", "n_hidden")], F.lit(True).alias("_listed"))
    files = bundle_files(spark, folder).withColumn("_there", F.lit(True))
    both = files.join(listed, "file", "full_outer").join(file_facts(spark, folder, counts), "file", "left")
    there, named = F.col("_there").isNotNull(), F.col("_listed").isNotNull()
    rules = {"missing": named & ~there, "extra": there & ~named, "damaged": there & named & (F.col("md5") != F.col("_md5")),
             "recount": there & named & ((F.coalesce("n_rows", F.lit(0)) != F.col("_n_rows")) | (F.coalesce("n_hidden", F.lit(0)) != F.col("_n_hidden"))), "illegal_count": F.col("n_illegal") > 0}
    found = both.select("file", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))).alias("problem"))
    if budget is None:
        return found
    return found.unionByName(files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_b")).where(F.col("_b") > budget).select(F.lit("*").alias("file"), F.lit("over_budget").alias("problem")))


def json_nodes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, path, parent, depth, kind, value``: every node of JSON documents, walked level by level: objects and arrays of one level are
    exploded into the next, which is stored, until none is left. Text that is no JSON is one node of kind ``unreadable``."""
    spark = docs.sparkSession
    v = F.try_parse_json(F.col(text))
    level = stored(docs.select(F.col(doc).alias("doc"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), v.alias("node"), F.col(text).isNotNull().alias("_was")), "nodes")
    out = None
    while True:
        kind = F.when(F.col("node").isNull(), F.when(F.col("_was"), "unreadable").otherwise("null")).otherwise(F.lower(F.regexp_extract(F.schema_of_variant("node"), "^([A-Z]+)", 1)))
        told = level.withColumn("kind", F.when(kind == "void", "null").otherwise(kind))
        flat = told.select("doc", "path", "parent", "depth", "kind", F.when(~F.col("kind").isin("object", "array"), F.try_variant_get("node", "$", "string")).alias("value"))
        out = flat if out is None else out.unionByName(flat)
        inner = told.where("kind IN ('object', 'array')")
        if inner.isEmpty():
            return out
        step = "concat(t.path, if(e.key IS NULL, concat('[', e.pos, ']'), concat('.', e.key)))"
        level = stored(spark.sql(f"SELECT t.doc, {step} AS path, t.path AS parent, t.depth + 1 AS depth, e.value AS node, false AS _was FROM {{t}} t, LATERAL variant_explode(t.node) e", t=inner), "nodes")


def json_refusals(docs: DataFrame, doc: str, text: str, banned: str = r"[<>\x00-\x08]", dates: str = r"[0-9]{4}-[0-9]{2}-[0-9]{2}") -> DataFrame:
    """``doc, path, rule``: what a results document may not carry, at any depth.

    A value node is an object with ``suppressed``. Refused: unreadable text; a value beside ``suppressed`` true; a shown
    count (``unit`` 'count') that is not legal; a lone hidden node among shown count nodes of one parent; a string with a banned
    character or a date, names of members too.
    """
    n = stored(json_nodes(docs, doc, text), "json")
    member = F.substring_index("path", ".", -1)
    fields = n.where("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("path")).agg(
        *[F.max(F.when(member == m, F.col("value"))).alias(m) for m in ("suppressed", "value", "unit")], F.bool_or(member == "suppressed").alias("is_node")).where("is_node")
    fields = fields.join(n.select("doc", "path", "parent"), ["doc", "path"])
    hidden, count = F.col("suppressed") == "true", F.col("unit") == "count"
    number = F.col("value").try_cast("double")
    w = Window.partitionBy("doc", "parent")
    lone = fields.where(count).withColumns({"_h": F.count_if(hidden).over(w), "_s": F.count_if(~hidden & (number > 0)).over(w)}).where(hidden & (F.col("_h") == 1) & (F.col("_s") > 0))
    name = F.regexp_extract("path", r"\.([^.\[]*)$", 1)
    rules = [(n.where("kind = 'unreadable'"), "unreadable"), (fields.where(hidden & F.col("value").isNotNull()), "value_beside_hidden"),
             (fields.where(count & ~hidden & ~F.coalesce(is_legal_count(number), F.lit(False))), "illegal_count"), (lone, "lone_hidden"),
             (n.where((F.col("kind") == "string") & F.col("value").rlike(banned) | name.rlike(banned)), "banned_character"), (n.where((F.col("kind") == "string") & F.col("value").rlike(dates) | name.rlike(dates)), "date")]
    out = None
    for d, rule in rules:
        one = d.select("doc", "path", F.lit(rule).alias("rule"))
        out = one if out is None else out.unionByName(one)
    return out


def gated_json(docs: DataFrame, doc: str, text: str, path: str) -> None:
    """Write results documents as lines of JSON, unless a rule refuses one of them."""
    found = json_refusals(docs, doc, text).limit(20).collect()  # named in the refusal
    if found:
        raise ValueError("refused: " + "; ".join(f"{r['rule']} at {r['path']} of {r['doc']}" for r in found))
    docs.select(text).write.mode("overwrite").text(path)


def json_rows(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))
