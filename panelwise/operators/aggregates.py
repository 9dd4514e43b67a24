"""Aggregations over one pass: roll-ups that overlap, distributions, digests, ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_groups(rows: DataFrame, a: str, b: str, aggs: Sequence[Column], everyone: str = "all") -> DataFrame:
    """Aggregates per (a, b) cell, per margin and in total; each row counts in all four."""
    cells = F.array(*[F.struct(x.alias("ga"), y.alias("gb")) for x in (F.col(a), F.lit(everyone)) for y in (F.col(b), F.lit(everyone))])
    return rows.withColumn("_g", F.explode(cells)).groupBy(F.col("_g.ga").alias(a), F.col("_g.gb").alias(b)).agg(*aggs)


def with_all(rows: DataFrame, col: str, everyone: str = "all") -> DataFrame:
    """Each row in its own segment and in the segment of all."""
    return rows.withColumn(col, F.explode(F.array(F.col(col), F.lit(everyone))))


def distribution(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of the values of several numeric columns in long form."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x"))
    return long.groupBy("x.metric", "x.value").agg(F.count(F.lit(1)).alias("n"))


def weighted_quantiles(hist: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Quartiles of a histogram, without expanding its rows."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col(weight))
    return hist.groupBy(*by).agg(q.alias("_q"), F.sum(weight).alias("n")).select(*by, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Skips nulls, values that are not finite and weights that are not positive."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (weight > 0)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def mean_sd(value: Column, least: int = 20) -> list[Column]:
    """Mean, standard deviation and n; null where n does not exceed ``least``."""
    n = F.count(value)
    return [n.alias("n"), F.when(n > least, F.avg(value)).alias("mean"), F.when(n > least, F.stddev_samp(value)).alias("sd")]


def quartiles(value: Column) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")]


def table_digest(rows: DataFrame, cols: Sequence[str], within: str = "|", between: str = "~") -> DataFrame:
    """MD5 of the sorted row keys, joined by ``between``. Keys are sorted by range in parallel and packed into pieces;
    one task then reads the pieces in order and holds one batch at a time. An empty table has no digest."""
    key = F.concat_ws(within, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("k").to_pylist()
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int64()), "piece": pa.array([between.join(keys).encode()], pa.binary())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, h = 0, hashlib.md5(usedforsecurity=False)
        for batch in batches:
            for count, piece in zip(batch.column("n"), batch.column("piece"), strict=True):
                h.update(between.encode() * (n > 0) + piece.as_py())
                n += count.as_py()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "digest": pa.array([h.hexdigest() if n else None], pa.string())})

    pieces = rows.select(key.alias("k")).sort("k").mapInArrow(pack, "n long, piece binary")
    piece = pieces.withColumn("i", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("i").select("n", "piece")
    return piece.mapInArrow(digest, "n long, digest string").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"))


#: Rows of a leaf of ``tree_leaves``, on average.
LEAF_ROWS = 4096


def _row_key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])


def leaf_digits(rows: DataFrame) -> int:
    """Hexadecimal digits of the leaf name that make leaves of about LEAF_ROWS rows."""
    n, digits = rows.count(), 0
    while n > LEAF_ROWS * 16**digits:
        digits += 1
    return digits


def tree_leaves(rows: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    """``leaf, n, digest``: the leaves of a hash tree over the rows' keys. A row's leaf is the first ``digits`` hexadecimal digits of
    its key's MD5, and a leaf's digest the MD5 of its sorted key digests; repeated rows count each time."""
    key = rows.select(F.md5(_row_key(cols)).alias("_k"))
    leaf = F.substring("_k", 1, digits) if digits else F.lit("")
    return key.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("_k")), "")).alias("digest"))


def tree_digest(rows: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """``n, digest``: the root of the tree, the MD5 of the ordered leaves' names and digests, level by level: sixteen
    children make a node, so no task ever holds more than a leaf. An empty table has no digest."""
    digits = leaf_digits(rows) if digits is None else digits
    level = tree_leaves(rows, cols, digits)
    for k in range(digits, 0, -1):
        child = F.concat_ws(":", "leaf", "digest")
        level = level.groupBy(F.substring("leaf", 1, k - 1).alias("leaf")).agg(F.sum("n").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(child)), ",")).alias("digest"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"))


def changed_rows(a: DataFrame, b: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """``cols.., n_a, n_b``: the rows that two tables do not hold equally often. Only rows of leaves whose digests differ
    are compared; where the tables are alike that is next to none of them."""
    digits = leaf_digits(a) if digits is None else digits
    x, y = (tree_leaves(d, cols, digits).select("leaf", F.col("digest").alias(n)) for d, n in ((a, "_x"), (b, "_y")))
    differ = x.join(y, "leaf", "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y"))).select(F.col("leaf").alias("_leaf"))

    def of(d: DataFrame, name: str) -> DataFrame:
        own = F.substring(F.md5(_row_key(cols)), 1, digits) if digits else F.lit("")
        return d.select(*cols).withColumn("_leaf", own).join(differ, "_leaf", "left_semi").drop("_leaf").withColumns({"n_a": F.lit(int(name == "a")), "n_b": F.lit(int(name == "b"))})

    both = of(a, "a").unionByName(of(b, "b")).groupBy(*cols).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return both.where("n_a <> n_b")


def big_digest(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """An order-free digest of a table of any size: 60 bits of each row's MD5 are combined map-side."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))


def digests_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two one-row digests are the same in every column."""
    same = F.lit(True)
    for c in a.columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.alias("a").join(F.broadcast(b.alias("b"))).select(F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), same.alias("equal"))


def hierarchical_score(hits: DataFrame, key: str, category: str, weights: dict[str, int], trumps: dict[str, str]) -> DataFrame:
    """One hit per category; a category that trumps another takes its place; the weights of those left add up."""
    table = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(w))])
    got = hits.where(F.col(category).isin(*weights)).groupBy(key).agg(F.collect_set(category).alias("_c"))
    beaten = F.array(*[F.when(F.array_contains("_c", high), F.lit(low)) for high, low in trumps.items()])
    left = F.array_except("_c", beaten)
    return got.select(key, F.aggregate(left, F.lit(0), lambda acc, c: acc + table[c]).alias("score"), F.size(left).alias("n_categories"))


def evidence_path(rows: DataFrame, person: str, flags: dict[str, Column]) -> DataFrame:
    """Each person's flags, the largest of their rows, then counts by exclusive path: the first flag set."""
    per = rows.groupBy(person).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    path = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in flags], F.lit("none"))
    return per.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n_persons"))


def missingness(rows: DataFrame, variables: dict[str, Column]) -> DataFrame:
    """One row per variable with the rows it is asked of (its condition) and those where it is null."""
    aggs = []
    for name, asked in variables.items():
        aggs += [F.struct(F.count_if(asked).alias("n"), F.count_if(asked & F.col(name).isNull()).alias("n_missing")).alias(name)]
    one = rows.agg(*aggs)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"{n}.n").alias("n"), F.col(f"{n}.n_missing").alias("n_missing")) for n in variables]))
    return one.select(long.alias("x")).select("x.*")


def invariants(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each named rule (a rule that is null is broken), in one pass."""
    one = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.unpivot([], one.columns, "rule", "n_broken")


def column_coverage(rows: DataFrame, cols: Sequence[str], pattern: str) -> DataFrame:
    """Null, empty, distinct and pattern-matching counts of string columns, in one pass."""
    aggs = [F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c) == "").alias("n_empty"),
                     F.countDistinct(c).alias("n_distinct"), F.count_if(F.col(c).rlike(pattern)).alias("n_matched")).alias(c) for c in cols]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in cols])).alias("x")).select("x.column", "x.v.*")


def sums_to_total(rows: DataFrame, by: Sequence[str], part: str, total: str) -> DataFrame:
    """Partitions whose parts do not add up to the total they name."""
    return rows.groupBy(*by).agg(F.sum(part).alias("parts"), F.max(total).alias("total")).where(~F.col("parts").eqNullSafe(F.col("total")))


def evidence_split(rows: DataFrame, person: str, variants: dict[str, dict[str, Column]], threshold: float) -> DataFrame:
    """``evidence_path`` under several orders of evidence, with each path's share of persons and whether the
    share calls for a response."""
    out = None
    for name, flags in variants.items():
        paths = evidence_path(rows, person, flags)
        total = paths.agg(F.sum("n_persons").alias("_t"))
        share = paths.join(F.broadcast(total)).select(F.lit(name).alias("variant"), "path", "n_persons", (F.col("n_persons") / F.col("_t")).alias("share"))
        out = share if out is None else out.unionByName(share)
    return out.withColumn("response", F.when(F.col("share") >= threshold, "report").otherwise("note"))


def exact_size(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, refused unless there are exactly ``n`` of them (an action: it counts once)."""
    found = rows.count()
    if found != n:
        raise ValueError(f"{found} rows where {n} are due")
    return rows


def all_levels(rows: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """``rows``, refused if one of the levels has none."""
    seen = {r[0] for r in rows.where(F.col(col).isin(*levels)).select(col).distinct().collect()}
    if missing := [x for x in levels if x not in seen]:
        raise ValueError(f"no rows of {', '.join(missing)}")
    return rows
