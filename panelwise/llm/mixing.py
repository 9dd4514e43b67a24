"""Mixing sources to target weights by pivotal dependent rounding.

DataFrame functions only. A document of a source with target t and size s is due t / s copies:
the whole part is certain, the fraction is rounded. Two documents with fractions f1, f2 and sizes
s1, s2 hold words f1 * s1 and f2 * s2; the pivotal step moves words from one to the other, in a
random direction that leaves both expectations as they are, until one fraction is 0 or 1. Each
bounded chunk of a source is folded to one document with a fraction left, then chunks of chunks,
up a tree with one open fraction per source at its root. A source's words therefore miss its
target by less than the size of one document, which in a source of few and unlike documents is much. So the
miss of the last rounding goes to smaller documents: some of those that were rounded the wrong way and
together hold the miss are rounded the other way, largest first, until what is left is smaller than any of them; where none is small enough, one goes
beyond and smaller ones of the other kind make up for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import BROADCAST_ROWS, words_count, written

#: Documents (or residuals) that one fold takes, on average.
FAN_IN = 64
WEIGHTS = (5.0, 2.0, 1.0)
#: What the miss of a source's last rounding may be moved to, in times its words.
SPARE = 64.0
#: No source may ask for more than this many times its words.
LIMIT = 3.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows ``source, size``.

    Sources, in code-point order and null last, get the weights in turn. They share all words by
    weight; a source's target stops at ``limit`` times its words and the rest is shared anew. Capped
    sources are those with the smallest limit per weight, so one pass over the sources in that order
    finds them: a source is capped if the words left for it and for all after it, by weight, exceed
    its limit. The windows see one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = by_source.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumns({"_cap": F.lit(limit) * F.col("source_size"), "_r": F.lit(limit) * F.col("source_size") / F.col("_w")})
    everything = Window.partitionBy()
    upward = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumns({"_all": F.sum("source_size").over(everything).cast("double"), "_left": before, "_on": onward})
    ranked = ranked.withColumn("_capped", F.col("_r") * F.col("_on") < F.col("_all") - F.col("_left"))
    free = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything)
    fixed = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0.0))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise((F.col("_all") - fixed) * F.col("_w") / free)
    return ranked.select("source", "n_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column, seed: int, *group: str) -> Column:
    """Pivotal fold of ``array<struct<k, s, f>>``: ``struct<up, k, s, f>``.

    Items come by falling size, so that like sizes meet. ``up`` holds the keys rounded up; k, s, f are the one open item (k null if
    none is open). Draws are hashes of the two keys and of what names the group.
    """
    none = F.struct(F.array().cast("array<bigint>").alias("up"), F.lit(None).cast("bigint").alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("f"))

    def made(up: Column, k: Column, s: Column, f: Column) -> Column:
        return F.struct(up.alias("up"), k.alias("k"), s.alias("s"), f.alias("f"))

    def step(a: Column, x: Column) -> Column:
        sa, fa, sx, fx = a["s"], a["f"], x["s"], x["f"]
        give = F.least(sa * (1 - fa), sx * fx)       # words that may go from x to a
        take = F.least(sa * fa, sx * (1 - fx))       # words that may go from a to x
        to_a = _uniform(a["k"], x["k"], F.lit(seed), *map(F.col, group)) * (give + take) < take
        a_full = sa * (1 - fa) <= sx * fx            # a reaches 1 before x reaches 0
        a_empty = sa * fa <= sx * (1 - fx)           # a reaches 0 before x reaches 1
        still = F.lit(1e-9)
        x_left = F.when(to_a, fx - sa * (1 - fa) / sx).otherwise(fx + sa * fa / sx)
        a_left = F.when(to_a, fa + sx * fx / sa).otherwise(fa - sx * (1 - fx) / sa)
        a_done = F.when(to_a, a_full).otherwise(a_empty)
        up = F.when(a_done & to_a, F.array_append(a["up"], a["k"])).when(~a_done & ~to_a, F.array_append(a["up"], x["k"])).otherwise(a["up"])
        k, s, f = F.when(a_done, x["k"]).otherwise(a["k"]), F.when(a_done, sx).otherwise(sa), F.when(a_done, x_left).otherwise(a_left)
        moved = F.when(f <= still, made(up, F.lit(None).cast("bigint"), F.lit(0.0), F.lit(0.0))) \
            .when(f >= 1 - still, made(F.array_append(up, k), F.lit(None).cast("bigint"), F.lit(0.0), F.lit(0.0))) \
            .otherwise(made(up, k, s, f))
        return F.when(a["k"].isNull(), made(a["up"], x["k"], sx, fx)).otherwise(moved)

    return F.aggregate(items, none, step)


def _stats_joined(docs: DataFrame, stats: DataFrame, n_sources: int) -> DataFrame:
    if n_sources <= BROADCAST_ROWS:
        return docs.join(F.broadcast(stats), docs["source"].eqNullSafe(stats["_src"])).drop("_src")
    salts = 32  # a hot source is dealt over so many tasks
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    docs = docs.withColumn("_salt0", F.pmod(F.xxhash64("doc_id", "size", "no"), F.lit(salts)).cast("int"))
    return docs.join(salted, docs["source"].eqNullSafe(salted["_src"]) & (docs["_salt0"] == salted["_salt"])).drop("_src", "_salt", "_salt0")


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``docs`` has doc_id, source, text. Size is the number of words; null text has none. ``copies``
    is how often the mix takes the document (at most LIMIT times) and ``taken`` is size * copies.
    Null is a source of its own, the last. A source without words has target 0. Reruns agree: all
    draws are hashes of source, doc_id, place and ``seed``, whatever the partitions. Rows that repeat a doc_id, source
    and size are counted before they are dealt, and rounded one by one. Other columns are ignored; empty tables
    give no rows.
    """
    alike = docs.select("doc_id", "source", words_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_times"))
    base = written(alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("no")), "sizes")
    stats = written(source_targets(base), "targets")
    n_sources = stats.count()
    due = F.col("target") / F.col("source_size")
    rows = _stats_joined(base, stats.withColumnRenamed("source", "_src"), n_sources)
    rows = rows.withColumns({"due": F.coalesce(F.when(F.col("source_size") > 0, due), F.lit(0.0)), "_n": F.ceil(F.col("n_docs") / FAN_IN)})
    rows = rows.withColumns({"whole": F.floor(F.col("due") + 1e-9), "chunk": F.pmod(F.xxhash64("doc_id", "size", "no", F.lit(seed)), F.col("_n"))})
    rows = rows.withColumn("f", F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)))
    open_ = (F.col("size") > 0) & (F.col("f") > 1e-9)
    closed = rows.where(~open_).select("doc_id", "no", "source", "size", "source_size", "target", F.col("whole").alias("copies"), F.lit(None).cast("boolean").alias("plus"))

    item = F.struct(F.col("doc_id"), F.col("size"), F.col("no"))
    grouped = (rows.where(open_).groupBy("source", "chunk", "source_size", "target", "whole", "f", "_n")
               .agg(F.array_sort(F.collect_list(item)).alias("docs")))
    items = F.transform("docs", lambda d, i: F.struct(i.cast("bigint").alias("k"), d["size"].cast("double").alias("s"), F.col("f").alias("f")))
    shuffled = F.array_sort(F.transform(items, lambda x: F.struct((-x["s"]).alias("o"), F.xxhash64(F.col("docs")[x["k"].cast("int")]["doc_id"], F.lit(seed)).alias("h"), x["k"].alias("k"), x["s"].alias("s"), x["f"].alias("f"))))
    level = written(grouped.withColumn("_first", F.col("docs")[0]["doc_id"]).withColumn("r", _fold(shuffled, seed, "source", "chunk", "_first")).drop("_first"), "chunks")

    levels, depth = [level], 0
    while True:
        width = level.agg(F.max(F.col("chunk")).alias("m")).first()["m"]
        if not width:
            break
        depth += 1
        residual = F.struct((-F.col("r.s")).alias("o"), F.col("chunk").alias("k"), F.col("r.s").alias("s"), F.col("r.f").alias("f"))
        up = (level.where(F.col("r.k").isNotNull()).groupBy("source", F.floor(F.col("chunk") / FAN_IN).alias("chunk"))
              .agg(F.array_sort(F.collect_list(residual)).alias("items")))
        level = written(up.select("source", "chunk", _fold(F.col("items"), seed + depth, "source", "chunk").alias("r")), f"level{depth}")
        levels.append(level)

    # The open item at each root is rounded by its own probability; decisions then go down the tree.
    root = F.col("r.f") > _uniform(F.coalesce("source", F.lit("")), F.lit(seed + 99))
    bits = levels[-1].withColumn("bit", root)
    for below in levels[-2::-1]:
        parent = bits.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.col("r.up").alias("_up"), F.col("r.k").alias("_k"), F.col("bit").alias("_bit"))
        on = below["source"].eqNullSafe(parent["_s"]) & (F.floor(below["chunk"] / FAN_IN) == parent["_c"])
        bit = F.array_contains("_up", F.col("chunk")) | ((F.col("_k") == F.col("chunk")) & F.col("_bit"))
        keep = [*below.columns, F.coalesce(bit, F.lit(False)).alias("bit")]
        bits = below.join(parent, on, "left").select(*keep)
    picked = bits.select("source", "source_size", "target", "whole", "r", "bit", F.posexplode("docs").alias("k", "d"))
    plus = F.coalesce(F.array_contains("r.up", F.col("k").cast("bigint")) | ((F.col("r.k") == F.col("k")) & F.col("bit")), F.lit(False))
    taken = picked.select(F.col("d.doc_id").alias("doc_id"), F.col("d.no").alias("no"), "source", F.col("d.size").alias("size"), "source_size", "target",
                          (F.col("whole") + plus.cast("long")).alias("copies"), plus.alias("plus"))
    out = written(_evened(written(closed.unionByName(taken), "rounded"), n_sources, seed), "evened")
    beyond = written(_overshot(out, n_sources, seed), "beyond")
    if not beyond.isEmpty():
        out = _evened(written(_turned(out, beyond), "overshot"), n_sources, seed + 1)
    return out.drop("no", "plus").withColumn("taken", F.col("size") * F.col("copies"))


def _misses(rounded: DataFrame) -> DataFrame:
    """``_src, _miss, _due``: words taken beyond each source's target (below it: negative)."""
    by = rounded.groupBy(F.col("source").alias("_src")).agg((F.sum(F.col("size") * F.col("copies")) - F.first("target")).alias("_miss"), F.first("target").alias("_due"))
    return by.where(F.abs("_miss") >= 1)


def _turned(rounded: DataFrame, turned: DataFrame) -> DataFrame:
    """The documents of ``turned`` (_src, _id, _no, _size) rounded the other way."""
    on = rounded["source"].eqNullSafe(turned["_src"]) & rounded["doc_id"].eqNullSafe(turned["_id"]) & (rounded["no"] == turned["_no"]) & (rounded["size"] == turned["_size"])
    turn = F.when(F.col("_no").isNotNull(), F.when(F.col("plus"), -1).otherwise(1)).otherwise(0)
    out = rounded.join(turned, on, "left").withColumn("copies", (F.col("copies") + turn).cast("long"))
    return out.withColumn("plus", F.when(F.col("_no").isNotNull(), ~F.col("plus")).otherwise(F.col("plus"))).drop("_src", "_id", "_no", "_size")


def _overshot(rounded: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """For each source that still misses by more than a thousandth of its target, as all that could be turned is larger than the miss:
    the smallest of those, if what it overshoots by can be made up for by smaller ones that were rounded the other way."""
    miss = written(_misses(rounded).where("abs(_miss) > 0.001 * _due").drop("_due"), "misses")
    joined = _stats_joined(rounded.where("plus IS NOT NULL AND size > 0"), miss, n_sources)
    wrong = (F.col("plus") == (F.col("_miss") > 0)) & (F.col("size") > F.abs("_miss"))
    first = F.min(F.when(wrong, F.struct("size", F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", "no"))).alias("_t")
    pick = joined.groupBy(F.col("source").alias("_src")).agg(first, F.abs(F.first("_miss")).alias("_by")).where("_t IS NOT NULL")
    pick = written(pick.select("_src", F.col("_t.doc_id").alias("_id"), F.col("_t.no").alias("_no"), F.col("_t.size").alias("_size"), (F.col("_t.size") - F.col("_by")).alias("_gap")), "picks")
    gaps = pick.select("_src", "_gap")
    back = _stats_joined(joined.where(F.col("plus") == (F.col("_miss") < 0)).drop("_miss"), gaps, n_sources).where("size <= _gap")
    enough = back.groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("_w"))
    return pick.join(enough, pick["_src"].eqNullSafe(enough["_s"])).where("_w >= _gap").select("_src", "_id", "_no", "_size")


def _evened(rounded: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """The rounded documents with each source's miss moved to its smaller documents.

    ``plus`` says which way a document was rounded (null: not at all). Where a source has taken too much, some that were
    rounded up go down, and the other way around: from a draw of about SPARE times the miss in words, so that no
    more is gathered for a source than a few times its largest document, the largest that still fit.
    """
    miss = written(_misses(rounded).drop("_due"), "miss")
    may = F.col("plus").isNotNull() & (F.col("plus") == (F.col("_miss") > 0)) & (F.col("size") <= F.abs("_miss"))
    able = _stats_joined(rounded, miss, n_sources).where(may).select("source", "doc_id", "no", "size", "_miss")
    words = able.groupBy(F.col("source").alias("_src")).agg((SPARE * F.abs(F.first("_miss")) / F.sum("size")).alias("_share"))
    draw = _uniform(F.col("doc_id"), F.col("no"), F.col("size"), F.lit(seed + 7))
    some = _stats_joined(able, written(words, "shares"), n_sources).where(draw <= F.col("_share"))
    item = F.struct((-F.col("size")).alias("o"), F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", "no", "size")
    none = F.struct(F.array().cast("array<struct<doc_id:bigint,no:int,size:bigint>>").alias("ids"), F.col("_left").alias("left"))

    def step(a: Column, x: Column) -> Column:
        took = F.struct(F.array_append(a["ids"], F.struct(x["doc_id"].alias("doc_id"), x["no"].alias("no"), x["size"].alias("size"))).alias("ids"), (a["left"] - x["size"]).alias("left"))
        return F.when(x["size"] <= a["left"], took).otherwise(a)

    listed = some.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("items"), F.floor(F.abs(F.first("_miss"))).cast("bigint").alias("_left"))
    turned = listed.select(F.col("source").alias("_src"), F.explode(F.aggregate("items", none, step)["ids"]).alias("t"))
    turned = written(turned.select("_src", F.col("t.doc_id").alias("_id"), F.col("t.no").alias("_no"), F.col("t.size").alias("_size")), "turned")
    return _turned(rounded, turned)


def repeated(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as ``mixed`` takes it, with all its columns.

    Documents with the same doc_id take the larger of their copies.
    """
    cols = docs.columns
    copies = mixed(docs.select("doc_id", "source", "text"), seed).where("copies > 0")
    copies = copies.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("_row"))
    kept = packed.join(copies.hint("shuffle_hash"), F.col(f"_row.c{cols.index('doc_id')}").eqNullSafe(F.col("_id")))
    kept = kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_c"))
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(cols)])
