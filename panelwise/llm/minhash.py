"""Near duplicates by one-permutation MinHash with optimal densification.

A document's set is its distinct five-word shingles. One hash of each shingle puts it in one of
BANDS * ROWS bins; a bin keeps its smallest hash, and an empty bin copies a bin that its own fixed
random order names first among those that are not empty. ROWS bins make a band, and documents with
equal bands share a bucket. Documents with equal sets are one class, represented once.

Every bucket proposes a star: each member against one centre, so a bucket of m documents gives m - 1
pairs. Pairs are confirmed on the full sets. The documents of buckets whose members are then still
in different components are compared once more, by a join on their rarest shingles that loses no
link between them and that leaves out, before it joins, what is in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import dropped, mixed_bits, pieces, small_batches, written
from panelwise.llm.components import connected_components

WORDS = 5
#: Links need 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: A pair at the threshold shares no bucket with probability (1 - 0.75 ** ROWS) ** BANDS = 5e-6.
BANDS, ROWS = 32, 4
#: Ids of candidates up to this many (8 bytes each) are sent to the scan of the documents.
BROADCAST_IDS = 500_000

_BINS = BANDS * ROWS
_SHIFT = np.uint64(64 - int(_BINS - 1).bit_length())
_ORDERS = np.array([np.random.default_rng(1000 + j).permutation(_BINS) for j in range(_BINS)])
_STARTS = np.arange(_BINS, dtype=np.uint64) << _SHIFT


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text (none for null or no words).

    bytes.lower and bytes.split know ASCII letters and ASCII white space only, as asked for.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(len(words), WORDS)
    if n == 0:
        return np.empty(0, np.uint64)
    w = np.fromiter((known[x] for x in words), np.uint64, len(words))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(mixed_bits(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified bins of a sorted, not empty set of hashes, one row for each band."""
    first = np.searchsorted(shingles, _STARTS)
    bins = np.minimum(first, len(shingles) - 1)
    occupied = (shingles[bins] >> _SHIFT == np.arange(_BINS, dtype=np.uint64)) & (first < len(shingles))
    donor = np.arange(_BINS)
    empty = ~occupied
    if empty.any():
        orders = _ORDERS[empty]
        donor[empty] = orders[np.arange(len(orders)), occupied[orders].argmax(axis=1)]
    return shingles[bins[donor]].reshape(BANDS, ROWS)


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed_bits(key * np.uint64(0x9E3779B97F4A7C15) + bins[:, k])
    return key


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands``; set_key is null and bands are empty for an empty set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            n, keys, bands = [], [], []
            none = np.empty(0, np.int64)
            for text in batch.column(1):
                s = shingle_set(text.as_py(), known)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id bigint, n_shingles bigint, set_key string, bands array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """``doc_id, hs`` (the 64-bit shingle hashes, sorted as unsigned) of the documents in ``ids`` (doc_id,
    distinct), which has ``most`` rows or fewer."""
    few = most <= BROADCAST_IDS
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            made = pa.array([shingle_set(t.as_py(), known).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), made], ["doc_id", "hs"])

    return chosen.mapInArrow(sets, "doc_id bigint, hs array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b) whose full sets reach the similarity. Where rows repeat an id with other
    texts, a pair is confirmed if it is for any of the rows."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = written(full_sets(docs, ids, 2 * pairs.count()), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("hs").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hs").alias("sb"))
    both, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    links = written(pairs.join(right, "b").join(left, "a").where((100 + SIMILARITY) * both >= SIMILARITY * total).select("a", "b"), "confirmed")
    dropped(sets)
    return links


def prefixes(named: DataFrame, docs: DataFrame) -> DataFrame:
    """``h, rep, c, n, most``: the shingles of ``named`` documents (rep, c) by which they can be found.

    Sets are put in one order, rarest shingles first. With i shingles of a set of n before it, a first
    common shingle leaves n - i common ones at most, and a link to a set of m needs
    SIMILARITY / (100 + SIMILARITY) * (n + m) of them; so ``most`` is the largest m that the shingle
    may link to, and shingles that cannot link to a set as small as SIMILARITY % of n are left out.
    """
    sets = written(full_sets(docs, named.select(F.col("rep").alias("doc_id")), named.count()), "rest_sets")
    keyed = sets.select(F.col("doc_id").alias("rep"), F.xxhash64("hs").alias("set"), "hs")
    one = keyed.select("rep", "set", F.explode("hs").alias("h"))
    common = one.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = one.join(common, "h", "left").groupBy("rep", "set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "h"))).alias("hs"))
    n = F.size("hs")
    prefix = F.slice("hs", F.lit(1), n - F.ceil(n * SIMILARITY / 100).cast("int") + 1)
    placed = ranked.select("rep", n.alias("n"), F.posexplode(prefix).alias("i", "x")).where("x.f > 1")
    most = F.floor(F.expr(f"(n - i) * {100 + SIMILARITY} / {SIMILARITY}")) - F.col("n")
    return placed.select("x.h", "rep", "n", most.alias("most")).join(named, "rep")


def fruitful(rows: DataFrame) -> DataFrame:
    """The ``rows`` of ``prefixes`` whose shingle also stands in another component, for a set that is
    small enough for the row and that may link to one as large as the row's.

    All it needs of a shingle is the smallest n and the largest ``most`` of any component and of any
    other one, so a family of any size whose members are linked already costs one row a component.
    """
    by = rows.groupBy("h", "c").agg(F.min("n").alias("n"), F.max("most").alias("most"))
    lowest, highest = F.struct("n", "c"), F.struct("most", "c")
    ends = by.groupBy("h").agg(F.min(lowest).alias("low"), F.max(highest).alias("high"), F.count(F.lit(1)).alias("components")).where("components > 1")
    other = by.join(ends, "h").groupBy("h").agg(
        F.first("low").alias("low"), F.first("high").alias("high"),
        F.min(F.when(F.col("c") != F.col("low.c"), F.col("n"))).alias("low2"), F.max(F.when(F.col("c") != F.col("high.c"), F.col("most"))).alias("high2"))
    smallest = F.when(F.col("low.c") != F.col("c"), F.col("low.n")).otherwise(F.col("low2"))
    widest = F.when(F.col("high.c") != F.col("c"), F.col("high.most")).otherwise(F.col("high2"))
    return rows.join(other, "h").where((smallest <= F.col("most")) & (widest >= F.col("n"))).select(*rows.columns)


def prefix_pairs(named: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs (a, b) of ``named`` (rep, c) in different components c that may be linked.

    No link is lost: a linked pair's first common shingle, in the order of ``prefixes``, passes every test.
    """
    rows = written(prefixes(named, docs), "prefixes")
    rows = written(fruitful(rows), "fruitful")
    other = rows.select("h", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("most").alias("mosta"))
    fits = (F.col("n") <= F.col("mosta")) & (F.col("na") <= F.col("most"))
    pairs = rows.join(other, "h").where((F.col("a") < F.col("rep")) & (F.col("c") != F.col("ca")) & fits).select("a", F.col("rep").alias("b")).distinct()
    return written(pairs, "rest_pairs")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id, kept``.

    Null text is empty; empty sets (n_shingles 0) link with nothing. component_id is the smallest
    doc_id of the component and kept tells whether it is the row's own. doc_id is a key: rows that
    repeat one are taken as one node if their sets are equal, and otherwise link as one node with
    either set's partners. Rows with null doc_id have a null component and are kept. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = written(described(docs), "described")
    classes = (rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key")
               .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    classes = written(classes, "classes")
    member = F.explode("bands").alias("key")
    sizes = written(classes.select(member).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket_sizes")
    crowd = classes.select(member, "rep", "n").join(sizes, "key")
    # The document an edited family was made from lies in the family's large buckets in every band,
    # its edited copies in some of them: the member with the most company is the centre.
    company = crowd.groupBy("rep").agg(F.sum("size").alias("company"))
    crowd = written(crowd.join(company, "rep"), "crowd")
    buckets = crowd.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("company", -F.col("rep"))).alias("centre"))
    rows_in = written(crowd.join(buckets, "key"), "members")

    def fits(n1: str, n2: str) -> F.Column:
        return 100 * F.least(n1, n2) >= SIMILARITY * F.greatest(n1, n2)

    star = (rows_in.where(F.col("rep") != F.col("centre.rep")).where(fits("n", "centre.n"))
            .select(F.least("centre.rep", "rep").alias("a"), F.greatest("centre.rep", "rep").alias("b")).distinct())
    links = confirmed(written(star, "pairs"), docs)
    label = connected_components(links)
    # Only documents of buckets whose members are in different components go on.
    named = rows_in.select("key", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    named = written(named.join(mixed, "key", "left_semi").groupBy("rep").agg(F.first("c").alias("c")), "named")
    rest = prefix_pairs(named, docs)
    if rest.limit(1).count():
        links = written(links.unionByName(confirmed(rest, docs)), "all_links")
        label = connected_components(links)
    reps = classes.select("set_key", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns."""
    out = written(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dropped_ids")
    few = out.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(out) if few else out.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
