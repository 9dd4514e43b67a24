"""Repeated 50-byte strings across documents by distributed prefix doubling.

Prefix doubling names the string of length h at a position by a rank, and gets the names for 2h by
sorting pairs of ranks that stand h apart, until a position is unique or the length is reached.
Here the threshold is T = 50 bytes, and names are 64-bit hashes, which double without a sort inside
a document: 1, 2, 4, 8, 16, 24 and 25 bytes. What Spark sorts are the names of sampled positions:

1. h = 25. Of the 26 25-byte strings in a 50-byte window one has the smallest name: the window's
   anchor. Equal windows have equal anchors, so only anchors are sorted, about 2 of 27 positions. An
   anchor whose name occurs in one document only is unique and drops out with all its windows.
2. Windows in a row that share an anchor form a block. Blocks are named by all their bytes and
   sorted by (anchor, name): a document that is not the first to hold a block loses all its windows.
3. h = 50. Where one anchor has blocks of several names, the first holder's windows are named by the
   pair of ranks (25 bytes, 25 bytes further on) and sorted; those that a smaller document holds go.

Every row that is sorted belongs to one anchor, block or window, never to a pair of documents.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.llm.common import dropped, written

LENGTH = 50
HALF = LENGTH // 2
#: Starts of one block, at most (only periodic texts reach it).
LONGEST_BLOCK = 256

_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = (np.random.default_rng(6).integers(1, 1 << 62, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Names of doubled strings from the names of their halves; the multiplier keeps their order."""
    n = min(len(left), len(right))
    return left[:n] * _ODD[step] + right[:n]


def half_names(raw: np.ndarray) -> np.ndarray:
    """The name of the 25 bytes at every position of a document of at least 25 bytes."""
    one = _BYTES[raw]
    two = _pair(one, one[1:], 0)
    four = _pair(two, two[2:], 1)
    eight = _pair(four, four[4:], 2)
    sixteen = _pair(eight, eight[8:], 3)
    return _mixed(_pair(_pair(sixteen, eight[16:], 4), one[24:], 5))


def anchors(names: np.ndarray) -> np.ndarray:
    """For every window start the smallest of the 26 names in its window (needs 26 names)."""
    low = names
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    return np.minimum(low[:-10], low[10:])


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for text in batch.column(column):
        raw = text.as_buffer() if text.is_valid else None
        yield np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)


def _emit(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(p) if p else np.empty(0, np.int64), pa.int64()) for p in parts]
    return pa.RecordBatch.from_arrays(arrays, names)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``h, doc_id``: each anchor name of each document, once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, held = [], [], 0
            for doc, raw in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                if len(raw) >= LENGTH:
                    h.append(np.unique(anchors(half_names(raw))).view(np.int64))
                    d.append(np.full(len(h[-1]), doc, np.int64))
                    held += len(h[-1])
                if held > 200_000:
                    yield _emit([h, d], ["h", "doc_id"])
                    h, d, held = [], [], 0
            yield _emit([h, d], ["h", "doc_id"])

    return docs.mapInArrow(emit, "h bigint, doc_id bigint")


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    return docs.join(lists.hint("shuffle_hash"), "doc_id")


def block_rows(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``h, name, doc_id, start, n``: the blocks of shared anchors; ``shared`` has doc_id, hs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["h", "name", "doc_id", "start", "n"]
        for batch in batches:
            out, held = [[] for _ in columns], 0
            lists = batch.column(2)
            for k, (doc, raw) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True)):
                if len(raw) < LENGTH:
                    continue
                half = half_names(raw)
                low = anchors(half)
                wanted = np.sort(lists[k].values.to_numpy().view(np.uint64))
                at = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
                here = np.flatnonzero(wanted[at] == low)
                if not len(here):
                    continue
                breaks = np.flatnonzero((np.diff(here) != 1) | (low[here][1:] != low[here][:-1])) + 1
                runs = np.r_[0, breaks]
                run = np.repeat(runs, np.diff(np.r_[runs, len(here)]))
                index = np.arange(len(here)) - run
                first = np.flatnonzero(index % LONGEST_BLOCK == 0)
                index = (index % LONGEST_BLOCK).astype(np.uint64)
                whole = _pair(half, half[HALF:], 6)[here]
                name = np.add.reduceat(_mixed(_mixed(whole) + index * _ODD[7]), first)
                n = np.diff(np.r_[first, len(here)])
                for o, v in zip(out, (low[here][first].view(np.int64), name.view(np.int64), np.full(len(first), doc, np.int64), here[first], n), strict=True):
                    o.append(v)
                held += len(first)
                if held > 100_000:
                    yield _emit(out, columns)
                    out, held = [[] for _ in columns], 0
            yield _emit(out, columns)

    return _with_lists(docs, shared).select("doc_id", "text", "hs").mapInArrow(emit, "h bigint, name bigint, doc_id bigint, start bigint, n bigint")


def window_rows(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``p, q, doc_id, start``: the pair of half names of every window in the listed ranges."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["p", "q", "doc_id", "start"]
        for batch in batches:
            out, held = [[] for _ in columns], 0
            for k, (doc, raw) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True)):
                if len(raw) < LENGTH:
                    continue
                half = half_names(raw)
                at = _covered(batch.column(2)[k], len(raw) - LENGTH + 1, 0)
                for o, v in zip(out, (half[at].view(np.int64), half[at + HALF].view(np.int64), np.full(len(at), doc, np.int64), at), strict=True):
                    o.append(v)
                held += len(at)
                if held > 100_000:
                    yield _emit(out, columns)
                    out, held = [[] for _ in columns], 0
            yield _emit(out, columns)

    return _with_lists(docs, lists).select("doc_id", "text", "ranges").mapInArrow(emit, "p bigint, q bigint, doc_id bigint, start bigint")


def _covered(ranges: pa.Scalar, size: int, extra: int) -> np.ndarray:
    """Positions below ``size`` in any of the ranges (start, n), each made longer by ``extra``."""
    steps = np.zeros(size + 1, np.int64)
    if ranges.is_valid and size > 0:
        values = ranges.values
        start = np.minimum(values.field("start").to_numpy(), size)
        np.add.at(steps, start, 1)
        np.add.at(steps, np.minimum(start + values.field("n").to_numpy() + extra, size), -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of rounds that are over, before the next round's are made."""
    for _ in range(3):  # plans are let go of by Python first, then by the JVM, then by Spark's cleaner
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_removed, n_spans, kept``.

    ``kept`` is the text's UTF-8 bytes without those covered by a 50-byte string that also starts in
    a document with a smaller doc_id; n_spans counts the maximal runs removed. Null text is empty.
    Texts below 50 bytes and rows with null doc_id lose nothing and take nothing from others.
    doc_id is a key: rows that repeat it with the same text get the same result; with other texts,
    a range found in one of them is removed from all. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    able = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    of_anchor = Window.partitionBy("h")
    shared = (anchor_rows(able).withColumns({"lo": F.min("doc_id").over(of_anchor), "hi": F.max("doc_id").over(of_anchor)})
              .where("lo < hi").groupBy("doc_id").agg(F.collect_list("h").alias("hs")))
    shared = written(shared, "shared_anchors")
    _release(spark)
    of_block = Window.partitionBy("h", "name")
    blocks = block_rows(able, shared).repartition("h")
    blocks = blocks.withColumns({"several": F.min("name").over(of_anchor) != F.max("name").over(of_anchor), "first": F.min("doc_id").over(of_block)})
    blocks = written(blocks.where("several OR doc_id > first").select("doc_id", "start", "n", "first"), "blocks")
    dropped(shared)
    _release(spark)
    of_window = Window.partitionBy("p", "q")
    windows = (window_rows(able, _ranges(blocks.where("doc_id = first"))).withColumn("first", F.min("doc_id").over(of_window))
               .where("doc_id > first").select("doc_id", "start", F.lit(1).cast("long").alias("n")))
    windows = written(windows, "window_starts")
    _release(spark)
    gone = written(_ranges(blocks.where("doc_id > first").select("doc_id", "start", "n").unionByName(windows)), "removed_ranges")
    dropped(blocks)
    dropped(windows)
    _release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for k, raw in enumerate(_texts(batch, 1)):
                at = _covered(batch.column(2)[k], len(raw), LENGTH - 1)
                keep = np.ones(len(raw), bool)
                keep[at] = False
                row = (len(raw), len(at), int((np.diff(at) > 1).sum()) + int(len(at) > 0), raw[keep].tobytes())
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, out, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(gone.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
