"""Ranked lexical search by dense blocked multiplication.

Each item is a row of weights over the terms of its tile's compact vocabulary, each document a row of
impacts over the same terms, and a tile of scores is one matrix product in float64. Weights and impacts
are integers, and a vocabulary tile is so narrow that its sums stay below 2^53; so the product is exact, and
the tiles of a vocabulary are added as 64-bit integers. A worker keeps, for each item, the ten best of
all tiles that it sees, with all ties decided by doc_id; Spark ranks what the workers kept.

Items come in blocks of about BLOCK_BYTES of text; only a block's vocabulary travels to the workers. Documents are
read once for each block: their term counts over the block's vocabulary are written, which serves document
frequencies and scores alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import dropped, pieces, small_batches, written

TOP = 10
#: Text of the items of one block, on average.
BLOCK_BYTES = 1 << 20
ITEM_TILE = 64
DOC_TILE = 1024
VOCABULARY_TILE = 4096

#: Bytes of a text in UTF-8: A-Z are lowered; ASCII that is no letter and no digit parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split(b" ") if text else []


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, ids, tfs``: all terms of a document and those of the vocabulary with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary
        for batch in pieces(batches):
            n, ids, tfs, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = Counter(terms(text))
                found.pop(b"", None)
                n.append(found.total())
                for t in known.keys() & found.keys() if len(found) > len(known) else [t for t in found if t in known]:
                    ids.append(known[t])
                    tfs.append(found[t])
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n bigint, ids array<int>, tfs array<int>")


def _columns(vocabulary: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of those ids that a tile's sorted vocabulary holds, and which those are."""
    at = np.minimum(np.searchsorted(vocabulary, ids), len(vocabulary) - 1)
    hit = vocabulary[at] == ids
    return at[hit], hit


class _Tile:
    """Up to ITEM_TILE items: their compact vocabulary in tiles, and the ten best documents so far."""

    def __init__(self, numbers: list[int], wanted: list[np.ndarray], weight: np.ndarray):
        self.numbers = numbers
        vocabulary = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.int64)
        self.parts = []
        for at in range(0, len(vocabulary), VOCABULARY_TILE):
            some = vocabulary[at:at + VOCABULARY_TILE]
            matrix = np.zeros((len(some), len(numbers)))
            for j, ids in enumerate(wanted):
                column, hit = _columns(some, ids)
                matrix[column, j] = weight[ids[hit]]
            self.parts.append((some, matrix))
        self.item = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.lost = np.empty(0, bool)   # rows without a doc_id
        self.least = np.ones(len(numbers), np.int64)

    def take(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: np.ndarray, lost: np.ndarray) -> None:
        scores = np.zeros((len(docs), len(self.numbers)), np.int64)
        for some, matrix in self.parts:
            column, hit = _columns(some, term)
            dense = np.zeros((len(docs), len(some)))
            dense[row[hit], column] = impact[hit]
            scores += (dense @ matrix).astype(np.int64)
        d, i = np.nonzero(scores >= self.least)
        if not len(d):
            return
        item, score = np.r_[self.item, i], np.r_[self.score, scores[d, i]]
        doc, none = np.r_[self.doc, docs[d]], np.r_[self.lost, lost[d]]
        order = np.lexsort((doc, none, -score, item))
        item, score, doc, none = item[order], score[order], doc[order], none[order]
        first = np.r_[True, item[1:] != item[:-1]]
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
        keep = place < TOP
        self.least[item[place == TOP - 1]] = score[place == TOP - 1]
        self.item, self.score, self.doc, self.lost = item[keep], score[keep], doc[keep], none[keep]


def _best_of_workers(counts: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``item_no, doc_id, score``: what each task found best for each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = list(range(len(items)))
        tiles = [_Tile(numbers[k:k + ITEM_TILE], items[k:k + ITEM_TILE], weight) for k in range(0, len(items), ITEM_TILE)]
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                tile = batch.slice(at, DOC_TILE)
                n = tile.column("n").to_numpy()
                doc = tile.column("doc_id")
                lost = doc.is_null().to_numpy(zero_copy_only=False)
                lengths = tile.column("ids").value_lengths().to_numpy()
                row = np.repeat(np.arange(tile.num_rows), lengths)
                term = tile.column("ids").flatten().to_numpy().astype(np.int64)
                tf = tile.column("tfs").flatten().to_numpy().astype(np.int64)
                m = 10 + (90 * n * n_docs) // max(n_terms, 1)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                for t in tiles:
                    t.take(row, term, impact, doc.fill_null(0).to_numpy(), lost)
        for t in tiles:
            number = np.array(t.numbers, np.int64)[t.item]
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(t.doc, pa.int64(), mask=t.lost), pa.array(t.score)], ["item_no", "doc_id", "score"])

    return counts.mapInArrow(search, "item_no bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` (item_id, text) the TOP best rows of ``docs``
    (doc_id, text) with a score above 0; equal scores by rising doc_id, rows without one last.

    Null and empty texts hold no terms: as documents they count in nothing, as items they find nothing. Rows
    that repeat an id are documents or items of their own. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = written(items.select("item_id", "text"), "items")
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    held, out = [], None
    for block in range(n_blocks):
        # The rows of one block, of a bounded size: what one pass over the documents looks for.
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        wanted = []
        for r in rows:
            own = {t for t in terms(r["text"]) if t}
            wanted.append(np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in own), np.int64))
        counts = written(term_counts(docs, vocabulary), "term_counts")
        held.append(counts)
        facts = counts.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        df = np.zeros(max(len(vocabulary), 1))
        for r in counts.select(F.explode("ids").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term of the block at most
            df[r["t"]] = r["count"]
        weight = np.floor(1000 * np.log((2 * facts["n"] + 2) / (2 * df + 1)))
        best = _best_of_workers(counts, wanted, weight, facts["n"], facts["l"])
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "item_no long, item_id long")
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        top = written(top.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score"), "ranked")
        dropped(counts)
        out = top if out is None else out.unionByName(top)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
