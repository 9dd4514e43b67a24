"""Byte-level BPE with Spark's higher-order functions.

Texts go through in pieces of bounded size. A first pass splits a piece's texts into words and gives
out one row for each word that is new to the task, as its bytes, and then one row for each text, as the
places of its words among the task's. On the word rows a fold merges, step by step, the leftmost adjacent
pair of the lowest rank; ranks come from a literal map, cut into small buckets since Spark searches a
map from its first key on, and a token is held as one character that sorts as its rank does. A second pass puts the ids of the words in the
places of the texts. The three follow each other in one task, whose rows keep their order: nothing is shuffled or sent to the
driver, and what a task holds is one piece and the words it remembers, all of which it forgets when they are many.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import pieces, short_plans, small_batches

PAIR_BUCKETS = 1 << 15
#: Text that is split at a time.
TEXT_BYTES = 4 << 20
#: A task forgets its words before a piece that would begin with more than this; they are folded again where they come again.
REMEMBERED = 400_000
#: Word rows of one Arrow batch.
WORD_ROWS = 5_000
#: Words of more bytes are merged in rounds; the tokens are the same.
LONG_WORD = 64
#: Marks of a merge that is made at one place at a time and of a word in which nothing merges; no token's character.
MARK, DONE = "!", "."


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)``, with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_char(rank: int) -> str:
    """The character that stands for a token in a fold: higher ranks sort later, surrogates are left out."""
    return chr(rank + 0x100 if rank + 0x100 < 0xD800 else rank + 0x900)


def char_ranks(points: np.ndarray) -> np.ndarray:
    """The ranks that code points of ``token_char`` stand for."""
    return points - np.where(points < 0xD800, 0x100, 0x900)


def pair_table(ranks: dict[bytes, int]) -> Column:
    """Ranks of merges as a literal map, cut into buckets by CRC-32: two adjacent tokens, as two
    characters, give the character of the token they make, for every way to cut a token into two.

    A mark follows the character where the merge may not be made everywhere at once: where the new token
    is part of a merge of lower rank, which then comes before the next place, or where two cuts of one
    token can overlap.
    """
    alone = set()
    for piece, rank in ranks.items():
        cuts = list(_cuts(piece, ranks))
        alone |= {x for cut in cuts for x in cut if rank < x}
        if len(cuts) > 1 and {a for a, _ in cuts} & {b for _, b in cuts}:
            alone.add(rank)
    buckets: list[list[str]] = [[] for _ in range(PAIR_BUCKETS)]
    for piece, rank in ranks.items():
        made = json.dumps(token_char(rank) + (MARK if rank in alone else ""), ensure_ascii=False)
        for left, right in _cuts(piece, ranks):
            key = token_char(left) + token_char(right)
            buckets[zlib.crc32(key.encode()) % PAIR_BUCKETS].append(f"{json.dumps(key, ensure_ascii=False)}:{made}")
    return F.from_json(F.lit("[" + ",".join("{" + ",".join(b) + "}" for b in buckets) + "]"), "array<map<string,string>>")


def _cuts(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """The ways to cut a token into two tokens."""
    for k in range(1, len(piece)):
        left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
        if left is not None and right is not None:
            yield left, right


def pair_token(pairs: Column, pair: Column) -> Column:
    """What the table has for two adjacent tokens; null if they do not merge."""
    return F.get(pairs, (F.crc32(pair.cast("binary")) % PAIR_BUCKETS).cast("int"))[pair]


def byte_tokens(word: Column, ranks: dict[bytes, int]) -> Column:
    """A word's bytes (binary), each as the character of its token."""
    known = [b for b in range(256) if bytes([b]) in ranks]
    return F.translate(F.decode(word, "ISO-8859-1"), "".join(map(chr, known)), "".join(token_char(ranks[bytes([b])]) for b in known))


def _merge_one(acc: Column, pairs: Column) -> Column:
    """One step of the fold: all adjacent pairs are looked up and the leftmost of the lowest rank merged."""
    made = F.transform(F.sequence(F.lit(1), F.length(acc) - 1), lambda i: pair_token(pairs, F.substr(acc, i, F.lit(2))))

    def merge(found: Column) -> Column:
        return _let(F.array_min(found), lambda low: F.when(low.isNull(), F.concat(F.lit(DONE), acc)).otherwise(
            _let(F.array_position(found, low).cast("int"), lambda p: F.concat(F.substr(acc, F.lit(1), p - 1), F.left(low, F.lit(1)), F.substr(acc, p + 2)))))

    return _let(made, merge)


def _merge_round(acc: Column, pairs: Column) -> Column:
    """The same for long words: each different pair is looked up once, and where the table allows it the
    merge is made everywhere at once, so a round's cost is in proportion to the word."""
    different = F.array_distinct(F.regexp_extract_all(acc, F.lit("(?s)(?=(..))"), F.lit(1)))

    def merge(x: Column) -> Column:
        def one(low: Column) -> Column:
            pair = F.get(x["pairs"], F.array_position(x["made"], low).cast("int") - 1)
            token = F.left(low, F.lit(1))
            here = _let(F.instr(acc, pair), lambda at: F.concat(F.substr(acc, F.lit(1), at - 1), token, F.substr(acc, at + 2)))
            return F.when(low.isNull(), F.concat(F.lit(DONE), acc)).when(F.length(low) == 1, F.replace(acc, pair, token)).otherwise(here)

        return _let(F.array_min(x["made"]), one)

    return _let(different, lambda d: _let(F.struct(d.alias("pairs"), F.transform(d, lambda p: pair_token(pairs, p)).alias("made")), merge))


def fold_word(tokens: Column, pairs: Column) -> Column:
    """The tokens, as characters, that the ranked merges make of a word's byte tokens: a word of n bytes
    is done after n - 1 steps at most, and what is left of the fold once nothing merges only looks at a
    mark. A minimum over characters is one over ranks."""

    def fold(step) -> Column:  # noqa: ANN001
        over = lambda acc: F.startswith(acc, F.lit(DONE)) | (F.length(acc) < 2)
        steps = F.sequence(F.lit(2), F.length(tokens))
        return F.aggregate(steps, tokens, lambda acc, _: F.when(over(acc), acc).otherwise(step(acc, pairs)), lambda acc: F.replace(acc, F.lit(DONE), F.lit("")))

    return F.when(F.length(tokens) < 2, tokens).when(F.length(tokens) > LONG_WORD, fold(_merge_round)).otherwise(fold(_merge_one))


class _Places(dict):
    """Each new word gets the next place."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _lists(flat: np.ndarray, sizes: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "ids", keep: Sequence[str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """All rows and columns of ``docs`` (which has ``text``), or those named in ``keep``, and the token ids of
    their whole text, ``array<int>``; a column that has the result's name is replaced, any other stays.
    ``also`` may ask for "raw", the ids as ``ids_bytes`` gives them, and "back", the text's bytes ``decoded``
    from the ids, in columns of the result's name with ``_raw`` and ``_back`` behind it.

    Null and empty texts have no ids. Special tokens are ordinary text. Rows that repeat, and rows with
    a null doc_id, are encoded one by one. Empty tables stay empty.
    """
    small_batches(docs.sparkSession)
    short_plans(docs.sparkSession)
    made = {column.lower(), *(f"{column}_{x}".lower() for x in also)}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    text = next(c for c in docs.columns if c.lower() == "text")
    packed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    columns = [T.StructField(f.name, f.dataType, True) for f in packed.schema.fields[:-1]]
    text_at = len(columns)
    tables = [pa.array(byte_table(ranks) if x == "back" else id_table(ranks), pa.binary()) for x in also]
    numbers = T.ArrayType(T.IntegerType(), True)
    split_schema = T.StructType([*columns, T.StructField("word", T.BinaryType()), T.StructField("own", T.StringType()), T.StructField("places", numbers)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        known = _Places()
        for batch in pieces(batches, text_at, TEXT_BYTES):
            if len(known) > REMEMBERED:  # a row of nulls says so
                known = _Places()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (*batch.schema.types[:-1], pa.binary(), pa.string(), pa.list_(pa.int32()))], names)
            old = len(known)
            found = (find(t.as_py() or "") for t in batch.column(text_at))
            places = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in found]
            raw = [w.encode() for w in islice(known, old, None)]
            for start in range(0, len(raw), WORD_ROWS):
                part = raw[start : start + WORD_ROWS]
                # A word that is itself a token is that token, however its merges would go.
                own = [token_char(ranks[w]) if w in ranks else None for w in part]
                nulls = [pa.nulls(len(part), f.type) for f in batch.schema][:-1]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(part, pa.binary()), pa.array(own, pa.string()), pa.nulls(len(part), pa.list_(pa.int32()))], names)
            flat = np.concatenate(places) if places else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.nulls(batch.num_rows, pa.binary()), pa.nulls(batch.num_rows, pa.string()), _lists(flat, [len(p) for p in places])], names)

    names = [f.name for f in split_schema.fields]
    n = len(columns)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[pa.Array] = []  # words that are not among those of flat yet
        flat, starts, lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)
        for batch in batches:
            places = batch.column(n)  # after the columns kept, before the words
            is_word = places.is_null().to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(is_word)) + 1, len(is_word)] if len(is_word) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if is_word[lo]:
                    words = batch.column(n + 1).slice(lo, hi - lo)
                    if words.null_count:  # the row of nulls, before the words of its piece
                        new, flat, lengths = [], flat[:0], lengths[:0]
                        words = words.slice(int(np.flatnonzero(words.is_null())[-1]) + 1)
                    new.append(words)
                    continue
                if new:
                    tokens = pa.chunked_array(new, pa.string())
                    points = "".join(tokens.to_pylist()).encode("utf-32-le")
                    flat = np.concatenate([flat, char_ranks(np.frombuffer(points, "<u4").astype(np.int32)).astype(np.int32)])
                    lengths = np.concatenate([lengths, pc.utf8_length(tokens).to_numpy()])
                    starts, new = np.cumsum(lengths, dtype=np.int64) - lengths, []
                for at in range(lo, hi, 256):
                    part = places.slice(at, min(256, hi - at))
                    words = part.flatten().to_numpy(zero_copy_only=False)
                    each = lengths[words]
                    ends = np.cumsum(each, dtype=np.int64)
                    found = flat[np.repeat(starts[words] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
                    bounds = np.r_[0, ends][np.r_[0, np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))]]
                    rows = [batch.column(i).slice(at, len(part)) for i in range(n)]
                    more = [_joins(found, bounds, table) for table in tables]
                    yield pa.RecordBatch.from_arrays([*rows, _lists(found, np.diff(bounds)), *more], out_names)

    result = T.StructType([*columns, T.StructField("ids", numbers), *[T.StructField(f"ids_{x}", T.BinaryType()) for x in also]])
    out_names = [f.name for f in result.fields]
    words = packed.mapInArrow(split, split_schema)
    # The table stands in the plan once, however often the fold looks into it.
    tokens = _let(pair_table(ranks), lambda pairs: _let(byte_tokens(F.col("word"), ranks), lambda t: fold_word(t, pairs)))
    # It is in the last column, which the text of a plan leaves out.
    folded = words.select(*names[:n], "places", F.when(F.col("word").isNotNull(), F.coalesce("own", tokens)).alias("word"))
    out = folded.mapInArrow(assemble, result)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(column), *[F.col(f"ids_{x}").alias(f"{column}_{x}") for x in also])


def byte_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The binary piece of each id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return table


def id_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Each id as a little-endian unsigned 32-bit integer."""
    return [i.to_bytes(4, "little") for i in range(max(ranks.values(), default=-1) + 1)]


def _joins(ids: np.ndarray, bounds: np.ndarray, table: pa.BinaryArray) -> pa.BinaryArray:
    """For each run of ids between two bounds, its pieces of the table one after the other."""
    _, ends, data = table.take(pa.array(ids)).buffers()
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.frombuffer(ends, np.int32)[bounds]), data])


def _join(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def _joined(ids: Column, table: list[bytes]) -> Column:
    @F.pandas_udf("binary")
    def join(batch: pd.Series) -> pd.Series:
        return pd.Series([_join(x, table) for x in batch])

    return join(F.coalesce(ids, F.array().cast("array<int>")))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids stand for: the concatenation of their binary pieces (empty for null)."""
    return _joined(ids, byte_table(ranks))


def ids_bytes(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Ids as little-endian unsigned 32-bit integers, one after the other (empty for null)."""
    return _joined(ids, id_table(ranks))
