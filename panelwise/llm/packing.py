"""Best-fit packing of token pieces into sequences under several capacities at once.

A document's token ids, with a separator behind, are cut only where they are longer than a sequence. What
is packed then are the pieces' demands, each a vector: tokens, documents (1) and attention cost (length
squared). A piece goes, longest first, to the open sequence that has room for it in every capacity and
that scores best: by the weighted residual norm left behind (the tightest fit), or by the weighted dot
product of demand and residual (the fit most alike in shape).

On Spark: tokens are made where the texts are, and only the pieces' sizes go on. They are dealt over chunks
of about CHUNK pieces and each chunk is packed by itself. Sequences that a chunk leaves with room are
opened again and their pieces dealt anew, among fewer chunks, for ROUNDS rounds, so that what a
chunk wastes at its end is used by others. No task sees more than some chunks and the driver sees counts only.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import dropped, pieces as text_pieces, small_batches, written

#: Pieces of one chunk, on average.
CHUNK = 4096
ROUNDS = 3
#: A sequence with this share of its tokens or less unused is not opened again.
SLACK = 1 / 256
#: Distinct words whose ids a worker remembers; beyond it forgets all and goes on.
REMEMBERED = 400_000
#: Longer words are encoded each time.
LONG_WORD = 64
SEPARATOR = 0


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how much each kind of residual counts when sequences are compared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def __post_init__(self) -> None:
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"no rule {self.rule}")
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2:
            raise ValueError("a sequence must hold one full piece")


#: The tokenizer's split of lowered text, for the characters up to U+00FF: letters, digits one by one, and runs of what is neither
#: those nor white space.
_LATIN_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+".format(r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d\x20\x85\xa0")


def is_latin(text: str) -> bool:
    """Whether no character is above U+00FF: such text is in normal form already and is lowered character by character."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _words_alone(path: str) -> bool:
    """Whether the tokenizer drops white space and lowers case before it splits words off, so that a text's
    ids are those of its words one after the other."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
    return (steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
            and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and splits[0].get("invert") and not told.get("post_processor"))


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit integers.

    Where ids are those of the words one after the other, a word is encoded once for as long as it is
    remembered. Texts of Latin-1 characters are lowered and split here by the tokenizer's own pattern and
    their parts merged by its model; words of others go to the tokenizer as they are. Special tokens'
    strings are ordinary text.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    raw = lambda ids: np.asarray(ids, "<u4").tobytes()

    if not _words_alone(path):
        return lambda texts: [raw(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    model, bytewise = tokenizer.model, tokenizer.pre_tokenizer[1]
    split = re.compile(_LATIN_PARTS).findall
    parts: dict[str, bytes] = {}
    words: dict[str, bytes] = {"": b""}

    def forget(memory: dict[str, bytes]) -> None:
        if len(memory) >= REMEMBERED:
            memory.clear()
            memory[""] = b""

    def latin(texts: list[str]) -> list[bytes]:
        split_up = [split(t.lower()) for t in texts]
        forget(parts)
        new = set().union(*split_up).difference(parts)
        for p in new:
            units = p if p.isascii() and p.isprintable() else bytewise.pre_tokenize_str(p)[0][0]
            parts[p] = array("I", [t.id for t in model.tokenize(units)]).tobytes()
        out = [b"".join([parts[p] for p in one]) for one in split_up]
        for p in new:
            if len(p) > LONG_WORD:
                del parts[p]
        return out

    def other(texts: list[str]) -> list[bytes]:
        split_up = [t.replace("\n", " ").split(" ") for t in texts]
        forget(words)
        new = list(set().union(*split_up).difference(words))
        words.update(zip(new, (raw(e.ids) for e in tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
        out = [b"".join([words[w] for w in one]) for one in split_up]
        for w in new:
            if len(w) > LONG_WORD:
                del words[w]
        return out

    def encoded(texts: list[str]) -> list[bytes]:
        plain = [is_latin(t) for t in texts]
        one, two = (iter(f([t for t, q in zip(texts, plain, strict=True) if q == k])) for f, k in ((latin, True), (other, False)))
        return [next(one if q else two) for q in plain]

    return encoded


def token_pieces(docs: DataFrame, path: str, size: int = 2048, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``: the pieces of each row of ``docs``
    (doc_id, text).

    A document is its ids and the separator; only one of more than ``size`` ids is cut, and every piece but the last is
    full. Null and empty texts are one piece of the separator. Rows that repeat a doc_id and rows without one are
    documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    end = SEPARATOR.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in text_pieces(batches):
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for d, whole in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                whole += end
                for k, at in enumerate(range(0, len(whole), 4 * size)):
                    one = whole[at:at + 4 * size]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(one) // 4)
                    crc.append(zlib.crc32(one))
                    if ids:
                        kept.append(np.frombuffer(one, "<u4").astype(np.int64))
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if ids:
                arrays.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, room: Capacity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces by falling length: sequence of each, its place there, and the tokens that each sequence leaves unused."""
    most = np.array([room.tokens, room.documents, room.attention], float)
    weights = np.array(room.weights)
    bins, places = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((len(lengths), 3))      # what the open sequences have left, in shares of the capacity
    names = np.empty(len(lengths), np.int64)
    unused = np.zeros(len(lengths))
    n_open = made = 0
    smallest = lengths[-1] / room.tokens if len(lengths) else 0.0
    for i, size in enumerate(lengths):
        need = np.array([size, 1.0, float(size) ** 2]) / most
        at = left[:n_open]
        fits = np.flatnonzero((at >= need - 1e-12).all(axis=1)) if n_open else ()
        if len(fits):
            after = at[fits] - need
            score = (weights * after * after).sum(axis=1) if room.rule == "norm" else -(weights * need * at[fits]).sum(axis=1)
            k = fits[int(np.argmin(score))]
            bins[i] = names[k]
            places[i] = round((1 - left[k, 0]) * room.tokens)
            left[k] -= need
        else:
            k, bins[i] = n_open, made
            left[k], names[k] = 1 - need, made
            made, n_open = made + 1, n_open + 1
        unused[names[k]] = round(left[k, 0] * room.tokens)
        if left[k, 0] < smallest - 1e-12 or left[k, 1] * room.documents < 0.5:  # nothing fits any more
            n_open -= 1
            left[k], names[k] = left[n_open], names[n_open]
    return bins, places, unused[:made]


def _packed_round(rows: DataFrame, room: Capacity, number: int, n_chunks: int) -> DataFrame:
    """One round: rows with sequence_id, offset and ``unused`` of their sequence."""
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(n_chunks)))
    dealt = chunked.repartition("chunk").sortWithinPartitions("chunk", F.desc("length"), "doc_id", "piece", "uid")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_chunk(table: pa.Table) -> pa.RecordBatch:
            bins, places, unused = best_fit(table["length"].to_numpy(), room)
            base = (number << 56) + (int(table["chunk"][0].as_py()) << 22)
            added = [pa.array(base + bins, pa.int64()), pa.array(places, pa.int64()), pa.array(unused[bins].astype(np.int64), pa.int64())]
            columns = [table[c].combine_chunks() for c in names] + added
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [*names, "sequence_id", "offset", "unused"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                chunk = batch.column("chunk").to_numpy()
                if held and held[0].column("chunk")[0].as_py() != chunk[0]:
                    yield of_chunk(pa.Table.from_batches(held))
                    held = []
                stop = int(np.searchsorted(chunk, chunk[0], "right"))
                held.append(batch.slice(0, stop))
                batch = batch.slice(stop)
                if batch.num_rows:
                    yield of_chunk(pa.Table.from_batches(held))
                    held = []
        if held:
            yield of_chunk(pa.Table.from_batches(held))

    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id bigint, offset bigint, unused bigint"
    return dealt.mapInArrow(pack, schema)


def packed(pieces: DataFrame, room: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Every piece stands in one sequence, pieces of a sequence follow each other without gaps from 0, and no
    sequence exceeds a capacity. A piece longer than a sequence is refused. An empty table gives no rows.
    """
    rows = written(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("uid")), "pieces")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    if facts["longest"] and facts["longest"] > room.tokens:
        raise ValueError(f"a piece of {facts['longest']} tokens in sequences of {room.tokens}")
    spare = int(room.tokens * SLACK)
    done, left, n_left, made = [], rows, facts["n"], []
    for number in range(ROUNDS):
        n_chunks = max(1, -(-n_left // CHUNK))
        out = written(_packed_round(left, room, number, n_chunks), f"round{number}")
        made.append(left)
        if n_chunks == 1 or number == ROUNDS - 1:
            done.append(out)
            break
        done.append(out.where(F.col("unused") <= spare))
        left = out.where(F.col("unused") > spare).select(rows.columns)
        n_left = left.count()
        if not n_left:
            break
    dropped(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("unused", "uid")


def sequences(docs: DataFrame, path: str, room: Capacity = Capacity()) -> DataFrame:
    """The training sequences themselves: ``sequence_id, ids, doc_ids, starts``, where ``starts`` has the offset of each
    document's piece. doc_id is a key here: pieces meet their ids by (doc_id, piece, ids_crc32)."""
    whole = written(token_pieces(docs, path, room.tokens, ids=True), "token_pieces")
    placed = packed(whole.drop("ids"), room)
    key = ["doc_id", "piece", "ids_crc32"]
    once = whole.select(*key, "ids").dropDuplicates(key)
    on = placed["doc_id"].eqNullSafe(once["doc_id"]) & (placed["piece"] == once["piece"]) & (placed["ids_crc32"] == once["ids_crc32"])
    one = placed.join(once, on).select("sequence_id", F.struct(placed["offset"].alias("offset"), placed["doc_id"].alias("doc_id"), once["ids"].alias("ids")).alias("p"))
    listed = one.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most ``tokens`` ids a sequence
    return listed.select("sequence_id", F.flatten("ps.ids").alias("ids"), F.col("ps.doc_id").alias("doc_ids"), F.col("ps.offset").alias("starts"))
