"""Spelling variants by a relational trie frontier.

The trie of all words is a table of edges (node, next character, child); a node is the hash of a prefix.
A frontier of states (word, position, node, edits) is joined with the edges of its nodes, level by level:

- a state without an edit follows its own character and, beside it, takes each other one as a replaced
  or an inserted character;
- a state with one edit follows its word only;
- an edge with at most two words below is a container: its words become candidate neighbours at once.

Only the neighbour that is longer or, of equal length, greater is sought, so each pair is made once: a
deletion is an insertion seen from the other word. Of two words one edit apart either the first half of
the shorter agrees or its second half does. So a frontier starts at the node of the word's first half, and a
second one, in the trie of reversed words, at that of its second half; the dense top of the trie is never
searched. What stands two characters further down an edge, and how many characters are left there, is kept as
bits with the edge, and a state whose word asks for something else ends before it is made. Hashes may collide, which
adds candidates and loses none; all candidates are held against the words themselves.

Words of LONGEST_WALK characters or more would take a level for each character that they share. Their pairs come from
hashes of the word with one character taken out or left open, in rows that grow with their lengths.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import dropped, mixed_bits, pieces, small_batches, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs this many times as often as the word at least.
FORM_FACTOR = 2
#: Where this divides the hash of (document, run), the run loses a character.
MISSPELT = 97
#: Distinct words that a worker counts before it sends them on.
HELD = 300_000
#: Words from this length on are not walked: a walk has a level for each character.
LONGEST_WALK = 64
#: Words of an edge that are compared directly.
CONTAINER = 2

#: Latin-1 bytes: A-Z are lowered; what is neither A-Z, a-z nor above 0xBF parts runs.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_SEEDS = np.array([0x2545F4914F6CDD1D, 0x6A09E667F3BCC909], np.uint64)


def runs(text: str | None) -> list[bytes]:
    """The lowered runs of Latin letters of a text, in Latin-1, with empty ones between."""
    return text.encode("latin-1", "replace").translate(_RUNS).split(b" ") if text else []


def kept_run(doc_id: int | None, run: bytes) -> bytes:
    """A run as it is counted: without one character where the hash of (document, run) says so."""
    told = b"null" if doc_id is None else b"%d" % doc_id
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(told + b":"))
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in Counter(runs(text)).items():
                    if len(run) >= LEAST_LENGTH:
                        word = kept_run(doc, run)
                        if len(word) >= LEAST_LENGTH:
                            total[word] += n
                if len(total) >= HELD:
                    yield sent()
                    total.clear()
        yield sent()

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class _Prefixes:
    """Hashes of all prefixes of a batch of words, read from one side."""

    def __init__(self, words: list[bytes], backward: bool):
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer(b"".join(w[::-1] for w in words) if backward else b"".join(words), np.uint8)
        place = np.arange(len(self.codes)) - np.repeat(self.first, self.size)
        powers = np.cumprod(np.full(int(self.size.max(initial=0)) + 1, _BASE, np.uint64), dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(_CODES[self.codes] * powers[place], dtype=np.uint64)]
        self.seed = _SEEDS[int(backward)]

    def node(self, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        at = self.first[word]
        return mixed_bits(self.sums[at + depth] - self.sums[at] + self.seed + depth.astype(np.uint64) * _SEEDS[1]).view(np.int64)

    def code(self, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The character behind a prefix; 0 at the word's end and beyond."""
        here = depth < self.size[word]
        return np.where(here, self.codes[np.where(here, self.first[word] + depth, 0)], 0) if len(self.codes) else np.zeros(len(word), np.uint8)


def _start(size: np.ndarray, backward: bool) -> np.ndarray:
    return (size + 1) // 2 if backward else size // 2


def _latin(batch: pa.RecordBatch) -> list[bytes]:
    return [w.encode("latin-1") for w in batch.column("word").to_pylist()]


def start_states(words: DataFrame) -> DataFrame:
    """``word, n, back, pos, node``: where the two frontiers of each word start; ``word`` is reversed in the second."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _latin(batch)
            every = np.arange(len(own))
            for back in (False, True):
                trie = _Prefixes(own, back)
                pos = _start(trie.size, back)
                read = [w[::-1].decode("latin-1") for w in own] if back else batch.column("word")
                columns = [pa.array(read, pa.string()) if back else read, batch.column("n"), pa.array(np.full(len(own), back)), pa.array(pos.astype(np.int32)), pa.array(trie.node(every, pos))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "back", "pos", "node"])

    return words.select("word", "n").mapInArrow(emit, "word string, n bigint, back boolean, pos int, node bigint")


def trie_rows(words: DataFrame) -> DataFrame:
    """One row for each word and prefix that a neighbour's frontier can reach: the edge behind it, what is below (bits of
    the next two characters and of the length left), and the levels at which a frontier can stand there."""
    names = ["id", "node", "code", "child", "next1", "next2", "left", "from", "to"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ids = _latin(batch), batch.column("id").to_numpy()
            if not own:
                continue
            for back in (False, True):
                trie = _Prefixes(own, back)
                low, high = _start(trie.size - 1, back), _start(trie.size + 1, back)  # starts of the words one shorter and one longer
                rows = trie.size - low + 1
                word = np.repeat(np.arange(len(own)), rows)
                depth = np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows) + low[word]
                bits = [_ONE << (x.astype(np.uint64) & np.uint64(63)) for x in (trie.code(word, depth + 1), trie.code(word, depth + 2), np.maximum(trie.size[word] - depth - 1, 0))]
                columns = [ids[word], trie.node(word, depth), trie.code(word, depth).astype(np.int32), trie.node(word, np.minimum(depth + 1, trie.size[word])), *(b.view(np.int64) for b in bits),
                           np.maximum(depth - high[word], 0).astype(np.int32), (depth - low[word]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return words.select("id", "word").mapInArrow(emit, "id bigint, node bigint, code int, child bigint, next1 bigint, next2 bigint, left bigint, `from` int, to int")


def trie_nodes(words: DataFrame) -> DataFrame:
    """``node, from, to, edges``: the edges of each node; an edge has its character, child, number of words below, bits and,
    as a container, the least and the greatest id. Edges below a container stay only where a frontier may start."""
    edges = trie_rows(words).groupBy("node", "code", "child").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("next1").alias("next1"), F.bit_or("next2").alias("next2"), F.bit_or("left").alias("left"),
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("from").alias("from"), F.max("to").alias("to"))
    edge = F.struct(F.when(F.col("code") == 0, F.lit("")).otherwise(F.expr("char(code)")).alias("c"), "child", F.col("n").alias("below"), "next1", "next2", "left", "lo", "hi")
    nodes = edges.groupBy("node").agg(F.sum("n").alias("words"), F.min("from").alias("from"), F.max("to").alias("to"), F.collect_list(edge).alias("edges"))  # one for each letter at most
    return nodes.where((F.col("words") > CONTAINER) | (F.col("from") == 0)).drop("words")


def long_keys(words: DataFrame) -> DataFrame:
    """``key, kind, id`` of words too long for a walk: the hash of the word (0), of the word without each of its characters
    (1) and of the word with each of its characters left open (2)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back_one = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for batch in batches:
            for word, i in zip(_latin(batch), batch.column("id").to_pylist(), strict=True):
                trie = _Prefixes([word], False)
                sums, codes, m = trie.sums, _CODES[trie.codes], len(word)
                powers = np.r_[_ONE, np.cumprod(np.full(m, _BASE, np.uint64), dtype=np.uint64)][1:]
                whole, short = mixed_bits(sums[m:] + np.uint64(m)), mixed_bits(sums[:-1] + (sums[m] - sums[1:]) * back_one + np.uint64(m - 1))
                open_ = mixed_bits(sums[m] - codes * powers + np.arange(m, dtype=np.uint64) * _SEEDS[0] + np.uint64(m))
                keys = np.r_[whole, short, open_].view(np.int64)
                kinds = np.repeat(np.array([0, 1, 2], np.int32), [1, m, m])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds), pa.array(np.full(len(keys), i, np.int64))], ["key", "kind", "id"])

    return words.select("id", "word").mapInArrow(emit, "key bigint, kind int, id bigint")


def long_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: near pairs of words of LONGEST_WALK characters or more, whose common prefixes would take a level for
    each character. Words that agree with one character left open differ in that character alone, so a group is as small as the alphabet."""
    keys = written(long_keys(words).distinct(), "long_keys")
    of = lambda kind, name: keys.where(F.col("kind") == kind).select("key", F.col("id").alias(name))
    found = of(0, "i").join(of(1, "j"), "key").select("i", "j").unionByName(of(2, "i").join(of(2, "j"), "key").where("i <> j").select("i", "j")).distinct()
    side = lambda name, end: words.select(F.col("id").alias(name), F.col("word").alias(end), F.col("n").alias(f"n_{end}"))
    pairs = found.join(side("i", "a"), "i").join(side("j", "b"), "j")
    return pairs.where(_ordered() & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def _ordered() -> Column:
    size = F.length("a")
    return (size < F.length("b")) | ((size == F.length("b")) & (F.col("a") < F.col("b")))


def _asks(mask: Column, value: Column) -> Column:
    return F.getbit(mask, F.pmod(value, F.lit(64)).cast("int")) == 1


def next_level(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States one level down and candidates (rows with ``other``), from states ``word, n, back, start, pos, edits, node``."""
    size = F.length("word")
    at = states.join(nodes.select("node", "edges"), "node").select("word", "n", "back", "start", "pos", "edits", F.inline("edges"))
    own = F.substring(F.col("word"), F.col("pos") + 1, F.lit(1))
    at = at.withColumn("follows", own == F.col("c")).where((F.col("edits") == 0) | F.col("follows"))

    def fits(pos: Column) -> Column:
        """Whether the rest of the word from ``pos`` may stand below the edge."""
        char = lambda k: F.coalesce(F.ascii(F.substring(F.col("word"), pos + k, F.lit(1))), F.lit(0))
        return _asks(F.col("next1"), char(1)) & _asks(F.col("next2"), char(2)) & _asks(F.col("left"), F.greatest(size - pos, F.lit(0)))

    exact, ends = F.col("edits") == 0, F.col("c") == ""
    other = ~ends & ~F.col("follows") & exact
    step = lambda pos, edits: F.struct(pos.cast("int").alias("to"), F.lit(edits).alias("made"))
    after = F.col("pos") + 1
    moves = F.filter(F.array(
        F.when(exact & F.col("follows") & ~ends & (F.col("below") > 1), step(after, 0)),  # alone below is the word itself
        F.when(~exact & (ends | fits(after)), step(after, 1)),
        F.when(other & (own != "") & (F.col("c") > own) & fits(after), step(after, 1)),
        F.when(other & fits(F.col("pos")), step(F.col("pos"), 1))), lambda x: x.isNotNull())
    few = F.col("below") <= CONTAINER
    words_below = F.when(few, F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))).otherwise(F.array(F.lit(None).cast("long")))
    moved = at.withColumn("words_below", words_below).select("word", "n", "back", "start", "child", "words_below", F.inline(moves))
    return moved.select("word", "n", "back", "start", F.col("to").alias("pos"), F.col("made").alias("edits"), F.col("child").alias("node"), F.explode("words_below").alias("other"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of ``words`` (id, word, n) that one inserted, deleted or replaced character
    parts, once. The walk makes those whose shorter word has less than LONGEST_WALK characters, ``long_pairs`` the rest."""
    walked, beyond = words.where(F.length("word") <= LONGEST_WALK), words.where(F.length("word") >= LONGEST_WALK)
    nodes = written(trie_nodes(walked), "trie_nodes")
    states = start_states(walked.where(F.length("word") < LONGEST_WALK)).select("word", "n", "back", F.col("pos").alias("start"), "pos", F.lit(0).alias("edits"), "node")
    level, candidates = 0, None
    while True:
        here = nodes.where((F.col("from") <= level) & (F.col("to") >= level))
        frontier = written(next_level(states, here), f"level{level}")
        found = frontier.where("other IS NOT NULL").select("word", "n", "back", "start", "other")
        candidates = found if candidates is None else candidates.unionByName(found)
        states = frontier.where("other IS NULL").drop("other")
        level += 1
        if states.isEmpty():
            break
    dropped(nodes)
    other = walked.select(F.col("id").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    a = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    pairs = candidates.join(other, "other").select(a.alias("a"), F.col("n").alias("n_a"), "b", "n_b", "back")
    half = F.floor(F.length("a") / 2).cast("int")
    first_half = F.substring(F.col("a"), F.lit(1), half) == F.substring(F.col("b"), F.lit(1), half)  # found by the first frontier
    short = pairs.where(_ordered() & (F.levenshtein("a", "b", 1) == 1) & ~(F.col("back") & first_half)).select("a", "n_a", "b", "n_b").distinct()
    return short if beyond.isEmpty() else short.unionByName(long_pairs(beyond))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (form not null): forms followed to the last, by pointer jumping. Counts at least
    double with each form, so the rounds are few."""
    to = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        dropped(to)
        to = new.select("word", "root")
        if new.where("moved").isEmpty():
            return to


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row for each word of ``docs`` (doc_id, text).

    Null and empty texts hold no words; a null doc_id reads as "null". Rows that repeat count again. Of near
    words with equal n the smallest in code-point order is the form. Other columns are ignored; an empty
    table gives no rows. A frontier has as many levels as the longest prefix that three words share beyond
    their halves.
    """
    words = written(word_counts(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = written(near_pairs(words), "near_words")
    flipped = pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    best = pairs.unionByName(flipped).groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("o"), F.col("b").alias("form"))).alias("best"))
    frequent = -F.col("best.o") >= FORM_FACTOR * F.col("n")
    told = written(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.o")).alias("form_n")), "variants")
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
