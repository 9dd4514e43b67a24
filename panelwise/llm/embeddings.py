"""Near-duplicate vectors by cross-polytope hashing.

A rotation is three rounds of random signs and a fast Hadamard transform; the hash is the signed
coordinate that is largest afterwards. HASHES rotations make a table's bucket, and each vector also
goes to the buckets of its second-best coordinate in one rotation at a time (multiprobe). Vectors
that share a bucket are compared by cosine in double precision. A dense group has links in the square
of its size, so links stay in the task: what leaves it is each vector's count and a forest of links.

Equal vectors of a label are one class, compared once and counted with its size. Vectors within half the
linking angle of one direction are a ball: any two of them link, so they are counted by the ball's size and
never compared with each other. A bucket with many vectors is cut into blocks, and each pair of blocks that
has something to compare is a group of its own, so no task holds more than two blocks and no pair of a
bucket is left out. A large table's buckets are dealt in several rounds, so that what is shuffled at a time
stays in proportion to the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from panelwise.llm.common import dropped, written
from panelwise.llm.components import connected_components
from panelwise.llm.suffix import _release

LEAST_COSINE = 0.93
TABLES, HASHES = 6, 2
#: Vectors of a block of a bucket; a group holds two blocks at most.
BLOCK = 2048
#: Best buckets of the first table with so many vectors or more are asked for the middle of a ball.
BALL_FROM = 512
#: Numbers of all middles together, which every task has; vectors near no middle are compared like any other.
MIDDLES = 65_536
#: Buckets of more than one block that are joined by broadcast; a shuffled join beyond.
BROADCAST_BUCKETS = 100_000
#: Bytes that are shuffled at a time, and rounds at most (each then has about the vectors once).
ROUND_BYTES, ROUNDS = 1 << 30, TABLES * (1 + HASHES)
#: Groups up to this many vectors are compared many at a time.
SMALL = 48
#: Products of one call to BLAS, so few that it starts no threads: a task has one core, and a worker is a fork.
PRODUCTS = 1 << 18
#: Two vectors within this angle of a third link whatever lies between them.
_HALF = np.arccos(LEAST_COSINE) / 2 - 1e-6


def _signs(size: int, table: int, k: int) -> np.ndarray:
    return np.random.default_rng([size, table, k]).choice([-1.0, 1.0], (3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column; the length is a power of two."""
    size, n, h = x.shape[0], x.shape[1], 1
    while h < size:
        x = x.reshape(size // (2 * h), 2, h, n)
        y = np.empty_like(x)
        np.add(x[:, 0], x[:, 1], out=y[:, 0])
        np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
        x, h = y, 2 * h
    return x.reshape(size, n)


def buckets(x: np.ndarray) -> np.ndarray:
    """For each row its TABLES * (1 + HASHES) bucket numbers: the best, then one probe per rotation."""
    size = 1 << max(x.shape[1] - 1, 1).bit_length()
    out = np.empty((len(x), TABLES * (1 + HASHES)), np.int64)
    signs = [[_signs(size, table, k) for k in range(HASHES)] for table in range(TABLES)]
    step = max(1, 32_768 // size)  # as much as a core keeps near
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        padded = np.zeros((size, len(part)))
        padded[: x.shape[1]] = part.T
        column, every = 0, np.arange(len(part))
        for table in range(TABLES):
            best, second = [], []
            for k in range(HASHES):
                y = padded
                for sign in signs[table][k]:  # not brought back to length, which moves no largest coordinate
                    y = hadamard(y * sign[:, None])
                y = np.ascontiguousarray(y.T)
                far = np.abs(y)
                for found in (best, second):
                    at = far.argmax(axis=1)
                    found.append(at * 2 + (y[every, at] < 0))
                    far[every, at] = -1
            for probe in range(-1, HASHES):
                code = np.full(len(part), table, dtype=np.int64)
                for k in range(HASHES):
                    code = code * (2 * size) + (second[k] if k == probe else best[k])
                out[lo : lo + step, column] = code
                column += 1
    return out


def _code_kind(dim: int) -> type:
    return np.int32 if TABLES * (4 << max(int(dim) - 1, 1).bit_length() * 2) < 1 << 31 and HASHES == 2 else np.int64


def numbers(column: pa.Array, kind: type, at: np.ndarray | None = None) -> np.ndarray:
    """The values of a binary column (those at ``at``), all of one length, as rows of numbers."""
    if at is not None and len(at) < len(column):
        column = column.take(pa.array(at))
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0]).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by their largest number, so that squares stay finite."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        return x / np.abs(x).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prepared(vectors: DataFrame, kind: type) -> DataFrame:
    """``vec_id, label, key, dim, vec``: key is a digest of the vector (null if it links with nothing), vec its numbers as ``kind``."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            values = pc.cast(lists.values, pa.float64()).to_numpy(zero_copy_only=False)  # null: not a number
            starts, lengths = lists.offsets.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            lengths = np.where(batch.column(2).is_valid().to_numpy(zero_copy_only=False), lengths, 0)
            keys, dims, vecs = [None] * n, [None] * n, [None] * n
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x = values[starts[at][:, None] + np.arange(dim)] + 0.0
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                x = x[good]
                for i, row, kept in zip(at[good].tolist(), x, x.astype(kind), strict=True):
                    keys[i], dims[i], vecs[i] = xxhash.xxh3_128_digest(row), dim, kept.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                                             ["vec_id", "label", "key", "dim", "vec"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(prepare, "vec_id bigint, label bigint, key binary, dim int, vec binary")


def hashed(classes: DataFrame, kind: type) -> DataFrame:
    """Adds ``buckets`` (array<bigint>) to ``label, key, rep, n, dim, vec``, and the same numbers as ``codes`` in a row of bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes = batch.column("dim").to_numpy(), [b""] * batch.num_rows
            made = np.empty((batch.num_rows, TABLES * (1 + HASHES)), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                made[at] = buckets(scaled(numbers(batch.column("vec"), kind, at)))
                for i, row in zip(at.tolist(), made[at].astype(_code_kind(dim)), strict=True):
                    codes[i] = row.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), lists], [*batch.schema.names, "codes", "buckets"])

    return classes.mapInArrow(add, "label bigint, key binary, rep bigint, n bigint, dim int, vec binary, codes binary, buckets array<bigint>")


def middles(classes: DataFrame, kind: type) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each label and length, numbers and directions of balls that may hold many vectors: means of the large best buckets
    of the first table, without those near a larger one. A sample that is bounded by MIDDLES; sums are of whole numbers, so reruns agree."""
    at = ["label", "dim", "home"]
    homes = classes.select("label", "dim", F.col("buckets")[0].alias("home"), "vec")
    large = homes.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= BALL_FROM).orderBy(F.desc("size"), *at).limit(1000).collect()
    room = np.cumsum([r["dim"] for r in large]) <= MIDDLES
    large = [r for r, fits in zip(large, room, strict=True) if fits]
    if not large:
        return {}
    named = classes.sparkSession.createDataFrame([(r["label"], r["dim"], r["home"], k) for k, r in enumerate(large)], "label bigint, dim int, home bigint, k int")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            ks = batch.column(0).to_numpy()
            for k in np.unique(ks).tolist():
                x = np.rint(unit(numbers(batch.column(1), kind, np.flatnonzero(ks == k))) * (1 << 20)).astype(np.int64).sum(0)
                total[k] = total.get(k, 0) + x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["k", "place", "x"])

    found = {k: np.zeros(r["dim"]) for k, r in enumerate(large)}
    for k, place, x in homes.join(F.broadcast(named), at).select("k", "vec").mapInArrow(sums, "k int, place int, x bigint").groupBy("k", "place").agg(F.sum("x")).collect():
        found[k][place] = x
    out: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
    for k, r in enumerate(large):
        ids, taken = out.setdefault((r["label"], r["dim"]), ([], []))
        if found[k].any():
            x = found[k] / np.linalg.norm(found[k])
            if all(x @ y < np.cos(_HALF / 2) for y in taken):
                ids.append(k)
                taken.append(x)
    return {key: (np.array(ids, np.int32), np.stack(taken)) for key, (ids, taken) in out.items() if ids}


def in_balls(classes: DataFrame, found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], kind: type) -> DataFrame:
    """Adds ``ball``, the number of the nearest middle if that is within half the linking angle, else -1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            ball = np.full(batch.num_rows, -1, np.int32)
            for (label, dim), (ids, directions) in found.items():
                at = np.flatnonzero((labels == label) & (dims == dim))
                for part in np.array_split(at, (len(at) * len(ids) >> 20) + 1) if len(at) else []:
                    c = np.einsum("ij,kj->ik", unit(numbers(batch.column("vec"), kind, part)), directions)  # without BLAS
                    near = c.argmax(axis=1)
                    ball[part] = np.where(c[np.arange(len(part)), near] >= np.cos(_HALF), ids[near], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball)], [*batch.schema.names, "ball"])

    return classes.mapInArrow(add, "label bigint, key binary, rep bigint, n bigint, dim int, vec binary, codes binary, buckets array<bigint>, ball int")


def _places(member: DataFrame, rows: DataFrame) -> DataFrame:
    """``member`` with ``part`` and ``side``: the groups of its bucket that each vector goes to.

    A bucket of one block is one group, in which all meet all (side 2). In a larger one the vectors of its
    largest ball need not meet each other: they are dealt to blocks, each of which meets each block of the
    rest (sides 0 and 1), and the rest's blocks meet each other and themselves.
    """
    at = ["label", "dim", "bucket"]
    light = rows.select(F.explode("buckets").alias("bucket"), "label", "dim", "ball")
    large = written(light.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select(*at), "large_buckets")
    count = large.count()
    if not count:
        return member.withColumns({"part": F.lit(0).cast("long"), "side": F.lit(2)})
    small = F.broadcast if count <= BROADCAST_BUCKETS else (lambda t: t)
    balls = light.join(small(large), at).groupBy(*at, "ball").agg(F.count(F.lit(1)).alias("size"))
    main = F.max(F.when(F.col("ball") >= 0, F.struct("size", "ball")))
    split = balls.groupBy(*at).agg(F.sum("size").alias("all"), main.alias("main")).select(
        *at, F.col("main.ball").alias("main"), F.ceil(F.coalesce("main.size", F.lit(0)) / BLOCK).cast("int").alias("b"),
        F.ceil((F.col("all") - F.coalesce("main.size", F.lit(0))) / BLOCK).cast("int").alias("r"))
    split = written(split, "split_buckets")
    b, r = F.col("b"), F.col("r")
    inner = F.coalesce(F.col("ball") == F.col("main"), F.lit(False))
    own = F.pmod(F.xxhash64("rep", "bucket"), F.when(inner, b).otherwise(r)).cast("long")

    def place(first: Column, second: Column, mixed: bool, side: Column) -> Column:
        number = F.shiftleft(first.cast("long"), 30) + second.cast("long") + F.lit(int(mixed) << 60)
        return F.struct(number.alias("part"), side.cast("int").alias("side"))

    def each(n: Column, f) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<part:bigint,side:int>>"))

    among = each(r, lambda j: place(F.least(F.col("own"), j), F.greatest(F.col("own"), j), False, F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1)))
    with_main = each(b, lambda i: place(i, F.col("own"), True, F.lit(1)))
    from_main = each(r, lambda j: place(F.col("own"), j, True, F.lit(0)))
    alone = F.array(place(F.lit(0), F.lit(0), False, F.lit(2)))
    to = F.when(b.isNull(), alone).when(F.col("inner"), from_main).otherwise(F.concat(with_main, among))
    joined = member.join(small(split), at, "left").withColumns({"own": own, "inner": inner})
    return joined.withColumn("to", F.explode(to)).select(*member.columns, "to.part", "to.side")


def bucket_links(rows: DataFrame, kind: type) -> DataFrame:
    """``a, b, n``: of the links between class representatives that share a bucket and no ball, what a component and a
    count need. Rows with b are links that join what a group of vectors has of one component (fewer than it has
    vectors); rows without b say that a has n more linked vectors, copies counted.

    A pair that shares several buckets counts in the first of them only, so counts can be summed.
    """
    member = rows.select(F.explode("buckets").alias("bucket"), "label", "dim", "rep", "n", "ball", "vec", "codes")
    placed = _places(member, rows)
    size = rows.agg(F.sum(F.col("dim") * np.dtype(kind).itemsize + 120)).first()[0] or 0
    rounds = max(1, min(ROUNDS, -(-size * TABLES * (1 + HASHES) // ROUND_BYTES)))
    group = ["bucket", "label", "dim", "part"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            last = _starts(batch)[-1]
            yield _links(batch.slice(0, last), kind)
            rest = batch.slice(last)
        if rest is not None:
            yield _links(rest, kind)

    parts = []
    for k in range(rounds):
        here = placed if rounds == 1 else placed.where(F.pmod(F.xxhash64("bucket"), F.lit(rounds)) == k)
        dealt = here.select(*group, "side", "rep", "n", "ball", "vec", "codes").repartition(*group).sortWithinPartitions(*group)
        parts.append(written(dealt.mapInArrow(compare, "a bigint, b bigint, n bigint"), "vector_links"))
        if rounds > 1:
            _release(rows.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows of bucket numbers, as ``buckets`` orders them, the first of x that y has too."""
    width = 1 + HASHES
    out = np.full(len(x), -1, np.int64)
    for table in range(TABLES - 1, -1, -1):  # buckets of different tables differ
        own, other = x[:, table * width : (table + 1) * width], y[:, table * width : (table + 1) * width]
        shared = (own[:, :, None] == other[:, None, :]).any(axis=2)
        hit = shared.any(axis=1)
        out[hit] = own[hit, shared[hit].argmax(axis=1)]
    return out


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where the groups of a batch begin."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in ("bucket", "label", "dim", "part"):
        x = batch.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _meetings(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y whose product is ``least`` (above 0) or more."""
    size = max(1, int((PRODUCTS // x.shape[1]) ** 0.5))

    def tiles(z: np.ndarray) -> np.ndarray:
        padded = np.zeros((-(-len(z) // size) * size, z.shape[1]), z.dtype)
        padded[: len(z)] = z
        return padded.reshape(-1, size, z.shape[1])

    a, b, i, j = np.nonzero(np.matmul(tiles(x)[:, None], tiles(y).transpose(0, 2, 1)[None]) >= least)
    return a * size + i, b * size + j


def _candidates(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a group and whose product is ``least`` or more, some at a time."""
    few = (sizes <= min(SMALL, int((PRODUCTS // x.shape[1]) ** 0.5))) & (side[starts] == 2)
    for size in np.unique(sizes[few & (sizes > 1)]).tolist():
        at = starts[few & (sizes == size)]
        step = max(1, (1 << 20) // (size * max(size, x.shape[1])))
        for lo in range(0, len(at), step):
            rows = at[lo : lo + step, None] + np.arange(size)
            some = x[rows]
            k, i, j = np.nonzero(np.matmul(some, some.copy().transpose(0, 2, 1)) >= least)
            keep = i < j
            yield rows[k[keep], i[keep]], rows[k[keep], j[keep]]
    for s, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
        whole = side[s] == 2
        here = np.arange(s, s + size)
        p, q = (here, here) if whole else (here[side[s : s + size] == 0], here[side[s : s + size] == 1])
        step = max(1, (1 << 21) // max(1, len(q)))
        for lo in range(0, len(p), step):
            i, j = _meetings(x[p[lo : lo + step]], x[q], least)
            i, j = p[lo : lo + step][i], q[j]
            keep = i < j if whole else slice(None)
            yield i[keep], j[keep]


def _links(batch: pa.RecordBatch, kind: type) -> pa.RecordBatch:
    """The rows of ``bucket_links`` from whole groups."""
    a, b, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    every = _starts(batch)
    lengths = np.diff(np.r_[every, batch.num_rows])
    of_group = np.repeat(lengths, lengths)
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims[of_group > 1]).tolist():
        at = np.flatnonzero((of_group > 1) & (dims == dim))
        part = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
        starts = _starts(part)
        sizes = np.diff(np.r_[starts, part.num_rows])
        bucket, rep, copies, ball, side = (part.column(c).to_numpy() for c in ("bucket", "rep", "n", "ball", "side"))
        codes, x = numbers(part.column("codes"), _code_kind(dim)), scaled(numbers(part.column("vec"), kind))
        square = (x * x).sum(1)
        # Products in single precision are off by less than this; what they leave is asked in double precision.
        least = np.float32(LEAST_COSINE - 1e-5 - dim * 2.5e-7)
        linked, parent = np.zeros(part.num_rows, np.int64), np.arange(part.num_rows)
        for p, q in _candidates((x / np.sqrt(square)[:, None]).astype(np.float32), starts, sizes, side, least):
            apart = (ball[p] < 0) | (ball[p] != ball[q])
            p, q = p[apart], q[apart]
            for k in range(0, len(p), 50_000):
                i, j = p[k : k + 50_000], q[k : k + 50_000]
                links = np.einsum("ij,ij->i", x[i], x[j]) / np.sqrt(square[i] * square[j]) >= LEAST_COSINE
                i, j = i[links], j[links]
                # Which of the two is asked for its first shared bucket must not depend on the group.
                swap = rep[i] > rep[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                mine = first_shared(codes[i], codes[j]) == bucket[i]
                i, j = i[mine], j[mine]
                np.add.at(linked, i, copies[j])
                np.add.at(linked, j, copies[i])
                _join(parent, i, j)
        some, joined = np.flatnonzero(linked), np.flatnonzero(parent != np.arange(len(parent)))
        a += [rep[some], rep[joined]]
        b += [np.full(len(some), -1), rep[parent[joined]]]
        n += [linked[some], np.full(len(joined), -1)]
    a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
    count = n >= 0
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=count), pa.array(n, mask=~count)], ["a", "b", "n"])


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts that the links between rows a and b connect; a part is named by its first row."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((up := parent[parent]) != parent).any():
            parent[:] = up


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): ``vec_id, n_links, component_id, kept``.

    Only vectors of one label and one length are compared. Vectors that are null, empty, zero or
    hold null or non-finite components, and those with a null label or vec_id, link with nothing:
    n_links 0 and their own component. Copies count as links. Links between different vectors are
    those that share a ball, or a bucket in some table (recall is measured in the tests); every one reported
    has the cosine. An empty table gives no rows; other columns are ignored.
    """
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    made = prepared(vectors, kind)
    rows = written(made.select("vec_id", "label", "key"), "vectors")
    able = made.where(F.col("key").isNotNull() & F.col("vec_id").isNotNull())
    classes = able.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = written(hashed(classes, kind), "vector_classes")
    found = middles(classes, kind)
    if found:
        without, classes = classes, written(in_balls(classes, found, kind), "vector_classes")
        dropped(without)
    else:
        classes = classes.withColumn("ball", F.lit(-1))
    links = bucket_links(classes, kind)
    edges, counts = links.where("b IS NOT NULL").select("a", "b"), links.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    known, others = classes.select("label", "key", "rep", "n"), F.coalesce("others", F.lit(0))
    if found:
        inside = classes.where("ball >= 0").select("label", "key", "rep", "n", "ball")
        sums = inside.groupBy("ball").agg(F.sum("n").alias("within"), F.min("rep").alias("head"))
        inside = written(inside.join(sums, "ball").select("label", "key", "rep", "head", (F.col("within") - F.col("n")).alias("within")), "balls")
        edges = edges.unionByName(inside.select(F.col("rep").alias("a"), F.col("head").alias("b")))
        known, others = known.join(inside.select("label", "key", "within"), ["label", "key"], "left"), others + F.coalesce("within", F.lit(0))
    label = connected_components(edges)
    known = (known.join(counts, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
             .select("label", "key", (F.col("n") - 1 + others).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    known = written(known, "known")
    dropped(links)
    out = rows.select("vec_id", "label", "key").join(known, ["label", "key"], "left")
    own = F.col("vec_id").isNotNull()
    component = F.when(own, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
