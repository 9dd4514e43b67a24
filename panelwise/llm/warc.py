"""WARC archives with a two-level capture index.

Writing: every task packs its pages into archives of gzip members, one record each, and returns
one index row for each record. Archives get a name of their own for each attempt of a task; only
the index rows of attempts that Spark commits name an archive, so a retried or lost task leaves at
worst a file that nothing refers to.

Index: rows are range-partitioned and sorted by reversed-host URL key. Each partition becomes a
shard: a file of gzip blocks of BLOCK_LINES lines, followed by a sparse directory with the first
key, offset and length of each block. A table with one row for each shard is the upper level.

Reading: keys to look up are sorted the same way; a task searches the shard table, then the
shard's directory, by bisection, reads the one block by range, and then each record by range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import new_path, written

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 100
BLOCK_LINES = 256
#: Records of one shard, about; the shard table has one row for so many.
SHARD_LINES = 1 << 16
MAX_SHARDS = 4096
#: A new archive begins beyond this size.
ARCHIVE_BYTES = 1 << 30
CAPTURED = "2024-01-01T00:00:00Z"

INDEX_SCHEMA = "surt string, page_id bigint, archive string, offset bigint, length bigint"
RECORD_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _store(path: str):
    """A file system and the path in it: local and mounted folders directly, others by Arrow."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _create(path: str):
    store, path = _store(path)
    if store is None:
        os.makedirs(posixpath.dirname(path), exist_ok=True)
        return open(path, "wb")
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def read_range(path: str, offset: int, length: int) -> bytes:
    store, path = _store(path)
    with open(path, "rb") if store is None else store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def reversed_host_key(url: str | None) -> str:
    """``http://www.a.org:80/x?y`` -> ``org,a,www)/x?y``; null gives the empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else "http://" + url)
        host, path, query = parts.hostname or "", parts.path or "/", parts.query
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + path + ("?" + query if query else "")


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None, refers_url: str | None) -> bytes:
    def clean(x: str) -> str:
        return x.replace("\r", "%0D").replace("\n", "%0A")

    name = f"page:{page_id}:{url}:{digest}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    block = http + (b"Content-Length: %d\r\n\r\n" % size) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
            f"WARC-Date: {CAPTURED}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(refers_url)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record; the payload of a response is measured and hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size, digest = int(fields["X-Payload-Length"]), said
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != said:
            raise ValueError("a payload does not match its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


def classified(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, record_type, refers_to, refers_url``.

    Of equal payloads of MIN_REVISIT_BYTES or more, the one with the smallest page_id is the
    response. Only digests that occur twice reach the join; their minimum is taken map-side.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = (base.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 AND first IS NOT NULL").select("payload_digest", "first"))
    joined = base.join(written(first, "originals"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``classified`` rows as WARC records below ``folder``; index rows (INDEX_SCHEMA)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = _create(path)
                page_id = None if pd.isna(r.page_id) else int(r.page_id)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                raw = gzip.compress(_record(page_id, r.url, r.html.encode(), r.payload_bytes, r.payload_digest, r.record_type, refers, r.refers_url), 6, mtime=0)
                out.write(raw)
                rows.append((reversed_host_key(r.url), page_id, path, at, len(raw)))
                at += len(raw)
            yield pd.DataFrame(rows, columns=["surt", "page_id", "archive", "offset", "length"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return pages.mapInPandas(pack, INDEX_SCHEMA)


def write_index(rows: DataFrame, folder: str, n_rows: int) -> DataFrame:
    """Sort index rows into shards of compressed blocks; the shard table ``first_key, shard, directory_at, size, lines``."""
    shards = max(1, min(MAX_SHARDS, -(-n_rows // SHARD_LINES)))
    ordered = rows.repartitionByRange(shards, "surt", F.col("page_id").asc_nulls_first()).sortWithinPartitions("surt", F.col("page_id").asc_nulls_first(), "archive", "offset")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at, out, directory, lines, first, total = f"{folder}/shard-{uuid.uuid4().hex}.cdx.gz", 0, None, [], [], None, 0

        def block() -> None:
            nonlocal at, out, lines, first
            if out is None:
                out, first = _create(path), lines[0][0]
            raw = gzip.compress("\n".join(json.dumps(x) for x in lines).encode(), 6, mtime=0)
            out.write(raw)
            directory.append((lines[0][0], at, len(raw)))
            at += len(raw)
            lines = []

        for batch in batches:
            for r in batch.itertuples(index=False):
                key = _line_key(r.surt, None if pd.isna(r.page_id) else int(r.page_id))
                lines.append((key, r.archive, int(r.offset), int(r.length)))
                total += 1
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out is not None:
            raw = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(raw)
            out.close()
            yield pd.DataFrame([(json.dumps(first), path, at, len(raw), total)], columns=["first_key", "shard", "directory_at", "size", "lines"])

    return ordered.mapInPandas(shard, "first_key string, shard string, directory_at bigint, size bigint, lines bigint")


def _line_key(surt: str, page_id: int | None) -> list:
    """Compares as Spark sorts: by UTF-8 bytes, then null before any number."""
    return [surt.encode().hex(), -(1 << 63) if page_id is None else page_id]


class Index:
    """The index as one task sees it: bisection in the shard table, a shard's directory, a block."""

    def __init__(self, shards: list[tuple[list, str, int, int]]):
        self.shards = sorted(shards)
        self.firsts = [s[0] for s in self.shards]
        self.at: tuple[int, list] = (-1, [])
        self.block: tuple[tuple, list] = ((), [])

    def _blocks(self, i: int) -> list:
        if self.at[0] != i:
            _, path, offset, size = self.shards[i]
            self.at = (i, json.loads(gzip.decompress(read_range(path, offset, size))))
        return self.at[1]

    def find(self, key: list) -> list[tuple[str, int, int]]:
        """Archive, offset and length of every record with the key (equal keys may cross blocks)."""
        found: list[tuple[str, int, int]] = []
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.shards) and (self.firsts[i] <= key):
            directory = self._blocks(i)
            j = max(0, bisect.bisect_left([d[0] for d in directory], key) - 1)
            while j < len(directory) and directory[j][0] <= key:
                _, offset, length = directory[j]
                if self.block[0] != (i, j):
                    raw = gzip.decompress(read_range(self.shards[i][1], offset, length))
                    self.block = ((i, j), [json.loads(x) for x in raw.decode().split("\n")])
                lines = self.block[1]
                k = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while k < len(lines) and lines[k][0] == key:
                    found.append(tuple(lines[k][1:]))
                    k += 1
                j += 1
            i += 1
        return found


def read_captures(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Look up rows ``page_id, url`` in the index and read their records (RECORD_SCHEMA).

    Keys are range-partitioned and sorted as the index is, so a task walks a few neighbouring
    shards. A key that is asked for twice is answered once. The shard table (at most MAX_SHARDS
    rows) goes to every task; directories and blocks are read by range where needed.
    """
    top = [(json.loads(r["first_key"]), r["shard"], r["directory_at"], r["size"]) for r in shards.select("first_key", "shard", "directory_at", "size").collect()]
    wanted = keys.select(_surt(F.col("url")).alias("surt"), "page_id")
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = wanted.repartitionByRange(parts, "surt", F.col("page_id").asc_nulls_first()).sortWithinPartitions("surt", F.col("page_id").asc_nulls_first())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, last, files = Index(top), None, {}
        for batch in batches:
            rows = []
            for surt, page_id in zip(batch["surt"], batch["page_id"], strict=True):
                key = _line_key(surt, None if pd.isna(page_id) else int(page_id))
                if key == last:
                    continue
                last = key
                for archive, offset, length in index.find(key):
                    rows.append(parse_record(gzip.decompress(_range_of(files, archive, offset, length))))
                    if len(rows) == 256:
                        yield _records(rows)
                        rows = []
            yield _records(rows)
        for f in files.values():
            f.close()

    return wanted.mapInPandas(read, RECORD_SCHEMA)


def _range_of(files: dict[str, io.IOBase], path: str, offset: int, length: int) -> bytes:
    """A range read that keeps up to 64 archives open."""
    if path not in files:
        if len(files) >= 64:
            files.pop(next(iter(files))).close()
        store, inner = _store(path)
        files[path] = open(inner, "rb") if store is None else store.open_input_file(inner)
    files[path].seek(offset)
    return files[path].read(length)


def _records(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def _surt(url: Column) -> Column:
    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return urls.map(reversed_host_key)

    return key(F.coalesce(url, F.lit("")))


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write WARC archives and their index for ``page_id, url, html``; (index rows, shard table).

    Null html is the empty payload; null urls get the empty key; null page_ids are never the
    original of a revisit unless no other page has the payload, and then all such pages are
    responses. Pages that repeat the smallest page_id and payload are all responses. Line breaks in
    urls are written as %0D and %0A in headers. An empty table gives empty tables.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = written(write_archives(classified(pages), folder), "captures")
    shards = written(write_index(rows, folder, rows.count()), "shards")
    return rows, shards


def read_back(pages: DataFrame, shards: DataFrame) -> DataFrame:
    """The records of all ``pages`` through the index, one row for each record."""
    return read_captures(pages.select("page_id", "url"), shards)
