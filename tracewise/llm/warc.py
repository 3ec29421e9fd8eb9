"""WARC archives with a two-level capture index.

write() groups payloads by SHA-1, makes the smallest page_id of equal payloads the response and the
others revisits of it, and each task writes its records, gzip members of their own, to archives in
the shared folder. The captures are sorted by reversed-host URL key (range partitions, so a host
of any size spreads) into index shards of compressed blocks of BLOCK_LINES lines; beside each is
its sparse directory, one line per block. lookup() takes captures in key order and finds each by
binary search: in the list of shards (one row per index partition), in the shard's directory,
in the block, and then reads the record's byte range from its archive.

Files are read and written through pyarrow's filesystems, so the folder may be any store that they
open. A task names its files by its attempt, and only rows of tasks that succeeded name archives,
so lost executors leave no half record in an index.

Equal payloads are found by their digests alone; a digest that a large share of all pages have, such as
that of empty pages, is broadcast (shared.spread_join), so no task gets all of its pages. Exchanges have
as many partitions as records and bytes ask for.

Defined results: a null payload is empty; payloads under min_dedup bytes are all responses; a null
or malformed URL is keyed as it stands; rows with equal page_ids give a record each, ties (equal in all) too;
a null page_id is the smallest and refers to nothing; a very long payload is one record, held about four times
over in its task; an empty table gives no archives and empty results; other columns of pages are left
out, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm.shared import held, new_path, small_batches, spread_join, written

#: Captures in a compressed block, and bytes after which a task begins another archive.
BLOCK_LINES, ARCHIVE_BYTES = 300, 1 << 30
#: Captures of an index shard, bytes of records that a task reads, and archives that a task keeps open.
SHARD_LINES, TASK_BYTES, OPEN_FILES = 1 << 20, 64 << 20, 16
_CAPTURE = "url_key string, page_id long, archive string, offset long, length long"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, url_key string, archive string"


class Archive(NamedTuple):
    """captures: a row per record; shards: a row per index shard, in key order; store: the folder; mean: bytes of a record."""

    captures: DataFrame
    shards: DataFrame
    store: str
    mean: float


def _parts(spark: SparkSession, count: int, share: int) -> int:
    """Partitions of about share rows, and fewer rows where cores would idle."""
    return max(1, -(-count // share), min(spark.sparkContext.defaultParallelism, count // 500))


def url_key(url: str | None) -> str:
    """The URL with its host reversed, port and fragment kept: com,example,www)/path?query."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        host = ""
    if not host:
        return "".join((url or "").split())
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return ",".join(reversed(host.split("."))) + port + ")" + "".join(rest.split())


def _header(url: str | None) -> str:
    """A URL as a header can hold it."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, gzipped. A revisit has the head of the response without its payload."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(data: bytes) -> tuple:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for a revisit) of one gzipped record. Raises ValueError if a payload and its digest differ."""
    head, _, block = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")).split(": ")[1])
    number = lambda field: int(field[10:-1]) if field[10:-1] else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    own = payload if fields["WARC-Type"] == "response" else None
    if own is not None and (len(own) != size or base64.b32encode(hashlib.sha1(own).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, own


def _open(store: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(store)


def _record_writer(store: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _open(store)
        out, name, at, part = None, "", 0, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, sha1, refers in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, part = f"task-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz", 0, part + 1
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers)
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["url_key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return write


def _line_key(url_key: str, page_id: int | None) -> tuple[bytes, int]:
    return url_key.encode(), -(1 << 63) if page_id is None else page_id


def _index_writer(store: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _open(store)
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, at, directory, block, first = None, 0, [], [], None

        def close_block() -> int:
            data = gzip.compress("\n".join(block).encode(), 6, mtime=0)
            out.write(data)
            directory.append(block[0].rsplit("\t", 3)[0] + f"\t{at}\t{len(data)}")
            block.clear()
            return at + len(data)

        for batch in batches:
            for key, page_id, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = files.open_output_stream(f"{root}/{name}.cdx.gz", compression=None), (key, page_id)
                block.append(f"{key}\t{'' if page_id is None else page_id}\t{archive}\t{offset}\t{length}")
                if len(block) == BLOCK_LINES:
                    at = close_block()
        if out is not None:
            if block:
                at = close_block()
            out.close()
            with files.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], type=pa.int64()), pa.array([name]), pa.array([len(directory)], type=pa.int64())], names=["url_key", "page_id", "shard", "blocks"])

    return write


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_dedup: int = 0, store: str | None = None) -> Archive:
    """Writes pages as archives and their index into store, a folder that all executors share."""
    spark = pages.sparkSession
    small_batches(spark)
    store = store or new_path(spark, "warc")
    files, root = _open(store)
    files.create_dir(root, recursive=True)
    source, _ = held(pages, {"page_id": page_id, "url": url, "payload": payload}, packed=False)
    body: Column = F.coalesce(F.col("payload").cast("string").cast("binary"), F.lit(b""))
    rows = source.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= min_dedup).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies, "payloads")
    known = (F.octet_length("payload") >= min_dedup) & (F.col("page_id") > F.col("first_page"))
    records = spread_join(rows, copies, "digest", "n", "left").select("page_id", "url", "payload", "digest", F.when(known, F.col("first_page")).alias("refers_to"))
    captures = written(records.mapInArrow(_record_writer(store), _CAPTURE), "captures")
    count, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    order = ("url_key", F.col("page_id").asc_nulls_first())
    ordered = captures.repartitionByRange(_parts(spark, count, SHARD_LINES), *order).sortWithinPartitions(*order)
    shards = written(ordered.mapInArrow(_index_writer(store), "url_key string, page_id long, shard string, blocks long"), "index-shards")
    return Archive(captures, shards, store, size / max(1, count))


class _Index:
    """The index as one task sees it; it holds one directory and one block at a time, as keys come sorted."""

    def __init__(self, store: str, shards: list[tuple]):
        self.files, self.root = _open(store)
        self.shards, self.keys = [s[2] for s in shards], [_line_key(s[0], s[1]) for s in shards]
        self.shard = self.directory = self.block = None
        self.open: dict[str, pa.NativeFile] = {}

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= OPEN_FILES:  # the one that was opened first goes
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)

    def _directory(self, n: int) -> tuple[list, list]:
        if self.shard != n:
            with self.files.open_input_file(f"{self.root}/{self.shards[n]}.idx") as f:
                lines = [x.rsplit("\t", 3) for x in f.read().decode().split("\n")]
            self.shard, self.block = n, None
            self.directory = [_line_key(k, int(p) if p else None) for k, p, _, _ in lines], [(int(o), int(size)) for _, _, o, size in lines]
        return self.directory

    def _block(self, n: int, b: int) -> tuple[list, list]:
        if not self.block or self.block[0] != (n, b):
            lines = [x.rsplit("\t", 4) for x in gzip.decompress(self._range(f"{self.shards[n]}.cdx.gz", *self.directory[1][b])).decode().split("\n")]
            self.block = (n, b), [_line_key(k, int(p) if p else None) for k, p, *_ in lines], [(a, int(o), int(size)) for _, _, a, o, size in lines]
        return self.block[1], self.block[2]

    def find(self, key: tuple[bytes, int]) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of the records of a capture; equal keys may go on in later blocks and shards."""
        n = max(bisect_left(self.keys, key) - 1, 0)
        while n < len(self.shards):
            firsts = self._directory(n)[0]
            for b in range(max(bisect_left(firsts, key) - 1, 0), len(firsts)):
                if firsts[b] > key:
                    return
                keys, places = self._block(n, b)
                yield from places[bisect_left(keys, key) : bisect_right(keys, key)]
            n += 1
            if n < len(self.shards) and self.keys[n] > key:
                return

    def read(self, archive: str, offset: int, length: int) -> tuple:
        return parsed(self._range(archive, offset, length))


def lookup(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of captures (url_key, page_id), through the index."""
    store = archive.store
    shards = sorted((tuple(r) for r in archive.shards.collect()), key=lambda r: _line_key(r[0], r[1]))  # one row per index partition
    order = ("url_key", F.col("page_id").asc_nulls_first())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(store, shards)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place in index.find(_line_key(key, page_id)):
                    rows.append((*index.read(*place), key, place[0]))
                    held += place[2]
                if held > 8 << 20:
                    yield _records(rows)
                    rows, held = [], 0
            yield _records(rows)

    asked = captures.select("url_key", F.col("page_id").cast("long"))
    parts = _parts(asked.sparkSession, asked.count(), max(1, int(TASK_BYTES / max(1.0, archive.mean))))
    return asked.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(read, _RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "url_key", "archive"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)
