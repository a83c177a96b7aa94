"""WARC archives of pages, with revisit records, and a globally ordered index of captures.

Writing: each task writes one archive (a gzip member for each record) and sorts what it wrote by URL key and time, in
runs of bounded size. Index: the runs are dealt out by ranges of (URL key, time), and each range merges its pieces of
all runs with a loser tree, so that the files in order are the capture histories in order. Reading: the records are
fetched through this index and checked against their digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warden.llm.common import chunks, record_batch, shared_folder, written

REVISIT_FROM = 1000  # bytes; equal payloads from this size on are stored once
RUN_ENTRIES = 100_000  # captures that a task sorts at a time
_START = datetime(2024, 1, 1, tzinfo=UTC)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "url_key string, captured string, page_id bigint, run string, place bigint, path string, at bigint, size bigint"
)
_INDEX_SCHEMA = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("run", pa.string()),
    ("place", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()),
])


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then path and query; no scheme, ``www`` or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip()
    host = host.removeprefix("www.")
    port = f":{port}" if port and port not in (80, 443) else ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path}"


def captured_at(page_id: int | None) -> str:
    """Pages have no capture time; it follows from page_id, a second apart, so that it repeats."""
    try:
        return (_START + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return _START.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    value = identifier.strip("<>").removeprefix("urn:page:")
    return None if value == "none" else int(value)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One gzip member: a response, or a revisit of the page ``response``, whose payload stays out."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if response is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {captured_at(page_id)}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if response is not None:
        head += [f"WARC-Refers-To: {record_id(response)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


_URL_SAFE = "%/:?#[]@!$&'()*+,;=~"


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP message, payload."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record: {version[:20]}")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record has another length than it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """Merges sorted sources. Inner nodes hold the loser of their match, so the next winner costs one path of matches."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * len(sources)
        self.winner = -1
        for i in range(len(sources)):
            self._replay(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether source ``a`` goes first; one at its end goes last."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, source: int, building: bool = False) -> None:
        node = (source + len(self.sources)) // 2
        while node:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = source  # waits here for the winner from the other side
                return
            if self._before(other, source):
                self.losers[node], source = source, other
            node //= 2
        self.winner = source

    def __iter__(self) -> Iterator[tuple]:
        while self.sources and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.sources[self.winner], None)
            self._replay(self.winner)


def with_response(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and response: the page whose record a revisit names, null for a response.

    Among equal payloads of at least ``REVISIT_FROM`` bytes the largest page_id is the response. Rows that share that
    page_id all are responses, and so are all rows of a payload that only rows without a page_id have.
    """
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= REVISIT_FROM
    shared = (
        rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .filter(F.col("n") > 1).select("digest", "last")
    )
    revisits = large & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    joined = rows.join(shared, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("last")).alias("response"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each page and returns the index entries, sorted by key and time within each ``run``.

    An archive of an attempt that did not count stays unnamed. No pages: no archives.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        stream, at, runs, entries = None, 0, 0, []

        def run() -> pa.RecordBatch:
            entries.sort(key=lambda e: _order(e[0], e[1], e[2]))
            columns = list(zip(*entries, strict=True))
            values = dict(zip(("url_key", "captured", "page_id", "at", "size"), columns, strict=True))
            n = len(entries)
            entries.clear()
            return record_batch(
                _INDEX_SCHEMA, **values, run=[f"{name}-{runs}"] * n, place=range(n), path=[f"{folder}/{name}.warc.gz"] * n
            )

        for batch in chunks(batches, "payload"):
            if stream is None:
                store, base = pafs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
            for r in batch.to_pylist():
                data = write_record(r["page_id"], r["url"], r["payload"].encode(), r["digest"], r["response"])
                stream.write(data)
                entries.append((url_key(r["url"]), captured_at(r["page_id"]), r["page_id"], at, len(data)))
                at += len(data)
            if len(entries) >= RUN_ENTRIES:
                yield run()
                runs += 1
        if stream is not None:
            stream.close()
        if entries:
            yield run()

    return written(with_response(pages).mapInArrow(write, _INDEX), folder)


def _order(key: str, captured: str, page_id: int | None) -> tuple:
    return key, captured, page_id is not None, page_id or 0


def merge_runs(index: DataFrame) -> DataFrame:
    """The index in global order of URL key, time and page_id: by partition, then by row.

    A range of (key, time, page_id) meets in a task, so a key of any size is spread. Each task merges the pieces of the
    runs it gets, none of which it sorts again.
    """

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                entry = (_order(r["url_key"], r["captured"], r["page_id"]), r["run"], r["place"], r["path"], r["at"], r["size"])
                runs.setdefault(r["run"], []).append(entry)
        for entries in runs.values():
            entries.sort(key=lambda e: e[2])  # blocks of a run can arrive in any order
        out: list[tuple] = []
        for order, *rest in LoserTree([iter(e) for e in runs.values()]):
            key, captured, known, page = order
            out.append((key, captured, page if known else None, *rest))
            if len(out) >= 10_000:
                yield record_batch(_INDEX_SCHEMA, **dict(zip(_INDEX_SCHEMA.names, zip(*out, strict=True), strict=True)))
                out.clear()
        if out:
            yield record_batch(_INDEX_SCHEMA, **dict(zip(_INDEX_SCHEMA.names, zip(*out, strict=True), strict=True)))

    return index.repartitionByRange("url_key", "captured", "page_id").mapInArrow(merge, _INDEX)


def read_captures(index: DataFrame, keep: Callable[[dict, dict, bytes], tuple], schema: str, types: pa.Schema) -> DataFrame:
    """``keep`` of every indexed record (headers, HTTP headers, payload), in the order of the index."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = list(zip(*(batch.column(n).to_pylist() for n in ("path", "at", "size")), strict=True))
            found: list[tuple | None] = [None] * len(entries)
            stream, last = None, None
            for i in sorted(range(len(entries)), key=entries.__getitem__):
                path, at, size = entries[i]
                if path != last:
                    if stream is not None:
                        stream.close()
                    store, name = pafs.FileSystem.from_uri(path)
                    stream, last = store.open_input_file(name), path
                stream.seek(at)
                headers, http, payload = read_record(stream.read(size))
                if headers["WARC-Type"] == "response" and hashlib.sha1(payload).digest() != _digest(headers):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                found[i] = keep(headers, http, payload)
            if stream is not None:
                stream.close()
            if found:
                yield record_batch(types, **dict(zip(types.names, zip(*found, strict=True), strict=True)))

    return index.mapInArrow(read, schema)


def _digest(headers: dict[str, str]) -> bytes:
    return base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))


def _summary(headers: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    refers = headers.get("WARC-Refers-To")
    return (
        page_of(headers["WARC-Record-ID"]), int(http["Content-Length"]), _digest(headers).hex(), headers["WARC-Type"],
        page_of(refers) if refers else None, headers["WARC-Target-URI"], headers["WARC-Date"],
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archives all pages, merges the index and reads every record through it.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to, url, captured, in order of capture
    histories. Null html is an empty payload; null urls are written as ``urn:none``.
    """
    index = merge_runs(write_archives(pages, shared_folder(pages.sparkSession)))
    types = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("captured", pa.string()),
    ])
    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "url string, captured string"
    )
    return read_captures(index, _summary, schema, types)
