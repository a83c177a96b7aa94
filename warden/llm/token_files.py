"""Files of token ids in patched frame-of-reference blocks.

A file holds the ids of whole documents, one after another, in blocks of ``BLOCK`` ids::

    magic | block ... | block index: start of each block, u64 | document table: id i64, null flag u8, ids u64
    | footer: ids u64, documents u64, block index at u64, document table at u64, magic

    block: minimum u32, width u8, exceptions u16, count u16 | packed low bits | positions u8 | high bits u32

The minimum of a block is subtracted, what is left is packed at the width that the ``PERCENTILE`` of the block needs,
and the high bits of larger values stand in the exception list. The index of block starts lets a reader take any range
of ids and touch only its blocks. Values are packed in eight lanes of 32, so that packing and unpacking run over many
blocks at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from warden.llm.common import chunks, id_and_text, record_batch, shared_folder, take_memory, written
from warden.llm.tokens import tokenizer

BLOCK = 256
PERCENTILE = 90
MAGIC = b"PFOR0001"
_HEAD = struct.Struct("<IBHH")
_HEAD_FIELDS = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("count", "<u2")])  # as _HEAD
_FOOT = struct.Struct("<QQQQ8s")
_AT_ONCE = 2048  # blocks packed or unpacked together
END_ID = 0


def bits(values: np.ndarray) -> np.ndarray:
    """Bits that each non-negative value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2 ** width as rows of BLOCK * width / 8 bytes."""
    v = values.reshape(len(values), 32, BLOCK // 32).astype(np.uint32)
    out = np.zeros((len(v), width, BLOCK // 32), dtype=np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out.astype("<u4").reshape(len(v), -1).view(np.uint8)


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack_bits``; ``data`` is rows of bytes."""
    words = np.ascontiguousarray(data).view("<u4").reshape(len(data), width, BLOCK // 32)
    out = np.zeros((len(data), 32, BLOCK // 32), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        v = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            v = v | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, i] = v & mask
    return out.reshape(len(data), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of some ids; only the last may hold fewer than BLOCK."""
    if not len(ids):
        return []
    full = -(-len(ids) // BLOCK) * BLOCK
    rows = np.concatenate([ids, np.full(full - len(ids), ids[-1], dtype=ids.dtype)]).astype(np.uint32).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    k = BLOCK * PERCENTILE // 100 - 1
    widths = bits(np.partition(rest, k, axis=1)[:, k])
    high = rest >> widths[:, None].astype(np.uint32)
    payload: list[bytes] = [b""] * len(rows)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        low = rest[of] & np.uint32((1 << int(w)) - 1)
        for j, line in zip(of.tolist(), pack_bits(low, int(w)), strict=True):
            payload[j] = line.tobytes()
    block, position = np.nonzero(high)
    edges = np.searchsorted(block, np.arange(len(rows) + 1)).tolist()
    position, value = position.astype(np.uint8), high[high > 0].astype("<u4")
    counts = [BLOCK] * (len(rows) - 1) + [len(ids) - (len(rows) - 1) * BLOCK]
    return [
        _HEAD.pack(m, w, b - a, n) + p + position[a:b].tobytes() + value[a:b].tobytes()
        for m, w, a, b, n, p in zip(least.tolist(), widths.tolist(), edges, edges[1:], counts, payload, strict=False)
    ]


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    begin = np.array(starts, dtype=np.int64)
    heads = np.ascontiguousarray(raw[begin[:, None] + np.arange(_HEAD.size)]).view(_HEAD_FIELDS).reshape(-1)
    rows = np.zeros((len(heads), BLOCK), dtype=np.uint32)
    widths, exceptions = heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    at = begin + _HEAD.size
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        if w:
            rows[of] = unpack_bits(raw[at[of][:, None] + np.arange(BLOCK * w // 8)], int(w))
    block = np.repeat(np.arange(len(heads)), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    positions = at + BLOCK * widths // 8
    values = raw[((positions + exceptions)[block] + 4 * nth)[:, None] + np.arange(4)]
    high = np.ascontiguousarray(values).view("<u4").reshape(-1) << widths[block].astype(np.uint32)
    rows[block, raw[positions[block] + nth]] |= high  # no position of a block twice
    rows += heads["minimum"][:, None]
    flat = rows.reshape(-1)
    return flat[: (len(heads) - 1) * BLOCK + int(heads["count"][-1])] if len(heads) else flat


class Writer:
    """Writes documents of ids to an open binary stream; full groups of blocks leave memory at once."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= BLOCK * _AT_ONCE:
            self._flush(self.held_ids // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for a in range(0, n, BLOCK * _AT_ONCE):
            found = encode_blocks(ids[a : min(n, a + BLOCK * _AT_ONCE)])
            for b in found:
                self.starts.append(self.at)
                self.at += len(b)
            self.stream.write(b"".join(found))
        self.held, self.held_ids = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held_ids)
        table = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        table += np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array(self.sizes, "<u8").tobytes()
        index = np.array(self.starts, "<u8").tobytes()
        foot = _FOOT.pack(sum(self.sizes), len(self.docs), self.at, self.at + len(index), MAGIC)
        self.stream.write(index + table + foot)


class Reader:
    """Reads a file that ``Writer`` wrote from a seekable stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _FOOT.size)
        self.n_ids, self.n_docs, index_at, table_at, magic = _FOOT.unpack(stream.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("this is no whole file of token ids")
        stream.seek(index_at)
        rest = stream.read(size - _FOOT.size - index_at)
        n = (table_at - index_at) // 8
        self.starts = np.append(np.frombuffer(rest, "<u8", n), index_at).astype(np.int64)
        at = 8 * n
        self.doc_ids = np.frombuffer(rest, "<i8", self.n_docs, at)
        self.no_id = np.frombuffer(rest, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.sizes = np.frombuffer(rest, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``, by reading their blocks alone."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        self.stream.seek(int(self.starts[a]))
        data = self.stream.read(int(self.starts[b] - self.starts[a]))
        return decode_blocks(data, (self.starts[a:b] - self.starts[a]).tolist())[start - a * BLOCK : stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document in turn; ids are read in groups of blocks."""
        start, group, ids, base = 0, BLOCK * _AT_ONCE, np.zeros(0, np.uint32), 0
        for doc, none, size in zip(self.doc_ids.tolist(), self.no_id.tolist(), self.sizes.tolist(), strict=True):
            if start + size > base + len(ids):
                ids, base = self.ids(start, min(self.n_ids, max(start + size, start + group))), start
            yield (None if none else doc), start, ids[start - base : start - base + size]
            start += size


_SHARDS = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes all documents and writes their ids in ascending doc_id order, a file for each range of doc_id.

    Returns the written list of files: shard, path, documents, ids, start (ids in earlier files). Null text is empty and
    gives ``end_id`` alone; null doc_ids come first; rows with one doc_id are ordered by their text. No documents: no
    files. A task that runs twice writes two files, and only that of the attempt that counted is in the list.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, out, context = tokenizer(tokenizer_path), None, TaskContext.get()
        take_memory(tok)
        end = np.array([end_id], np.uint32)
        for batch in chunks(batches):
            if out is None:
                store, base = pafs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                path = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.pfor"
                stream = store.open_output_stream(f"{base}/{path}")
                out = Writer(stream)
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, ids in zip(docs, tok.encode_bytes(texts), strict=True):
                out.add(doc, np.concatenate([np.frombuffer(ids, f"<u{tok.itemsize}"), end]).astype(np.uint32))
        if out is not None:
            out.close()
            stream.close()
            yield record_batch(
                _SHARDS, shard=[context.partitionId()], path=[f"{folder}/{path}"], documents=[len(out.docs)],
                ids=[sum(out.sizes)],
            )

    ordered = id_and_text(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = written(ordered.mapInArrow(write, "shard int, path string, documents bigint, ids bigint"), folder)
    # One row for each file, so a single ordered window is small at any size of the corpus.
    earlier = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("start", F.coalesce(earlier, F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the listed files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as stream:
                    rows = [
                        (doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for doc, start, ids in Reader(stream, stream.size()).documents()
                    ]
                yield record_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(parts).mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def encode_and_read(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of all documents to the shared folder and returns what reading them back gives."""
    folder = shared_folder(documents.sparkSession)
    return read_token_files(write_token_files(documents, folder, tokenizer_path, end_id))
