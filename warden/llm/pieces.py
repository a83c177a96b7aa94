"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

The text is normalised here, not in the library: at each place the longest prefix that the model's compiled character
map knows is replaced, and every normalised byte records the original byte it comes from. The library then segments the
normalised text as it stands, the lengths of its pieces give their ends in the normalised text, and the recorded
alignment projects these to byte spans of the original.

Compiled character map (fixed format of the public library): u32 size of the trie, the trie as a double array of u32
units, then the replacements, each ended by a zero byte; a leaf's value is the place of its replacement.

A worker segments each word once: no piece of a byte-pair model reaches over the border before a space mark that
follows another character, if none in its vocabulary does, so such parts are segmented alone, with the same result.
Models for which this cannot be seen get whole texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from warden.llm.common import chunks, id_and_text, record_batch, take_memory

SPACE_MARK = "▁"
CACHE_WORDS = 500_000  # parts a worker keeps before it starts anew


class CharacterMap:
    """Longest-prefix replacement through a compiled character map; an empty one replaces nothing."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = memoryview(compiled[4 : 4 + size]).cast("I") if size else None
        self.replacements = compiled[4 + size :]
        self.first = np.zeros(256, dtype=bool)  # bytes that some entry begins with
        if self.units:
            at = self._offset(self.units[0])
            for b in range(1, 256):
                self.first[b] = (at ^ b) < len(self.units) and self._label(self.units[at ^ b]) == b

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    @staticmethod
    def _label(unit: int) -> int:
        return unit & 0x800000FF

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry at ``start``."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(start, len(data)):
            node ^= data[i]
            if node >= len(units) or self._label(units[node]) != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit & 0x100:
                found = (i + 1 - start, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]

    def apply(self, data: bytes, kept: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the original byte it comes from. What ``kept`` matches stays."""
        raw = np.frombuffer(data, np.uint8)
        if self.units is None or not self.first[raw].any():
            return raw, np.arange(len(raw), dtype=np.int64)
        spans = [m.span() for m in kept.finditer(data)] if kept else []
        out, origin, done, k = [], [], 0, 0
        for at in np.flatnonzero(self.first[raw] & ((raw & 0xC0) != 0x80)).tolist():
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            if at < done or (k < len(spans) and spans[k][0] <= at):
                continue
            if (found := self.longest(data, at)) is None:
                continue
            out += [raw[done:at], np.frombuffer(found[1], np.uint8)]
            origin += [np.arange(done, at), np.full(len(found[1]), at)]
            done = at + found[0]
        out.append(raw[done:])
        origin.append(np.arange(done, len(raw)))
        return np.concatenate(out), np.concatenate(origin).astype(np.int64)


class OffsetEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.mark = SPACE_MARK if spec.escape_whitespaces else " "
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        own = [p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED]
        own.sort(key=len, reverse=True)
        self.kept = re.compile(b"|".join(map(re.escape, own))) if own else None
        self.widths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces])
        self.by_word = (
            proto.trainer_spec.model_type == proto.trainer_spec.BPE and proto.trainer_spec.byte_fallback
            and not own and self.mark == SPACE_MARK
            and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in proto.pieces)
        )
        self.words: dict[str, bytes] = {}
        self.digits = [f"{i}," for i in range(len(proto.pieces))]
        self.opens = np.array([p.piece.startswith(SPACE_MARK) for p in proto.pieces])

    def forget(self) -> None:
        self.words.clear()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original byte."""
        data = text.encode()
        out, origin = self.map.apply(data, self.kept)
        end = len(data)
        if self.squeeze:
            space = out == 0x20
            keep = ~(space & np.concatenate([[True], space[:-1]])) if len(out) else space
            if keep.any() and space[-1]:
                last = np.flatnonzero(keep)[-1]
                if space[last]:
                    keep[last], end = False, int(origin[last])
            out, origin = out[keep], origin[keep]
        if not len(out):
            return "", np.array([end])
        first = int(origin[0]) if self.squeeze else 0
        text = out.tobytes().decode()
        width = len(self.mark.encode())
        if width > 1:
            text = text.replace(" ", self.mark)
            origin = np.repeat(origin, np.where(out == 0x20, width, 1))
        extra = np.full(width if self.dummy else 0, end if self.suffix else first)
        if self.dummy and self.suffix:
            return text + self.mark, np.concatenate([origin, extra, [end]])
        return (self.mark if self.dummy else "") + text, np.concatenate([extra, origin, [end]])

    def _learn(self, new: list[str]) -> None:
        """Segments words joined, many in one call; each begins with the only space mark that it has."""
        words = self.words
        groups = [new[a : a + 128] for a in range(0, len(new), 128)]
        joined = [SPACE_MARK + SPACE_MARK.join(g) for g in groups]
        for group, ids in zip(groups, self.segmenter.encode(joined, num_threads=1), strict=True):
            flat = np.array(ids, dtype=np.uint32)
            cuts = [*(4 * np.flatnonzero(self.opens[flat])).tolist(), 4 * len(ids)]
            data = flat.tobytes()
            for w, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                words[w] = data[a:b]

    def ids(self, normalised: list[str]) -> Iterator[np.ndarray]:
        """The ids of normalised texts."""
        if not self.by_word:
            for ids in self.segmenter.encode(normalised, num_threads=1):
                yield np.array(ids, dtype=np.uint32)
            return
        words = self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        split = [t.split(SPACE_MARK) for t in normalised]
        known = [list(map(words.get, s)) for s in split]
        # Runs of marks, or text before the first one, are not words with one mark: such texts go whole.
        plain = [not s[0] and len(s) > 1 and "" not in s[1:] for s in split]
        self._learn(list({
            w for s, k, p in zip(split, known, plain, strict=True) if p for w, i in zip(s, k, strict=True) if i is None and w
        }))
        for text, s, k, p in zip(normalised, split, known, plain, strict=True):
            if p:
                k[0] = b""
                yield np.frombuffer(b"".join([words[w] if i is None else i for w, i in zip(s, k, strict=True)]), np.uint32)
            else:
                yield np.array(self.segmenter.encode(text), dtype=np.uint32)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first bytes and end bytes in the original of every piece."""
        normalised = [self.normalise(t) for t in texts]
        for (_, origin), ids in zip(normalised, self.ids([n for n, _ in normalised]), strict=True):
            ends = np.cumsum(self.widths[ids])
            yield ids, origin[ends - self.widths[ids]], origin[ends]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)

    def decimal(self, ids: list[int]) -> str:
        """The ids as decimal text, joined by commas."""
        return "".join(map(self.digits.__getitem__, ids))[:-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> OffsetEncoder:
    """One for each worker process and file."""
    return OffsetEncoder(path)


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins and ends (byte spans in the original text) of every document.

    Null and empty texts have empty lists; rows with one doc_id, or with none, are each encoded. Spans follow one another
    without a gap, so that what a map drops or joins belongs to the piece before it. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("ids", "begins", "ends"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        take_memory(model)
        for batch in chunks(batches):
            found = list(model.encode(batch.column("text").to_pylist()))
            columns = {n: [f[i].astype(np.int32) for f in found] for i, n in enumerate(("ids", "begins", "ends"))}
            yield record_batch(schema, doc_id=batch.column("doc_id"), **columns)

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, ids array<int>, begins array<int>, ends array<int>")


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Digests of what ``encode`` gives and of its decoding, without moving the lists out of the tasks.

    doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (bytes of the original that the spans of all pieces hold).
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
        ("span_bytes", pa.int64()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        take_memory(model)
        for batch in chunks(batches):
            rows = []
            for found, begins, ends in model.encode(batch.column("text").to_pylist()):
                ids = found.tolist()
                texts = model.decimal(ids), model.decode(ids)
                rows.append((len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts), int((ends - begins).sum())))
            columns = dict(zip(schema.names[1:], zip(*rows, strict=True), strict=True))
            yield record_batch(schema, doc_id=batch.column("doc_id"), **columns)

    return id_and_text(documents).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, span_bytes bigint"
    )
