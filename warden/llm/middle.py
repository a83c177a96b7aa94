"""Fill-in-middle: texts cut at two token borders and written prefix, suffix, middle.

Token borders are found through content-defined chunks. A rolling hash over the last ``WINDOW`` bytes cuts texts where it
falls on a mark, so passages that documents share fall into the same chunks wherever they stand. What a chunk adds to a
token count is kept in a cache under the chunk's bytes: a hash finds the entry, the bytes confirm it. Such a summary
says whether the chunk begins and ends with white space, how many tokens end inside it and how many characters it has.
Summaries combine from left to right: a token also ends between a chunk that ends in a word and one that begins with
white space, or the end. Running sums lead to the chunk that holds a cut; only that chunk is read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warden.llm.common import chunks, id_and_text, record_batch, take_memory

WINDOW = 32  # bytes that the rolling hash looks back on
LEAST, USUAL, MOST = 64, 512, 4096  # bytes of a chunk: at least, on average about, at most
CACHE_BYTES = 32 << 20  # chunk bytes that a worker keeps; then it starts anew
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = (PREFIX, SUFFIX, MIDDLE)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 20  # bytes hashed together
_U = np.uint64


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_VALUES = _byte_values()


def rolling_marks(raw: np.ndarray) -> np.ndarray:
    """Places in ``raw`` after which the hash of the last WINDOW bytes falls on a mark.

    The hash of a window is the sum of its bytes' values, each shifted by its distance from the window's end.
    """
    found = []
    for a in range(0, len(raw), _BLOCK):
        back = min(a, WINDOW - 1)
        total = _VALUES[raw[a - back : a + _BLOCK]]
        for shift in (1, 2, 4, 8, 16):  # doubles the window: H(2w, i) = H(w, i) + (H(w, i - w) << w)
            older = total[:-shift] << _U(shift)
            total[shift:] += older
        spread = total[back:] * _U(0x9E3779B97F4A7C15)
        found.append(np.flatnonzero(spread >> _U(65 - USUAL.bit_length()) == 0) + a + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(raw: np.ndarray, ends: list[int]) -> list[list[int]]:
    """For each text (they end at ``ends``, one after another) the ends of its chunks.

    A mark closes a chunk of at least LEAST bytes; without one it closes after MOST. Where a text begins does not move
    the marks further on, so shared passages find the same borders again after the first mark in them.
    """
    marks = rolling_marks(raw)
    first = np.searchsorted(marks, [0, *ends])
    out, start = [], 0
    for i, end in enumerate(ends):
        mine, at = [], start
        for mark in marks[first[i] : first[i + 1]].tolist():
            while mark - at > MOST:
                at += MOST
                mine.append(at)
            if mark - at >= LEAST and mark < end:
                mine.append(mark)
                at = mark
        while end - at > MOST:
            at += MOST
            mine.append(at)
        if end > at:
            mine.append(end)
        out.append(mine)
        start = end
    return out


def word_ends(chunk: bytes) -> np.ndarray:
    """Places inside the chunk where a word ends: white space follows within the chunk."""
    white = _WHITE[np.frombuffer(chunk, np.uint8)]
    return np.flatnonzero(~white[:-1] & white[1:]) + 1


def summarise(chunk: bytes) -> tuple[bool, bool, int, int]:
    """Begins with white space, ends with it, words that end inside, characters."""
    raw = np.frombuffer(chunk, np.uint8)
    white = _WHITE[raw]
    inside = int(np.count_nonzero(~white[:-1] & white[1:]))
    return bool(white[0]), bool(white[-1]), inside, int(np.count_nonzero((raw & 0xC0) != 0x80))


class Chunks:
    """Summaries of chunks seen before, found by hash and confirmed by content; bounded in bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[bytes, tuple] = {}
        self.limit, self.held, self.hits = limit, 0, 0

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def summary(self, chunk: bytes) -> tuple[bool, bool, int, int]:
        found = self.known.get(chunk)  # a dict looks up by hash and compares the bytes
        if found is not None:
            self.hits += 1
            return found
        found = summarise(chunk)
        if self.held > self.limit:
            self.forget()
        self.held += len(chunk) + 150
        self.known[chunk] = found
        return found


class Borders:
    """Token borders of one text, read off its chunks' summaries.

    Tokens are words with the white space before them; white space at the end is a token of its own. ``n`` is their number.
    """

    def __init__(self, text: bytes, ends: list[int], memory: Chunks):
        self.text, self.starts, self.ends = text, [0, *ends][: len(ends)], ends
        found = [memory.summary(text[a:b]) for a, b in zip(self.starts, ends, strict=True)]
        # a word ends with a chunk if white space, or nothing, follows
        closes = [not f[1] and (i + 1 == len(found) or found[i + 1][0]) for i, f in enumerate(found)]
        self.tokens = np.cumsum([f[2] + c for f, c in zip(found, closes, strict=True)], dtype=np.int64)
        self.chars = np.cumsum([0, *(f[3] for f in found)], dtype=np.int64)
        words = int(self.tokens[-1]) if found else 0
        self.n = words + bool(found and found[-1][1])

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and characters before the border that follows ``k`` tokens."""
        if k == 0:
            return 0, 0
        if k == self.n:
            return len(self.text), int(self.chars[-1])
        i = int(np.searchsorted(self.tokens, k))  # the chunk in which, or with which, word k ends
        before = int(self.tokens[i - 1]) if i else 0
        a, b = self.starts[i], self.ends[i]
        inside = word_ends(self.text[a:b])
        at = a + int(inside[k - before - 1]) if k - before <= len(inside) else b
        raw = np.frombuffer(self.text, np.uint8, at - a, a)
        return at, int(self.chars[i]) + int(np.count_nonzero((raw & 0xC0) != 0x80))


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("output", pa.string())])

_memory = Chunks()


def transform(text: bytes, ends: list[int], doc_id: int | None, seed: int, memory: Chunks) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    borders = Borders(text, ends, memory)
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = borders.n
    if not text or h3 % 100 >= FIM_PERCENT or any(mark.encode() in text for mark in _MARKS):
        return n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = sorted(borders.cut(h % (n + 1)) for h in (h1, h2))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
    P, S, M = (mark.encode() for mark in _MARKS)
    output = b"".join((S, s, P, p, M, m) if form == "spm" else (P, p, S, s, M, m))
    return n, form, a_chars, b_chars - a_chars, output


def fill_in_middle(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """Every text in fill-in-middle form: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``form`` is plain (the text as it is; prefix_chars and middle_chars null), psm or spm. A text that is empty or holds
    one of the three marks stays plain. Null text is empty; a null doc_id hashes as the seed alone. Each row is treated by
    itself, so repeated rows come out alike; other columns are left out. Nothing is shuffled. A task holds about 2 MB
    of text at a time (a longer text alone) and up to ``CACHE_BYTES`` of chunks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory(_memory)
        for batch in chunks(batches):
            column = batch.column("text")
            ids, texts = batch.column("doc_id").to_pylist(), [t.encode() for t in column.to_pylist()]
            ends = np.cumsum([len(t) for t in texts]).tolist()
            cuts = chunk_ends(np.frombuffer(b"".join(texts), np.uint8), ends)
            rows = [
                transform(t, [c - end + len(t) for c in cut], i, seed, _memory)
                for t, end, cut, i in zip(texts, ends, cuts, ids, strict=True)
            ]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield record_batch(
                _ARROW, doc_id=ids, n=n, form=form, prefix_chars=prefix, middle_chars=middle,
                output=[o.decode() for o in output],
            )

    return id_and_text(documents).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text before it was transformed. Marks are no part of a transformed text, so each occurs once in its output."""

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    after = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def digests(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """``fill_in_middle`` with digests of each output and of the text restored from it in place of the output."""
    done = fill_in_middle(documents, seed)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
