"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so all that a packing decides on is the histogram of lengths: at most
``capacity`` counts, whatever the corpus. The plan is made from these counts; every piece then finds its place by its
length and its rank among the pieces of that length.

1. Large lengths are sorted, dealt into groups of equal cardinality and rounded up to their group's largest.
2. Configurations of the few rounded sizes are optimised by column generation (knapsack pricing, simplex steps).
3. The actual pieces take the places of the rounded ones, longest first, which leaves gaps.
4. Large pieces that rounding down of configurations left over, then the small ones, go best fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from warden.llm.common import chunks, id_and_text, record_batch, take_memory, written
from warden.llm.tokens import tokenizer

CAPACITY = 2048
#: (small, groups): lengths up to capacity / small are small. All are tried, the plan with the fewest sequences is taken.
SETTINGS = ((2, 48), (3, 48), (4, 48))
END_ID = 0


class Slot(NamedTuple):
    """Pieces of ``length`` with ranks ``rank`` to ``rank + count - 1`` lie at ``offset`` in sequences from ``first``."""

    length: int
    rank: int
    count: int
    first: int
    offset: int


# --- the plan, from counts alone -------------------------------------------------------------------------------


def group_sizes(lengths: list[int], counts: list[int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, items) of groups of equal cardinality; ``lengths`` descend. Equal rounded sizes are merged."""
    total, sizes = sum(counts), {}
    per = max(1, -(-total // groups))
    seen = 0
    top = None
    for length, count in zip(lengths, counts, strict=True):
        while count:
            if seen % per == 0:
                top = length
            take = min(count, per - seen % per)
            sizes[top] = sizes.get(top, 0) + take
            seen += take
            count -= take
    return list(sizes.items())


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes that fits, as counts by size."""
    best = np.zeros(capacity + 1)
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    picks = []
    for _ in range(capacity // int(sizes.min())):  # one more item in each round
        got = np.where(room >= 0, best[np.maximum(room, 0)] + values[:, None], -1.0)
        k = got.argmax(axis=0)
        more = got[k, np.arange(capacity + 1)]
        better = more > best + 1e-12
        picks.append(np.where(better, k, -1))
        best = np.where(better, more, best)
    counts, left = np.zeros(len(sizes), dtype=np.int64), capacity
    for pick in reversed(picks):
        if pick[left] >= 0:
            counts[pick[left]] += 1
            left -= int(sizes[pick[left]])
    return float(best[capacity]), counts


def configurations(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (items by size) and how often each is used, of the optimal fractional solution rounded down."""
    widths = np.array([s for s, _ in sizes], dtype=np.int64)
    demand = np.array([c for _, c in sizes], dtype=float)
    k = len(widths)
    basis = np.diag([float(capacity // w) for w in widths])
    inverse = np.linalg.inv(basis)
    for step in range(40 * k):
        price, column = best_pattern(widths, inverse.sum(axis=0), capacity)
        if price <= 1 + 1e-7:
            break
        direction, level = inverse @ column, inverse @ demand
        ratios = np.where(direction > 1e-9, np.maximum(level, 0) / np.maximum(direction, 1e-9), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
        if step % 32 == 31:
            inverse = np.linalg.inv(basis)  # against rounding errors
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    uses = np.linalg.inv(basis) @ demand
    return [(basis[:, j].round().astype(int).tolist(), int(uses[j] + 1e-6)) for j in range(k) if uses[j] >= 1 - 1e-6]


class _Bins:
    """Runs of sequences with equal room: room -> [(first sequence, count, filled)]."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.by_room: dict[int, list[tuple[int, int, int]]] = {}
        self.slots: list[Slot] = []
        self.rank: dict[int, int] = {}

    def put(self, length: int, first: int, count: int, offset: int) -> None:
        rank = self.rank.get(length, 0)
        self.slots.append(Slot(length, rank, count, first, offset))
        self.rank[length] = rank + count

    def add(self, first: int, count: int, filled: int) -> None:
        if count:
            self.by_room.setdefault(self.capacity - filled, []).append((first, count, filled))

    def best_fit(self, length: int, count: int) -> None:
        """Each of ``count`` items into the fullest sequence it fits, a new one if none; runs are dealt with at once."""
        rooms = sorted(r for r in self.by_room if r >= length)
        while count:
            if not rooms:
                fits = self.capacity // length
                whole, rest = divmod(count, fits)
                for filled, bins, items in ((fits, whole, fits), (rest, 1 if rest else 0, rest)):
                    for j in range(items if bins else 0):
                        self.put(length, self.next, bins, j * length)
                    self.add(self.next, bins, filled * length)
                    self.next += bins
                return
            room = rooms[0]
            if not self.by_room.get(room):
                self.by_room.pop(room, None)
                rooms.pop(0)
                continue
            first, bins, filled = self.by_room[room].pop()
            fits = room // length
            whole = min(bins, count // fits)
            for j in range(fits if whole else 0):
                self.put(length, first, whole, filled + j * length)
            self.add(first, whole, filled + fits * length)
            count -= whole * fits
            rest = count if whole < bins else 0  # fewer than one sequence takes
            if rest:
                for j in range(rest):
                    self.put(length, first + whole, 1, filled + j * length)
                self.add(first + whole, 1, filled + rest * length)
                count, whole = 0, whole + 1
            self.add(first + whole, bins - whole, filled)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = 2, groups: int = 48) -> tuple[int, list[Slot]]:
    """Sequences used and the slots of all pieces, for counts by length."""
    bins = _Bins(capacity)
    left = dict(histogram)
    large = sorted((x for x in left if x > capacity // small), reverse=True)
    if large:
        sizes = group_sizes(large, [left[x] for x in large], groups)
        # Pieces of a group, longest first: runs (length, count) that its rounded places use up.
        runs: dict[int, list[list[int]]] = {s: [] for s, _ in sizes}
        lengths = iter(large)
        rest, length = 0, 0
        for top, items in sorted(sizes, reverse=True):
            while items:
                if not rest:
                    length = next(lengths)
                    rest = left[length]
                take = min(rest, items)
                runs[top].append([length, take])
                rest -= take
                items -= take
        tops = [s for s, _ in sizes]
        for pattern, uses in configurations(sizes, capacity):
            places = [top for top, n in zip(tops, pattern, strict=True) for _ in range(n)]
            while uses:
                chosen, taken = [], {}
                for top in places:  # the run that each place draws from, and how long all of them last
                    free = [r for r in runs[top] if r[1] > taken.get(id(r), 0)]
                    if not free:
                        continue
                    chosen.append(free[0])
                    taken[id(free[0])] = taken.get(id(free[0]), 0) + 1
                if not chosen:
                    break
                count = min(uses, *(r[1] // taken[id(r)] for r in chosen))
                offset = 0
                for r in chosen:
                    bins.put(r[0], bins.next, count, offset)
                    offset += r[0]
                    r[1] -= count
                    left[r[0]] -= count
                bins.add(bins.next, count, offset)
                bins.next += count
                uses -= count
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        bins.best_fit(length, left[length])
    return bins.next, bins.slots


# --- pieces and places -----------------------------------------------------------------------------------------

_PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, shard int, rank bigint"


def token_pieces(path: str, capacity: int, end_id: int = END_ID):
    """A function for mapInArrow: the pieces of each text, with their rank among those of one length in the task."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
        ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("rank", pa.int64()),
    ])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = tokenizer(path), TaskContext.get().partitionId()
        take_memory(tok)
        seen = np.zeros(capacity + 1, dtype=np.int64).tolist()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in chunks(batches):
            rows: dict[str, list] = {f.name: [] for f in schema}
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, ids in zip(docs, tok.encode_bytes(texts), strict=True):
                data = memoryview(np.frombuffer(ids, f"<u{tok.itemsize}").astype("<u4").tobytes() + end)
                total = len(data) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    for name, value in zip(rows, (doc, piece, start, n, zlib.crc32(part), shard, seen[n]), strict=True):
                        rows[name].append(value)
                    seen[n] += 1
            yield record_batch(schema, **rows)

    return encode


def place(plan_slots: list[Slot]):
    """A function for mapInArrow that adds sequence_id and offset to pieces with ``length`` and ``rank``."""
    slots = sorted(plan_slots)
    length, rank, _, first, offset = (np.array(x, dtype=np.int64) for x in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 5
    lengths, starts = np.unique(length, return_index=True)
    stops = np.append(starts[1:], len(slots))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("length").to_numpy(zero_copy_only=False)
            own = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(size), dtype=np.int64)
            for k in np.unique(size):
                j = np.searchsorted(lengths, k)
                a, b, of = starts[j], stops[j], size == k
                at[of] = a + np.searchsorted(rank[a:b], own[of], side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(n) for n in names]
            columns[3] = columns[3].cast(pa.int64())
            columns += [pa.array(first[at] + own - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return assign


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset; at most ``capacity`` tokens in a sequence.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every document ends with ``end_id``; a longer
    one is cut into pieces of ``capacity``. Null text is empty (one token). Rows with one doc_id, or with none, are
    documents of their own. No documents: no rows. Other columns are not read.

    One pass encodes; its small table of pieces is written once, then counted by length, ranked and placed. Ranks come
    from counts by task and length, so a length that a third of all pieces have is no group of rows anywhere. To the
    driver goes one count for each length.
    """
    pieces = written(
        id_and_text(documents).mapInArrow(token_pieces(tokenizer_path, capacity, end_id), _PIECES)
    )
    by_task = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    _, slots = min((plan(histogram, capacity, *s) for s in SETTINGS), key=lambda p: p[0])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_task.select("length", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "shard"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")
    )
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place(slots), out)
