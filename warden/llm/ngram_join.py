"""Exact Jaccard join of word-shingle sets by parity sketches.

A set's sketch deals its shingles out to cells by their hash and keeps the XOR of the hashes in each cell. One shingle
more or less changes one cell, so the Hamming distance of two sketches (the cells that differ) is at most the symmetric
difference of the sets. Sets of sizes a and b with Jaccard similarity of at least t differ in at most
``(a + b) (1 - t) / (1 + t)`` shingles: a sketch with more filled cells than that has a filled cell in common with each
of its partners (pigeonhole). The number of cells grows with the size band of the set; a set near the top of its band
also has a sketch with the cells of the next, where it meets larger partners.

Of the filled cells only the rarest are joined on: ordered by how many sets have them, the first common cell of two
partners is among the first ``difference + 1`` of both. Cells that one set alone has come first in this order and join
nothing, so a text of its own leaves the join at once, and a passage that many texts share is joined on only by texts
that consist of it. What still meets is compared with the leader of its cell, then, across the groups found so far, with
the rest of the cell, as far as parity sketches of one bit a place let it: their Hamming distance, too, is at most the
symmetric difference. What is left is verified on the shingles themselves.

A cell with more than ``HOT`` sets in several groups is cut twice. Its sets are joined again on their rarest shingles: linked
sets have all but a quarter of each in common, so they meet in that quarter and one shingle more. What is still hot (texts
that consist of one passage for three quarters) is dealt into blocks, and each pair of blocks is compared on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warden.llm.common import SALTS, chunks, id_and_text, met_by_key, record_batch, take_memory, written
from warden.llm.shingles import mix, shingle_sets

THRESHOLD = 75  # per cent
TINY = 64  # sets below this size have a cell for each shingle
BAND = 4  # sizes in a band differ by less than this factor
LOAD = 2.5  # shingles in a cell, at most, on average
_U = np.uint64
_FLUSH = 1 << 19  # cells that a task holds before it sends them on
HOT = 4096  # sets of a cell that are compared across groups in one task; above, the cell is cut
BLOCKS = 4  # blocks that a cell of HOT sets is dealt into; a task compares a pair of them
_CHUNK = 400  # texts compared with their leader in one task

# With LOAD 2.5 a set of n >= 64 shingles fills at least 0.36 n cells but for a chance below 1e-15, as for hashes that
# collide; it differs from a smaller partner in at most 0.286 n shingles.


def difference(a, b, percent: int = THRESHOLD):
    """The most shingles in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def largest_partner(n, percent: int = THRESHOLD):
    return n * 100 // percent


def bands(n: int, percent: int = THRESHOLD) -> list[int]:
    """The size band of a set, and the next if it has partners there; band 0 has a cell for each shingle."""
    band, top = 0, TINY
    while n >= top:
        band, top = band + 1, top * BAND
    return [band, band + 1] if largest_partner(n, percent) >= top else [band]


def sketch(shingles: np.ndarray, band: int) -> np.ndarray:
    """Keys of the filled cells: place and XOR of each. Equal keys are equal cells of one band."""
    if band == 0:
        return shingles
    cells = int(TINY * BAND**band / LOAD)
    place = ((shingles >> _U(32)) * _U(cells)) >> _U(32)  # ascends, as the hashes do
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return mix(np.bitwise_xor.reduceat(shingles, at) ^ mix(place[at] + _U(band << 48)))


def parity(shingles: np.ndarray) -> bytes:
    """One bit for each place: whether an odd number of shingles falls on it. Two to four places a shingle, at least 64."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(own: bytes, others: list[bytes]) -> np.ndarray:
    """Places in which parity sketches differ; of different lengths, the longer one is folded by XOR."""
    width = min(len(own), *map(len, others)) // 8

    def folded(sketch: bytes) -> np.ndarray:
        return np.bitwise_xor.reduce(np.frombuffer(sketch, "<u8").reshape(-1, width), axis=0)

    return np.bitwise_count(np.stack([folded(o) for o in others]) ^ folded(own)).sum(axis=1, dtype=np.int64)


def set_id(shingles: np.ndarray) -> int:
    """An even number for a set, the same for equal sets."""
    total = mix(shingles ^ _U(0x5BD1E9955BD1E995)).sum(dtype=np.uint64) + _U(len(shingles))
    return int((mix(np.array([total]))[0] << _U(1)).astype(np.int64))


# --- sets of the documents -----------------------------------------------------------------------------------------

_SETS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("filled", pa.list_(pa.int32()))]
)


def _sets(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory(None)
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield record_batch(
                _SETS, doc_id=batch.column("doc_id"), row=batch.column("row"), n=[len(s) for s in sets],
                set_id=[set_id(s) if len(s) else None for s in sets],
                filled=[[len(sketch(s, b)) for b in bands(len(s), percent)] if len(s) else [] for s in sets],
            )

    return run


# --- cells, sent in blocks of many to the task that sees all of one key -------------------------------------------------


def block_labels(spark: SparkSession) -> list[int]:
    """For each shuffle partition a number that hashes to it, so that blocks are dealt out evenly."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    rows = spark.range(parts * 40).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    return [r.id for r in rows]


def _deal(keys: np.ndarray, owners: np.ndarray, labels: list[int]) -> Iterator[tuple[int, bytes]]:
    """Blocks: for each label the keys that fall to it, with their owners, which come in runs and are kept as such."""
    slot = (keys % _U(len(labels))).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(len(labels) + 1)).tolist()
    keys, owners = keys[order], owners[order]
    for label, a, b in zip(labels, cuts[:-1], cuts[1:], strict=True):
        if b > a:
            starts = np.flatnonzero(np.concatenate([[True], owners[a + 1 : b] != owners[a : b - 1]]))
            lengths = np.diff(np.append(starts, b - a)).astype("<u4")
            yield label, b"".join((
                np.array([b - a, len(starts)], "<u8").tobytes(), keys[a:b].tobytes(), owners[a:b][starts].tobytes(),
                lengths.tobytes(),
            ))


def _undeal(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, owners = [], []
    for block in blocks:
        n, m = np.frombuffer(block, "<u8", 2).tolist()
        keys.append(np.frombuffer(block, "<u8", n, 16))
        runs = np.frombuffer(block, "<i8", m, 16 + 8 * n)
        owners.append(np.repeat(runs, np.frombuffer(block, "<u4", m, 16 + 8 * (n + m))))
    return np.concatenate(keys), np.concatenate(owners)


_BLOCKS = pa.schema([("label", pa.int32()), ("block", pa.binary())])


def _cells(percent: int, labels: list[int]):
    """A function for mapInArrow: key and owner of every filled cell. Equal sets in a task send theirs once.

    An owner is a set in a band: the set's number, plus one for the next band.
    """

    def flush(keys: list[np.ndarray], owners: list[tuple[int, int]]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        owner = np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners])
        found = list(_deal(key, owner, labels))
        return record_batch(_BLOCKS, label=[x for x, _ in found], block=[b for _, b in found])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory(None)
        seen: set[int] = set()
        keys, owners, held = [], [], 0
        for batch in chunks(batches):
            for shingles in shingle_sets(batch.column("text").to_pylist()):
                if not len(shingles) or (own := set_id(shingles)) in seen:
                    continue
                if len(seen) >= 300_000:
                    seen.clear()  # a set sent twice counts once where its cells meet
                seen.add(own)
                for up, band in enumerate(bands(len(shingles), percent)):
                    keys.append(sketch(shingles, band))
                    owners.append((own + up, len(keys[-1])))
                    held += len(keys[-1])
            if held >= _FLUSH:
                yield flush(keys, owners)
                keys, owners, held = [], [], 0
        if keys:
            yield flush(keys, owners)

    return run


_SHARED = pa.schema([("key", pa.int64()), ("owner", pa.int64()), ("sets", pa.int64())])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the cells in all blocks of a task, those that several owners have, with their number."""
    blocks = [b for batch in batches for b in batch.column("block").to_pylist()]
    if not blocks:
        return
    key, owner = _undeal(blocks)
    del blocks
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    order = order[same[1:] | same[:-1]]  # cells met once are left out before anything else
    key, owner = key[order], owner[order]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[first], owner[first]
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    count = count[group]
    key, owner, count = key[count > 1].view(np.int64), owner[count > 1], count[count > 1]
    for a in range(0, len(key), 50_000):
        yield record_batch(_SHARED, key=key[a : a + 50_000], owner=owner[a : a + 50_000], sets=count[a : a + 50_000])


def joined_cells(documents: DataFrame, sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """key, owner, set_id, n, place: the cells that a set is joined on, and how many rarer ones it has.

    ``sets`` has set_id, n, filled of the distinct sets.
    """
    spark = documents.sparkSession
    labels = block_labels(spark)
    blocks = documents.mapInArrow(_cells(percent, labels), "label int, block binary").repartition(len(labels), "label")
    shared = written(blocks.mapInArrow(_shared, "key bigint, owner bigint, sets bigint"))
    owners = sets.select("set_id", "n", F.posexplode("filled").alias("up", "cells")).select(
        (F.col("set_id") + F.col("up")).alias("owner"), "set_id", "n", "cells"
    )
    counted = shared.groupBy("owner").agg(F.count("*").alias("common"))
    alone = owners.join(counted, "owner").withColumn("alone", F.col("cells") - F.col("common"))
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent))
    alone = alone.withColumn("most", most).filter("alone <= most").select("owner", "set_id", "n", "alone", "most")
    rank = F.row_number().over(Window.partitionBy("owner").orderBy("sets", "key")) - 1
    placed = shared.join(alone, "owner").withColumn("place", rank + F.col("alone")).filter("place <= most")
    return placed.select("key", "set_id", "n", "place")


# --- candidates and verification -------------------------------------------------------------------------------------


def _may_link(n: str, m: str, i: str, j: str, percent: int):
    """Whether sets of n and m shingles may link that have i and j cells before their first common one."""
    a, b = F.col(n), F.col(m)
    allowed = F.floor((a + b) * (100 - percent) / (100 + percent))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.greatest(F.col(i), F.col(j)) <= allowed)


def leader_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """a, b: the leader of a cell, which has the fewest cells of its own for its size, with each other set of the cell."""
    rank = F.struct(
        (F.col("place") / F.col("n")).alias("share"), F.col("set_id").alias("a"), F.col("n").alias("m"),
        F.col("place").alias("j"),
    )
    leaders = cells.groupBy("key").agg(F.min(rank).alias("leader")).select("key", "leader.a", "leader.m", "leader.j")
    both = cells.join(leaders, "key").filter("set_id <> a").filter(_may_link("n", "m", "place", "j", percent))
    return both.select("a", F.col("set_id").alias("b")).distinct()


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _parities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_id and parity sketch of texts; a text that is not of the set (its row shares a doc_id) gives none."""
    for batch in chunks(batches):
        rows = [
            (own, parity(s))
            for own, s in zip(batch.column("set_id").to_pylist(), shingle_sets(batch.column("text").to_pylist()), strict=True)
            if own == set_id(s)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["set_id", "parity"]
        )


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_id and shingles of texts; a text that is not of the set gives none."""
    for batch in chunks(batches):
        rows = [
            (own, s.view(np.int64))
            for own, s in zip(batch.column("set_id").to_pylist(), shingle_sets(batch.column("text").to_pylist()), strict=True)
            if own == set_id(s)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
            ["set_id", "shingles"],
        )


def hot_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("key")


def rarest_shingles(hot: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """key, set_id, n, place, component: the sets of hot cells on their rarest shingles, in the place of the cells.

    Linked sets have ``percent`` of each in common. In one order of all shingles the first that both have is preceded by
    no more than the rest in either.
    """
    members = hot.select("set_id", "n", "component").distinct()
    own = texts.join(members.select("set_id"), "set_id", "left_semi").mapInArrow(_shingles, "set_id bigint, shingles array<bigint>")
    own = written(own.dropDuplicates(["set_id"]).select("set_id", F.explode("shingles").alias("key")))
    ranked = own.join(own.groupBy("key").agg(F.count("*").alias("sets")), "key")
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("sets", "key")) - 1
    placed = ranked.withColumn("place", rank.cast("bigint")).filter("sets > 1").join(members, "set_id")
    return placed.filter(F.col("place") * 100 <= F.col("n") * (100 - percent)).select("key", "set_id", "n", "place", "component")


def in_parts(rows: DataFrame, key: str, by: str, size: float, part: str, parts: str) -> DataFrame:
    """``rows`` with ``parts``, into how many parts of about ``size`` the rows of their ``key`` are dealt, and ``part``, which
    follows from ``by``.

    Only keys of several parts need their number; their rows meet it in ``SALTS`` places.
    """
    large = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(parts)).filter(F.col(parts) > 1)
    large = large.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.xxhash64(by)
    salted = rows.withColumn("__salt", F.pmod(own, F.lit(SALTS)).cast("int"))
    met = salted.join(large, [key, "__salt"], "left").withColumn(parts, F.coalesce(parts, F.lit(1))).drop("__salt")
    return met.withColumn(part, F.pmod(F.shiftrightunsigned(own, 8), parts).cast("int"))


def block_pairs(cells: DataFrame) -> DataFrame:
    """The rows with block, low, high: each row once for every pair (low, high) of its cell's blocks that has its own."""
    rows = in_parts(cells, "key", "set_id", HOT / BLOCKS, "block", "blocks")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")


def _across(percent: int):
    """A function for mapInArrow on rows sorted by key, low, high: pairs of sets from different groups that the sketches do
    not rule out, in one block or from two.
    """
    names = ["key", "low", "high", "block", "set_id", "n", "place", "component"]

    def pairs_in(columns: list[np.ndarray], sketches: dict[int, bytes], seen: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        key, low, high, block, sid, n, place, group = columns
        order = np.lexsort((group, high, low, key))
        key, low, high, block, sid, n, place, group = (c[order] for c in (key, low, high, block, sid, n, place, group))
        new_cell = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        cuts = [0, *(np.flatnonzero(new_cell) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            ends = a + np.searchsorted(group[a:b], group[a:b], side="right")  # the next group begins there
            for i in range(a, b):
                j = np.arange(ends[i - a], b)
                most = difference(n[i], n[j], percent)
                fits = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (
                    np.maximum(place[i], place[j]) <= most
                )
                if low[a] != high[a]:
                    fits &= block[j] != block[i]
                own = int(sid[i])
                pairs = [(own, x) if own < x else (x, own) for x in sid[j[fits]].tolist()]
                new = [k for k, p in enumerate(pairs) if p not in seen]
                if not new:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()  # a pair found twice is dropped later
                seen.update(pairs)
                mine = sketches[own]
                away = hamming(mine, [sketches[pairs[k][0] if pairs[k][1] == own else pairs[k][1]] for k in new])
                yield from (pairs[k] for k, x, m in zip(new, away.tolist(), most[fits][new].tolist(), strict=True) if x <= m)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[pa.RecordBatch] = []  # rows whose last cell may go on

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in names]
            sketches: dict[int, bytes] = {}
            for p in parts:
                sketches.update(zip(p.column("set_id").to_pylist(), p.column("parity").to_pylist(), strict=True))
            found: list[tuple[int, int]] = []
            for pair in pairs_in(columns, sketches, seen):
                found.append(pair)
                if len(found) > 100_000:
                    yield record_batch(_PAIRS, a=[x for x, _ in found], b=[x for _, x in found])
                    found.clear()
            if found:
                yield record_batch(_PAIRS, a=[x for x, _ in found], b=[x for _, x in found])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[:3])
            starts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            last = int(starts[-1]) if len(starts) else 0  # the batch's last cell begins there
            if held and not last:
                before = held[-1].slice(held[-1].num_rows - 1)
                if any(before.column(c)[0].as_py() != batch.column(c)[0].as_py() for c in names[:3]):
                    yield from flush(held)
                    held = []
            if last:
                yield from flush([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from flush(held)

    return run


def _compare(percent: int):
    """A function for mapInArrow: rows (a, part, b, text) sorted so that the leader's own row, b null, comes first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None  # the leader's (a, part) and its shingles
        for batch in chunks(batches, size=1 << 20):
            found = []
            if not batch.num_rows:
                continue
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), shingle_sets(batch.column("text").to_pylist()), strict=True)
            for a, part, b, shingles in rows:
                if set_id(shingles) != (a if b is None else b):
                    continue  # the text of another row with the same doc_id
                if b is None:
                    at, own = (a, part), shingles
                    continue
                if at != (a, part):
                    raise ValueError("the text of a set is missing")
                both = len(np.intersect1d(own, shingles, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(shingles) - both):
                    found.append((a, b))
            yield record_batch(_PAIRS, a=[x for x, _ in found], b=[x for _, x in found])

    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts link. ``texts`` has set_id, text.

    A set with many partners is compared in parts of about ``_CHUNK`` of them, each with its own copy of its text.
    """
    dealt = in_parts(pairs, "a", "b", _CHUNK, "part", "parts")
    members = dealt.join(texts.withColumnRenamed("set_id", "b"), "b").select("a", "part", "b", "text")
    lead = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("set_id", "a"), "a")
    rows = members.unionByName(lead.select("a", "part", F.lit(None).cast("bigint").alias("b"), "text"))
    spread = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "part")
    spread = spread.sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return spread.mapInArrow(_compare(percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes in ``links`` (a, b).

    Each turn moves every edge to smaller ends: the larger neighbours of a node are tied to its smallest neighbour, then
    every node and its smaller neighbours to the smallest of these. Ends when each node hangs on its smallest alone, in
    a number of turns that grows with the logarithm of the longest chain. Nothing is gathered by node.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(tied.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        ends = edges.groupBy("u").agg(F.count("*").alias("ends"))
        hung = edges.join(ends.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if hung.unionByName(ends.filter("ends > 1").select("u")).isEmpty():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def classes(documents: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, row (hash of the text), n, component of every document; the component of texts without a shingle is null."""
    docs = id_and_text(documents)
    rows = docs.withColumn("row", F.xxhash64("text"))
    sets = written(rows.mapInArrow(_sets(percent), "doc_id bigint, row bigint, n bigint, set_id bigint, filled array<int>"))
    distinct = sets.filter("set_id is not null").groupBy("set_id").agg(
        F.first("n").alias("n"), F.first("filled").alias("filled"), F.min(F.struct("doc_id", "row")).alias("one"),
        F.count("*").alias("copies"),
    )
    cells = written(joined_cells(docs, distinct, percent))
    met = cells.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    cells = written(cells.join(met, "key", "left_semi"))
    needed = cells.select("set_id").distinct().join(distinct.select("set_id", "one.doc_id", "one.row"), "set_id")
    # Each set takes the text of one row. Rows may share a doc_id, or lack one: the text's hash tells them apart.
    same = rows["doc_id"].eqNullSafe(needed["doc_id"]) & (rows["row"] == needed["row"])
    texts = written(rows.join(needed, same).select("set_id", "text"))
    links = written(verified(written(leader_pairs(cells, percent)), texts, percent))
    groups = components(links)
    known = cells.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    split = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    rest = written(known.join(split.select("key"), "key", "left_semi").select("key", "set_id", "n", "place", "component"))
    hot = rest.join(hot_cells(rest), "key", "left_semi")
    if not hot.isEmpty():
        rest = written(rest.join(hot_cells(rest), "key", "left_anti").unionByName(rarest_shingles(hot, texts, percent)))
    parities = texts.mapInArrow(_parities, "set_id bigint, parity binary").dropDuplicates(["set_id"])
    rest = block_pairs(rest).join(parities, "set_id")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rest.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    across = written(dealt.mapInArrow(_across(percent), "a bigint, b bigint").distinct())
    more = written(verified(across, texts, percent))
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    of_set = written(groups.withColumnRenamed("node", "set_id").join(distinct.select("set_id", "copies"), "set_id"))
    found = met_by_key(sets.drop("filled"), of_set, "set_id", "copies")
    return written(found.withColumn("component", F.coalesce("component", "set_id")))


def linked(documents: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link when the Jaccard similarity of their sets of distinct five-word shingles is at least ``percent``;
    component_id is the smallest doc_id reachable by links, the document's own included. Fewer than five words are one
    shingle. Null or empty texts, and texts of white space, have none and link with nothing. Rows with one doc_id are
    documents of their own; a null doc_id is never smallest unless all in a component are null. No documents: no rows.
    Equal sets (copies) are one set from the start: they cost their row and no more.
    """
    rows = classes(documents, percent)
    smallest = rows.filter("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.count("*").alias("members")
    )
    return met_by_key(rows, smallest, "component", "members").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, one of each component: that with the smallest doc_id, then the smallest hash of its text.

    Rows without a doc_id count like others and come last. Rows without a word link with nothing and stay. Of rows that
    share doc_id and text one stays, but for rows that have neither a doc_id nor a word, which all stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.withColumns({"__row": F.xxhash64(text), "__id": F.col("doc_id").cast("bigint")})
    nothing = F.col("__id").isNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    found = classes(rows.filter(~nothing), percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    kept = found.filter("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.row")
    kept = kept.unionByName(found.filter("component is null").select("doc_id", "row").distinct())
    chosen = rows.filter(~nothing).join(
        kept.select(F.col("doc_id").alias("__kept"), F.col("row").alias("__kept_row")),
        F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__row") == F.col("__kept_row")), "left_semi",
    )
    number = F.row_number().over(Window.partitionBy("__id", "__row").orderBy(F.lit(1)))
    once = chosen.withColumn("__number", number).filter("__number = 1")
    return once.select(*documents.columns).unionByName(rows.filter(nothing).select(*documents.columns))
