"""Nearest vectors by cosine: a block matrix join with 8-bit product tiles, bounds on their error, and exact recomputation.

Unit vectors are rounded to 8-bit integers with a scale for each vector, and the length of what rounding took away is
kept. A tile of integer products then gives every cosine with a bound on its error, from the Cauchy-Schwarz inequality:
``|u.v - u'.v'| <= |u| |v - v'| + |u - u'| |v'|``. Pairs whose upper bound falls below the ``k`` best lower bounds of
their query are out; the rest are computed again in double precision from the original vectors and merged by heaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 5
QUERY_STEP = 50
QUERY_BLOCK = 8192  # queries in a block
ROW_BLOCK = 32_768  # candidates in a block, at most
TILE = 256, 4096  # queries and candidates of a product tile
_EXACT = 1 << 24  # float32 holds whole numbers below this exactly


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers of unit vectors, their scales, the lengths of the rounding errors and of the rounded vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = whole * scale[:, None]
    # A little more than the error, for the rounding of this computation itself.
    lost = np.linalg.norm(unit - rounded, axis=1) + 1e-12
    return whole, scale, lost, np.linalg.norm(rounded, axis=1) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 8-bit vectors as whole numbers, by floating-point units where these are exact."""
    step = _EXACT // (127 * 127)
    total = np.zeros((len(a), len(b)))
    for c in range(0, a.shape[1], step):
        total += a[:, c : c + step].astype(np.float32) @ b[:, c : c + step].astype(np.float32).T
    return total


def scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Product of each row of x with the same row of y, summed from the first component to the last."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * y[:, c]
    return total


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        xx, yy = dots(x, x), dots(y, y)
        plain = dots(x, y) / (np.sqrt(xx) * np.sqrt(yy))
    odd = ~np.isfinite(plain) | ~np.isfinite(xx) | ~np.isfinite(yy) | (np.minimum(xx, yy) < 1e-280)
    if odd.any():  # squares out of range
        plain[odd] = (scaled(x[odd]) * scaled(y[odd])).sum(axis=1)
    return plain


def few_of_each(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each distinct vector: no more copies can be among the nearest."""
    bits = np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.shape[1] * rows.itemsize)))[:, 0]
    _, group = np.unique(bits, return_inverse=True)
    order = np.lexsort((ids, group))
    group = group[order]
    number = np.arange(len(group)) - np.searchsorted(group, group)
    return np.sort(order[number < most])


def nearest_in_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> list[tuple[int, int, float]]:
    """(query, row, cosine) of the ``k`` nearest rows of each query; the query's own id is no candidate."""
    own = few_of_each(ids, rows, k + 1)
    ids, rows = ids[own], rows[own]
    qi, qs, ql, qn = quantise(scaled(queries))
    ri, rs, rl, rn = quantise(scaled(rows))
    found: list[tuple[int, int, float]] = []
    for a in range(0, len(queries), TILE[0]):
        q = slice(a, a + TILE[0])
        lows = np.full((len(query_ids[q]), k), -np.inf)
        tops: list[list[tuple[float, int]]] = [[] for _ in query_ids[q]]
        for b in range(0, len(rows), TILE[1]):
            r = slice(b, b + TILE[1])
            near = products(qi[q], ri[r]) * qs[q][:, None] * rs[r][None, :]
            slack = rl[r][None, :] + ql[q][:, None] * rn[r][None, :] + 1e-9
            near[query_ids[q][:, None] == ids[r][None, :]] = -np.inf
            low = near - slack
            lows = np.sort(np.concatenate([lows, low if low.shape[1] <= k else np.partition(low, -k, axis=1)[:, -k:]], axis=1), axis=1)[:, -k:]
            i, j = np.nonzero((near + slack >= lows[:, :1]) & np.isfinite(near))
            for c in range(0, len(i), 20_000):
                part = slice(c, c + 20_000)
                values = cosines(queries[q][i[part]], rows[r][j[part]])
                for at, row, value in zip(i[part].tolist(), ids[r][j[part]].tolist(), values.tolist(), strict=True):
                    entry = (value, -row)
                    if len(tops[at]) < k:
                        heapq.heappush(tops[at], entry)
                    elif entry > tops[at][0]:
                        heapq.heapreplace(tops[at], entry)
        for query, top in zip(query_ids[q].tolist(), tops, strict=True):
            found += [(query, -row, value) for value, row in top]
    return found


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _block(k: int):
    def run(block: pa.Table) -> pa.Table:
        ids = block.column("vec_id").to_numpy()
        vectors = block.column("vector").combine_chunks()
        rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        query = block.column("query").to_numpy(zero_copy_only=False)
        if not query.any() or query.all():
            return _FOUND.empty_table()
        found = nearest_in_block(ids[query], rows[query], ids[~query], rows[~query], k)
        return pa.Table.from_arrays(
            [pa.array([f[c] for f in found], t.type) for c, t in enumerate(_FOUND)], schema=_FOUND
        )

    return run


def nearest(
    table: DataFrame, queries: Column, k: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` (a condition on vec_id) selects, its ``k`` nearest.

    Scores descend, ties go to the smaller vec_id. Vectors that are null, zero or hold null or non-finite components take
    no part, nor do rows without an id; vectors of different lengths are not compared. If rows repeat an id, the largest
    of their vectors stands for it. A query without a candidate has no row.

    Queries and candidates are dealt out to blocks by their ids' hash; each pair of blocks meets in one task of bounded
    size, which keeps ``k`` rows a query. These are merged by query.
    """
    spark = table.sparkSession
    vectors = table.select(
        table[id_column].cast("bigint").alias("vec_id"), table[vector_column].cast("array<double>").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    vectors = vectors.groupBy("vec_id").agg(F.max("vector").alias("vector")).withColumn("dims", F.size("vector"))
    rows, asked = vectors.agg(F.count("*"), F.count_if(queries)).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, -(-rows // ROW_BLOCK), min(parts, -(-rows // 2048)))
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    place = F.xxhash64("vec_id", F.lit(1))
    rows_at = vectors.select(
        "dims", F.pmod(place, F.lit(row_blocks)).alias("r"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("q"), "vec_id", "vector",
        F.lit(False).alias("query"),
    )
    queries_at = vectors.filter(queries).select(
        "dims", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))).alias("r"),
        F.pmod(place, F.lit(query_blocks)).alias("q"), "vec_id", "vector", F.lit(True).alias("query"),
    )
    blocks = rows_at.unionByName(queries_at).groupBy("dims", "r", "q")
    best = blocks.applyInArrow(_block(k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
