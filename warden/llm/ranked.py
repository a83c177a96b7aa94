"""Ranked lexical search over a length-stratified index.

A document's score for a term depends on how often it holds the term (tf) and on its length alone, the length by way of
the normaliser ``m``, a small integer. Documents of equal m are a stratum. The index keeps, for each stratum, the
documents of a term grouped by tf, so an impact is computed once for each tf and added to a whole group of documents. A
stratum is kept in segments of bounded text; a segment is one row of arrays:

``m``, ``segment``, ``doc_ids``, ``terms``, ``df`` and ``top_tf`` of each term, ``groups`` (tf groups of each term), ``tf``,
``sizes`` (documents of each group), ``docs`` (places in doc_ids, group after group).

A search bounds each segment for each query by the impacts of its largest tf's. The segments with the highest bounds are
scored first; the k-th score found there is the bar that all others' bounds must reach to be scored. No score is
approximate and none is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warden.llm.common import chunks, id_and_text, shared_folder

#: Terms are runs of ASCII letters, digits and anything beyond ASCII; A-Z in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_SHARE = 75  # percent of the normaliser that the length makes up
SATURATION = 8
K = 10
SEGMENT_BYTES = 1 << 20  # text of a segment; a longer text is a segment of its own
SEGMENTS_PER_FILE = 32
BLOCK_TERMS = 50_000  # query terms that are searched for together, about

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20

INDEX = (
    "m bigint, segment bigint, doc_ids array<bigint>, terms array<string>, df array<int>, top_tf array<int>, "
    "groups array<int>, tf array<int>, sizes array<int>, docs array<int>"
)
_LISTS = {"doc_ids": pa.int64(), "terms": pa.string()}
_INDEX = pa.schema(
    [("m", pa.int64()), ("segment", pa.int64())]
    + [(n, pa.list_(_LISTS.get(n, pa.int32()))) for n in ("doc_ids", "terms", "df", "top_tf", "groups", "tf", "sizes", "docs")]
)


def impact(tf, m):
    """What a term that occurs ``tf`` times adds for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


# -- index -------------------------------------------------------------------------------------------------------------


def term_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, and for each term in turn its code and the text it is in."""
    texts = texts if isinstance(texts, pa.Array) else texts.combine_chunks()
    data = texts.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = _FOLD[np.frombuffer(data.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    folded = pa.LargeStringArray.from_buffers(len(data), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw))
    split = pc.ascii_split_whitespace(folded)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(words, "")
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), owner[full.to_numpy(zero_copy_only=False)]


def number_of_terms(texts: pa.Array) -> pa.Array:
    """Terms of each text, with repeats; a library call over a batch of texts, several times as fast as the JVM's patterns."""
    return pc.count_substring_regex(texts, TERM).cast(pa.int64())


def segment_row(m: int, segment: int, doc_ids: list, texts: pa.Array) -> pa.RecordBatch:
    """The index row of one segment."""
    terms, codes, owner = term_codes(texts)
    pair, tf = np.unique(codes.astype(np.int64) * len(doc_ids) + owner, return_counts=True)
    code, doc = pair // len(doc_ids), pair % len(doc_ids)
    order = np.lexsort((doc, -tf, code))
    code, doc, tf = code[order], doc[order], tf[order]
    new_term = np.diff(code, prepend=-1) != 0
    new_group = new_term | (np.diff(tf, prepend=0) != 0)
    at_term, at_group = np.flatnonzero(new_term), np.flatnonzero(new_group)
    of_term = np.cumsum(new_term)[at_group]  # the term of each group, from 1
    columns = {
        "doc_ids": doc_ids, "terms": terms.cast(pa.string()), "df": np.diff(at_term, append=len(code)), "top_tf": tf[at_term],
        "groups": np.bincount(of_term, minlength=len(at_term) + 1)[1:], "tf": tf[at_group],
        "sizes": np.diff(at_group, append=len(code)), "docs": doc,
    }
    arrays = {"m": pa.array([m]), "segment": pa.array([segment])}
    for name, values in columns.items():
        flat = values if isinstance(values, pa.Array) else pa.array(values, _LISTS.get(name, pa.int32()))
        arrays[name] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
    return pa.RecordBatch.from_arrays([arrays[f.name] for f in _INDEX], schema=_INDEX)


def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, doc_id, text), sorted by m, to index rows; a segment ends with its m or after SEGMENT_BYTES."""
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    held, size, at = [], 0, None

    def close():
        nonlocal held, size, made
        ids = [i for part in held for i in part.column("doc_id").to_pylist()]
        texts = pa.concat_arrays([part.column("text").cast(pa.large_string()) for part in held])
        row = segment_row(at, (task << 32) + made, ids, texts)
        held, size, made = [], 0, made + 1
        return row

    for batch in chunks(batches, size=SEGMENT_BYTES):
        ms = batch.column("m").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ms)) + 1).tolist(), len(ms)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (ms[a] != at or size >= SEGMENT_BYTES):
                yield close()
            part = batch.slice(a, b - a)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py()
            at = int(ms[a])
    if held:
        yield close()


@dataclass(frozen=True)
class Index:
    """An index as written: its folder and the two counts that scores are made of."""

    path: str
    documents: int  # with a term
    terms: int  # with repeats

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(self.path)


def build(documents: DataFrame, path: str | None = None) -> Index:
    """Indexes all documents with a term. Null text has none; rows that share a doc_id are documents of their own.

    Texts are dealt out once, by m; adaptive execution sizes the tasks by their bytes and splits a stratum that is larger
    (it may hold any share of all rows). Each task writes segments of what it gets.
    """
    spark = documents.sparkSession
    docs = id_and_text(documents).withColumn("n", F.arrow_udf(number_of_terms, "bigint")("text")).filter("n > 0")
    total = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    index = Index(path or f"{shared_folder(spark)}/index", total.documents, total.terms)
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {index.documents}L) div {max(index.terms, 1)}L")
    dealt = docs.select(m.alias("m"), "doc_id", "text").hint("rebalance", "m").sortWithinPartitions("m", "doc_id")
    rows = dealt.mapInArrow(segments, INDEX)
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", SEGMENTS_PER_FILE).parquet(index.path)
    return index


# -- search ------------------------------------------------------------------------------------------------------------


@dataclass
class Queries:
    """Queries that are searched for together: distinct terms with weights, and for each query its terms and their repeats."""

    terms: pa.Array
    weights: np.ndarray
    starts: np.ndarray  # of each query in ``term`` and ``times``
    term: np.ndarray
    times: np.ndarray

    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.term))

    def found(self, terms: pa.Array) -> np.ndarray:
        """For each query term its place in ``terms``, or -1."""
        at = np.full(len(self.terms), -1, np.int64)
        hit = pc.index_in(terms, value_set=self.terms)
        places = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
        at[hit.drop_null().to_numpy()] = places
        return at

    def bounds(self, m: int, at: np.ndarray, top_tf: np.ndarray) -> np.ndarray:
        """What no document of the segment can exceed, for each query."""
        most = np.zeros(len(self.terms), np.int64)
        here = at >= 0
        most[here] = self.weights[here] * impact(top_tf[at[here]].astype(np.int64), m)
        return np.add.reduceat(self.times * most[self.term], self.starts)


class Segment:
    """One index row, ready to score."""

    def __init__(self, row: pa.RecordBatch, queries: Queries):
        get = {f.name: row.column(f.name) for f in row.schema}
        self.m, self.queries, self.ids = get["m"][0].as_py(), queries, get["doc_ids"][0].values
        self.at = queries.found(get["terms"][0].values)
        numbers = {n: get[n][0].values.to_numpy() for n in ("top_tf", "groups", "tf", "sizes", "docs")}
        self.bound = queries.bounds(self.m, self.at, numbers["top_tf"])
        self.groups = np.concatenate([[0], np.cumsum(numbers["groups"], dtype=np.int64)])
        self.places = np.concatenate([[0], np.cumsum(numbers["sizes"], dtype=np.int64)])
        self.impacts = impact(numbers["tf"].astype(np.int64), self.m)  # once for each tf group
        self.sizes, self.docs, self.known = numbers["sizes"], numbers["docs"], {}

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of query term ``t`` here and what it adds to each."""
        if t not in self.known:
            a, b = self.groups[self.at[t]], self.groups[self.at[t] + 1]
            gain = np.repeat(self.queries.weights[t] * self.impacts[a:b], self.sizes[a:b])
            self.known[t] = self.docs[self.places[a] : self.places[b]], gain
        return self.known[t]

    def best(self, q: int, k: int, bar: int) -> list[tuple[int, int | None]]:
        """Up to k (score, doc_id) of query ``q``, highest first, ties by doc_id; scores above 0, none below ``bar``."""
        scores = np.zeros(len(self.ids), np.int64)
        for i in range(self.queries.starts[q], self.queries.ends()[q]):
            if self.at[self.queries.term[i]] >= 0:
                docs, gain = self.term(self.queries.term[i])
                scores[docs] += self.queries.times[i] * gain
        fit = np.flatnonzero(scores >= max(bar, 1))
        if len(fit) > k:  # those below the k-th score go; its ties stay
            fit = fit[scores[fit] >= np.partition(scores[fit], len(fit) - k)[len(fit) - k]]
        rows = [(int(scores[d]), self.ids[int(d)].as_py()) for d in fit]
        return heapq.nsmallest(k, rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _term_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of the terms is."""
    wanted = pa.array(terms, pa.string())

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for row in _each(batches):
            hit = pc.index_in(row.column("terms")[0].values, value_set=wanted)
            here = hit.is_valid().to_numpy(zero_copy_only=False)
            total[hit.drop_null().to_numpy()] += row.column("df")[0].values.to_numpy()[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = index.select("terms", "df").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {terms[r["term"]]: r["df"] for r in found.collect()}  # at most as many rows as terms were given


def _first_visits(index: DataFrame, queries, k: int) -> DataFrame:
    """For each query the segments with the highest bounds that hold k documents together."""

    def run(batches):
        own = queries.value
        top = [[] for _ in own.starts]  # the k segments with the highest bounds in this task; fewer would do
        for row in _each(batches):
            m, segment = row.column("m")[0].as_py(), row.column("segment")[0].as_py()
            at = own.found(row.column("terms")[0].values)
            bound = own.bounds(m, at, row.column("top_tf")[0].values.to_numpy())
            size = len(row.column("doc_ids")[0])
            for q in np.flatnonzero(bound).tolist():
                push = heapq.heappush if len(top[q]) < k else heapq.heappushpop
                push(top[q], (int(bound[q]), -segment, size))
        flat = [(q, -s, b, size) for q, mine in enumerate(top) for b, s, size in mine]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["query", "segment", "bound", "size"]
            )

    found = index.select("m", "segment", "doc_ids", "terms", "top_tf").mapInArrow(
        run, "query bigint, segment bigint, bound bigint, size bigint"
    )
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "segment")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).filter(F.col("before") < k).select("query", "segment")


def _scored(index: DataFrame, queries, k: int, visits: dict[int, list[int]] | None, bars: np.ndarray, done: set) -> DataFrame:
    """Each task's k best documents of each query.

    With ``visits``, the queries named there for each segment are scored; else those whose bound reaches the bar, which
    rises with what the task finds, but for the pairs in ``done``.
    """
    schema = "query bigint, doc_id bigint, score bigint"

    def run(batches):
        own, bar = queries.value, bars.copy()
        kept = [[] for _ in own.starts]
        for row in _each(batches):
            number = row.column("segment")[0].as_py()
            if visits is not None and number not in visits:
                continue
            segment = Segment(row, own)
            chosen = visits[number] if visits is not None else np.flatnonzero((segment.bound >= bar) & (segment.bound > 0)).tolist()
            for q in chosen:
                if (q, number) in done:
                    continue
                merged = kept[q] + segment.best(q, k, int(bar[q]))
                kept[q] = heapq.nsmallest(k, merged, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
                if len(kept[q]) == k:
                    bar[q] = max(bar[q], kept[q][-1][0])
        flat = [(q, d, s) for q, mine in enumerate(kept) for s, d in mine]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["query", "doc_id", "score"]
            )

    return index.mapInArrow(run, schema)


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def _search_block(index: Index, spark: SparkSession, block: list, k: int) -> DataFrame:
    """Best documents of the queries in ``block``: rows (item_id, term, times)."""
    rows = index.rows(spark)
    items = sorted({r.item_id for r in block}, key=lambda i: (i is None, i or 0))
    counts = _term_counts(rows, sorted({r.term for r in block}))
    number = {item: i for i, item in enumerate(items)}
    known = sorted((number[r.item_id], r.term, r.times) for r in block if r.term in counts)
    terms = sorted({t for _, t, _ in known})
    code = {t: i for i, t in enumerate(terms)}
    items = [items[q] for q in sorted({q for q, _, _ in known})]  # those with a term that some document holds
    queries = np.array([q for q, _, _ in known], np.int64)
    if not items:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    weights = [int(np.floor(1000 * np.log((2 * index.documents + 2) / (2 * counts[t] + 1)))) for t in terms]
    sent = spark.sparkContext.broadcast(Queries(
        pa.array(terms, pa.string()), np.array(weights, np.int64), np.flatnonzero(np.diff(queries, prepend=-1)),
        np.array([code[t] for _, t, _ in known], np.int64), np.array([n for _, _, n in known], np.int64),
    ))
    visits: dict[int, list[int]] = {}
    for r in _first_visits(rows, sent, k).collect():  # at most k for each query of the block
        visits.setdefault(r.segment, []).append(r["query"])
    bars = np.zeros(len(items), np.int64)
    first = _scored(rows.filter(F.col("segment").isin(list(visits))), sent, k, visits, bars, set())
    first = _top(first, k).select("query", "doc_id", "score").collect()  # at most k for each query of the block
    scores: dict[int, list[int]] = {}
    for r in first:
        scores.setdefault(r["query"], []).append(r.score)
    for q, mine in scores.items():
        bars[q] = min(mine) if len(mine) == k else 0
    done = {(q, s) for s, qs in visits.items() for q in qs}
    rest = _scored(rows, sent, k, None, bars, done)
    found = _top(rest.unionByName(spark.createDataFrame(first, rest.schema)), k)
    names = spark.createDataFrame(list(enumerate(items)), "query bigint, item_id bigint")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score; equal scores by doc_id, null last.

    Rows of ``items`` that share an item_id are one item with the terms of all; null text has no term, a null item_id is
    an item like others. Items are searched for in blocks of about ``BLOCK_TERMS`` terms, which bound what is sent to
    tasks and comes back: k segments and k documents for each query. An item is never split, so a longer one makes a
    longer block.
    """
    spark = items.sparkSession
    lowered = F.translate(F.coalesce(items["text"].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(items["item_id"].cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    pairs = each.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    path = f"{shared_folder(spark)}/queries"
    pairs.write.parquet(path)
    pairs = spark.read.parquet(path)
    blocks = pairs.count() // BLOCK_TERMS + 1
    answers = []
    for b in range(blocks):
        block = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if block:
            out = f"{path}-answers/{b}"
            _search_block(index, spark, block, k).write.parquet(out)
            answers.append(out)
    if not answers:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return spark.read.schema("item_id bigint, rank int, doc_id bigint, score bigint").parquet(*answers)


def search_texts(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``search`` for all items over a new index of all documents."""
    return search(build(documents), items, k)
