"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language, so that texts that switch between languages are labelled word by word. A word's
features are its affixes of one to three letters, its letter pairs and triples, and the word lists it is in; learned
transitions tie neighbours together; marginals come from the forward-backward recursions. The language of a text is the
one with the largest mean marginal over its words.

Training uses a bounded sample of labelled rows: ``SAMPLE_TEXTS`` texts of each language (the smallest hashes of doc_id)
and of each ``SAMPLE_WORDS`` consecutive words, cut into sequences, of which a share joins pieces of several languages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warden.llm.common import chunks, id_and_text, record_batch, take_memory
from warden.llm.shingles import mix

SAMPLE_TEXTS = 250
SAMPLE_WORDS = 160
UNKNOWN = "und"
LENGTH = 40  # words in a training sequence
SWITCHED = 0.4  # share of training sequences with several languages
LEXICON = 200  # words in the list of a language
BUCKETS = 1 << 15
EPOCHS = 40
CACHE_WORDS = 250_000
_SEGMENT = 64
_U = np.uint64


def features(words: list[str], lexicons: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, word after word, and where each word's begin. A word without a letter has one, unused."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = codes == 2
    owner = np.cumsum(first) - 1
    ids, owners = [], []
    for n in (2, 3, 4):
        if len(codes) < n:
            continue
        total = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            total = total * _U(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
        inside = owner[: len(total)] == owner[n - 1 :]
        if n == 4:  # only the affixes of three letters
            inside &= first[: len(total)] | (codes[n - 1 :] == 3)
        ids.append((mix(total[inside]) >> _U(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(total)][inside])
    listed = [(BUCKETS + k, i) for i, w in enumerate(words) for k in lexicons.get(w, ())]
    ids.append(np.array([x for x, _ in listed], dtype=np.int64))
    owners.append(np.array([i for _, i in listed], dtype=np.int64))
    # Every word has "\x02x" at least, even an empty one, so that none is left out.
    flat, of = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return flat[order], np.searchsorted(of[order], np.arange(len(words)))


def _ratio(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=-1, keepdims=True)


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word of texts laid one after another, and the expected transition counts.

    Texts are cut into segments of ``_SEGMENT`` words. The product of a segment's steps carries the forward and backward
    vectors from segment to segment of a text; within, all segments of all texts step together. The result is that of
    the plain recursions over whole texts.
    """
    k = emissions.shape[1]
    if not k:
        return emissions, np.zeros((0, 0))
    step = np.exp(transitions - transitions.max())
    score = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    parts = -(-lengths // _SEGMENT)
    n = int(parts.sum())
    if not n:
        return emissions, np.zeros((k, k))
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(n) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(lengths) - lengths, parts) + number * _SEGMENT
    size = np.minimum(_SEGMENT, np.repeat(lengths, parts) - number * _SEGMENT)
    at = begin[None, :] + np.minimum(np.arange(_SEGMENT)[:, None], size - 1)
    e = score[at]  # step, segment, label
    live = np.arange(_SEGMENT)[:, None] < size
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(_SEGMENT):
        m = (product @ step) * e[t][:, None, :]
        m /= m.sum(axis=(1, 2), keepdims=True)
        product = np.where(live[t][:, None, None], m, product)
    # Vectors at segment borders; before the first word of a text all labels are alike.
    before, after = np.ones((n, k)) / k, np.ones((n, k)) / k
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(number.max() + 2))
    for j in range(1, int(number.max()) + 1):
        own = order[cuts[j] : cuts[j + 1]]
        before[own] = _ratio(np.einsum("na,nab->nb", before[own - 1], product[own - 1]))
    last = parts[text] - 1 == number
    for j in range(int(number.max()) - 1, -1, -1):
        own = order[cuts[j] : cuts[j + 1]]
        own = own[~last[own]]
        after[own] = _ratio(np.einsum("nab,nb->na", product[own + 1], after[own + 1]))
    forward = np.empty((_SEGMENT, n, k))
    a = before
    for t in range(_SEGMENT):
        x = _ratio((a @ step) * e[t])
        a = np.where(live[t][:, None], x, a)
        forward[t] = a
    counts, b = np.zeros((k, k)), after
    out = np.empty_like(forward)
    for t in range(_SEGMENT - 1, -1, -1):
        out[t] = forward[t] * b
        ahead = e[t] * b
        earlier = before if t == 0 else forward[t - 1]
        pair = earlier[:, :, None] * step[None] * ahead[:, None, :]
        use = live[t] & ((t > 0) | (number > 0))
        pair = pair[use]
        if len(pair):
            counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = np.where(live[t][:, None], _ratio(ahead @ step.T), b)
    result = np.empty_like(emissions)
    result[at[live]] = _ratio(out[live])
    return result, counts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature, label
    transitions: np.ndarray
    lexicons: dict[str, list[int]]
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "table": None}

    def forget(self) -> None:
        self.known, self.table = {}, None

    def _learn(self, words: list[str]) -> None:
        ids, starts = features(words, self.lexicons)
        rows = np.add.reduceat(self.weights[ids], starts, axis=0)
        plain = np.array([not any(map(str.isalpha, w)) for w in words])
        rows[plain] = 0
        rows = np.column_stack([rows, ~plain]).astype(np.float32)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.table = rows if self.table is None else np.concatenate([self.table, rows])

    def label(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the marginals of its words and which words have a letter."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        split = [t.lower().split() for t in texts]
        words = [w for s in split for w in s]
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        if not words:
            yield from ((np.zeros((0, len(self.labels))), np.zeros(0, bool)) for _ in texts)
            return
        found = list(map(self.known.get, words))
        if new := list({w for w, i in zip(words, found, strict=True) if i is None}):
            self._learn(new)
            found = [self.known[w] if i is None else i for w, i in zip(words, found, strict=True)]
        rows = self.table[np.array(found, dtype=np.int64)]
        shares, _ = marginals(rows[:, :-1].astype(float), lengths, self.transitions)
        ends = np.cumsum(lengths)
        for a, b in zip(ends - lengths, ends, strict=True):
            yield shares[a:b], rows[a:b, -1] > 0

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, np.ndarray]]:
        """Language, score and mean marginals of each text."""
        for shares, letters in self.label(texts):
            mean = shares[letters].mean(axis=0) if self.labels and letters.any() else np.zeros(len(self.labels))
            best = int(mean.argmax()) if mean.any() else None
            yield (UNKNOWN, 0.0, mean) if best is None else (self.labels[best], float(min(1.0, mean[best])), mean)


def fit(rows: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """A model from (language, words) of sample texts. No rows: no labels, and all texts are ``UNKNOWN``."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in rows})
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), {})
    texts: list[list[list[str]]] = [[] for _ in labels]
    for lang, words in sorted(rows):
        texts[labels.index(lang)].append(words)
    lexicons: dict[str, list[int]] = {}
    for i, own in enumerate(texts):
        words, counts = np.unique([w for t in own for w in t] or [""], return_counts=True)
        for j in np.lexsort((words, -counts))[:LEXICON]:
            lexicons.setdefault(str(words[j]), []).append(i)
    sequences: list[list[tuple[str, int]]] = []
    for i, own in enumerate(texts):
        for t in own:
            for a in range(0, len(t), LENGTH):
                piece = [(w, i) for w in t[a : a + LENGTH]]
                if k > 1 and rng.random() < SWITCHED:
                    other = int(rng.choice([x for x in range(k) if x != i]))
                    more = texts[other][int(rng.integers(len(texts[other])))]
                    cut, start = int(rng.integers(1, LENGTH)), int(rng.integers(max(1, len(more) - LENGTH)))
                    piece = piece[:cut] + [(w, other) for w in more[start : start + LENGTH - cut]] + (
                        piece[cut : cut + LENGTH // 4] if rng.random() < 0.5 else []
                    )
                sequences.append([x for x in piece if any(map(str.isalpha, x[0]))])
    sequences = [s for s in sequences if s]
    vocabulary = {w: j for j, w in enumerate(sorted({w for s in sequences for w, _ in s}))}
    weights, transitions = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    if not vocabulary:
        return Model(labels, weights, transitions, lexicons)
    ids, starts = features(list(vocabulary), lexicons)
    sizes = np.diff(np.append(starts, len(ids)))
    word = np.array([vocabulary[w] for s in sequences for w, _ in s])
    truth = np.array([i for s in sequences for _, i in s])
    lengths = np.array([len(s) for s in sequences])
    edge = np.ones(len(word), dtype=bool)
    edge[np.cumsum(lengths)[:-1]] = False
    edge[0] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[np.flatnonzero(edge) - 1], truth[edge]), 1)
    squares, squares_t = np.full_like(weights, 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        emission = np.add.reduceat(weights[ids], starts, axis=0)
        shares, counts = marginals(emission[word], lengths, transitions)
        shares[np.arange(len(word)), truth] -= 1
        by_word = np.column_stack([np.bincount(word, shares[:, c], len(vocabulary)) for c in range(k)])
        spread = np.repeat(by_word, sizes, axis=0)
        slope = np.column_stack([np.bincount(ids, spread[:, c], len(weights)) for c in range(k)]) / len(word) + 1e-6 * weights
        slope_t = (counts - seen) / len(word) + 1e-4 * transitions
        squares += slope**2
        squares_t += slope_t**2
        weights -= 0.3 * slope / np.sqrt(squares)
        transitions -= 0.3 * slope_t / np.sqrt(squares_t)
    return Model(labels, weights, transitions, lexicons)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the checksum of the id as text falls on the fold that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train(documents: DataFrame, fold: tuple[int, int] = (4, 2), texts: int = SAMPLE_TEXTS) -> Model:
    """Fits on at most ``texts`` texts of each language outside the held-out ``fold`` (modulus, remainder).

    Rows without a text, a language or a doc_id are not learned from.
    """
    rows = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text"),
        documents["lang"].cast("string").alias("lang"),
    ).filter("doc_id is not null and text is not null and lang is not null")
    rows = rows.filter(~held_out(F.col("doc_id"), *fold)).withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = rows.select("lang", "h", "doc_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= texts)
    # The few ids come back as literals: the texts of all other rows are neither moved nor read into memory.
    ids = [r.doc_id for r in chosen.select("doc_id").collect()]
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("words") - SAMPLE_WORDS)).cast("int") + 1
    sample = (
        rows.filter(F.col("doc_id").isin(ids)).withColumn("words", words)
        .select("lang", "doc_id", F.slice("words", start, F.lit(SAMPLE_WORDS)).alias("words"))
    )
    return fit([(r.lang, r.words) for r in sample.orderBy("doc_id", "lang").collect()])


_PREDICTED = pa.schema([
    ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("second", pa.float64()),
])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, second (score of the next best language) of every document.

    ``und`` with score 0 where the text is null, empty or without a letter, or where the model has no language. Rows
    with one doc_id, or none, are each labelled. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the features, not by the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        take_memory(own)
        for batch in chunks(batches, size=1 << 20):
            found = list(own.predict(batch.column("text").to_pylist()))
            second = [float(np.sort(m)[-2]) if len(m) > 1 else 0.0 for _, _, m in found]
            yield record_batch(
                _PREDICTED, doc_id=batch.column("doc_id"), lang_pred=[x for x, _, _ in found],
                score=[x for _, x, _ in found], second=second,
            )

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, lang_pred string, score double, second double")


def label_words(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, words, languages: every word of every text with its most likely language, null for one without a letter."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("languages", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        take_memory(own)
        for batch in chunks(batches, size=1 << 20):
            texts = batch.column("text").to_pylist()
            tags = [
                [own.labels[i] if ok and own.labels else None for i, ok in zip(m.argmax(axis=1) if own.labels else [0] * len(m), s, strict=True)]
                for m, s in own.label(texts)
            ]
            yield record_batch(schema, doc_id=batch.column("doc_id"), words=[t.split() for t in texts], languages=tags)

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, words array<string>, languages array<string>")


def predicted_languages(documents: DataFrame) -> DataFrame:
    """Predictions for all documents by a model that has not seen the held-out fold: adds held_out."""
    found = identify(documents, train(documents))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "second")
