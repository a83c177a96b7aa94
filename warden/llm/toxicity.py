"""Toxicity by a subsequence-string-kernel support vector machine with Nyström landmarks.

Words are compared by the subsequences of three characters they share, weighted by ``DECAY`` to the length that each
spans (up to ``SPAN``), so that ``i-d.iot`` and ``idiioot`` stay near ``idiot``. The kernel to a set of landmark words
gives each word its Nyström features, a linear machine with squared hinge loss separates insults from other words, and a
text scores as its worst word, mapped to 0..1 by a logistic curve.

Labels mark texts, not words. Training starts from words that occur in more toxic texts, and in no clean one, than chance
allows, and from words that explain the toxic texts left over; it learns, takes the worst word of each toxic text and the
worst words of clean texts as further examples, and learns again.

The decision is linear in the kernel, so it is a weight for each subsequence: a word is scored by summing weights, at a
cost that does not grow with the landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warden.llm.common import chunks, id_and_text, record_batch, take_memory
from warden.llm.language_id import held_out

SAMPLE_TOXIC = 500  # labelled texts that are learned from, at most
SAMPLE_CLEAN = 2500
SAMPLE_WORDS = 60_000  # distinct words of clean texts, the most frequent ones, at most
LANDMARKS = 128
DECAY = 0.6
SPAN = 7  # characters between the first and the last of a subsequence, at most
LETTERS = 47  # characters with a number of their own
WINDOW = 24  # longer words are scored in overlapping windows
SHORTEST = 3  # a shorter word has no subsequence of three characters of its own
NO_WORD = -2.0  # decision for what has no word to score
THRESHOLD = 0.7
CACHE_WORDS = 300_000
_BASE = LETTERS + 1
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_PAIRS = [(j, k) for k in range(2, SPAN + 1) for j in range(1, k)]


def candidates(word: str) -> list[str]:
    """What is scored of a word: its inside in lower case, without marks around; windows of a long one."""
    word = word.strip("\"'`.,;:!?()[]{}<>*#$%&+-_=/\\|~^@")
    if len(word) <= WINDOW:
        return [word]
    return [word[a : a + WINDOW] for a in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def text_words(text: str) -> list[str]:
    """The words of a text in lower case, and runs of single characters joined."""
    text = text.lower()
    return text.split() + ["".join(m.group().split()) for m in _SPACED.finditer(text)]


@dataclass
class Subsequences:
    """Numbers for characters; 0 for all that have none, which take part as gaps alone."""

    letters: dict[str, int]

    def occurrences(self, words: list[str]) -> Iterator[tuple[np.ndarray, float]]:
        """For each pair of distances: the subsequence number at each place of each word (0: none), and its weight."""
        width = max(map(len, words), default=0) + 1
        codes = np.zeros((len(words), width + SPAN), dtype=np.int32)
        for i, w in enumerate(words):
            codes[i, 0] = LETTERS  # a word's beginning is a character too
            codes[i, 1 : len(w) + 1] = [self.letters.get(c, 0) for c in w]
        for j, k in _PAIRS:
            a, b, c = codes[:, :width], codes[:, j : j + width], codes[:, k : k + width]
            yield np.where((a > 0) & (b > 0) & (c > 0), (a * _BASE + b) * _BASE + c, 0), DECAY ** (k + 1)

    def score(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Sum over a word's subsequences of their weights, by the word's norm. ``weights`` may have several columns."""
        total = np.zeros((len(words), *weights.shape[1:]))
        norm = np.full(len(words), 1e-12)
        for numbers, weight in self.occurrences(words):
            total += weight * weights[numbers].sum(axis=1)
            norm += weight**2 * (numbers > 0).sum(axis=1)
        return total / np.sqrt(norm).reshape(-1, *[1] * (weights.ndim - 1))

    def vectors(self, words: list[str]) -> np.ndarray:
        """A column of subsequence weights for each word, whose products with others' are the kernel."""
        out = np.zeros((_BASE**3, len(words)), dtype=np.float32)
        norm = np.full(len(words), 1e-12)
        for numbers, weight in self.occurrences(words):
            i, at = np.nonzero(numbers)
            np.add.at(out, (numbers[i, at], i), weight)
            norm += weight**2 * (numbers > 0).sum(axis=1)
        out /= np.sqrt(norm)
        return out


@dataclass
class Model:
    subsequences: Subsequences
    weights: np.ndarray | None  # by subsequence; none if nothing was learned
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def forget(self) -> None:
        self.known.clear()

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each word: above 0 for insults."""
        out = np.empty(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(words), 2000):
            own = order[a : a + 2000]
            out[own] = self.subsequences.score([words[i] for i in own], self.weights) + self.bias
        out[[len(w) < SHORTEST for w in words]] = NO_WORD
        return out

    def worst(self, texts: list[str]) -> list[float]:
        """The largest decision over the words of each text, ``NO_WORD`` for none."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [text_words(t) for t in texts]
        known = self.known
        found = [list(map(known.get, s)) for s in split]
        new = list({w for s, f in zip(split, found, strict=True) for w, x in zip(s, f, strict=True) if x is None})
        if new:
            parts = [candidates(w) for w in new]
            flat = list({c for p in parts for c in p})
            value = dict(zip(flat, self.decide(flat).tolist(), strict=True))
            known.update((w, max(value[c] for c in p)) for w, p in zip(new, parts, strict=True))
        return [
            max((known[w] if x is None else x for w, x in zip(s, f, strict=True)), default=NO_WORD)
            for s, f in zip(split, found, strict=True)
        ]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = self.slope * np.array(self.worst(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _separate(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 5000.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps.

    Both classes weigh the same; within a class examples weigh as ``share``.
    """
    x = np.column_stack([x, np.ones(len(x))])
    balance = cost * share / np.where(y > 0, share[y > 0].sum(), share[y < 0].sum())
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], balance[inside]
        after = np.linalg.solve(ridge + (xi * ci[:, None]).T @ xi, (xi * ci[:, None]).T @ y[inside])
        if np.allclose(after, w, atol=1e-7):
            break
        w = after
    return w


def _spread(sub: Subsequences, words: list[str], n: int) -> list[str]:
    """At most ``n`` of the words that together come nearest to all others (pivoted Cholesky steps on the kernel)."""
    if len(words) <= n:
        return list(words)
    rest = np.empty(len(words))
    for a in range(0, len(words), 64):
        part = words[a : a + 64]
        rest[a : a + 64] = np.diagonal(sub.score(part, sub.vectors(part)))
    chosen, rows = [], np.zeros((n, len(words)))
    for step in range(n):
        i = int(rest.argmax())
        if rest[i] < 1e-6:
            break
        chosen.append(words[i])
        row = sub.score(words, sub.vectors([words[i]]))[:, 0] - rows[:step, i] @ rows[:step]
        rows[step] = row / np.sqrt(rest[i])
        rest = np.maximum(rest - rows[step] ** 2, 0)
        rest[i] = 0
    return chosen


def _variants(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a character inserted, and with one doubled."""
    out = []
    for w in words:
        if len(w) < 4:
            continue
        i, mark = int(rng.integers(1, len(w))), ".-*_x"[int(rng.integers(5))]
        out += [w[:i] + mark + w[i:], w[:i] + w[i - 1] + w[i:]]
    return out


def _apart(toxic: dict[int, list[str]]) -> dict[int, set[str]]:
    """The texts without near copies of one another, which would make their other words look like insults."""
    kept: dict[int, set[str]] = {}
    for d, ws in toxic.items():
        own = set(ws)
        if all(2 * len(own & x) < min(len(own), len(x)) or min(len(own), len(x)) < 8 for x in kept.values()):
            kept[d] = own
    return kept


def _explaining(toxic: dict[int, set[str]], unseen: set[str], by_texts: dict[int, int], share: float) -> list[str]:
    """Words of toxic texts alone that chance does not put there, then words that explain the most texts left over.

    Of the words that ``n`` texts have, chance puts ``share ** n`` in toxic texts alone.
    """
    holders: dict[str, set[int]] = {}
    for d, ws in toxic.items():
        for w in ws - unseen:
            holders.setdefault(w, set()).add(d)
    least = next((n for n in range(3, 40) if share**n * sum(c for k, c in by_texts.items() if k >= n) < 1), 40)
    found = sorted(w for w, d in holders.items() if len(d) >= least)
    open_texts = set(toxic).difference(*(holders[w] for w in found))
    while open_texts:
        holders = {w: own for w, d in holders.items() if (own := d & open_texts)}
        word = max(holders, key=lambda w: (len(holders[w]), w), default=None)
        if word is None or len(holders[word]) < (2 if found else 1):
            break
        found.append(word)
        open_texts -= holders[word]
    return found


def fit(
    toxic: dict[int, list[str]], clean: dict[str, int], by_texts: dict[int, int] | None = None, share: float = 0.2, seed: int = 3
) -> Model:
    """A model from the words of toxic texts (those in no clean text) and words of clean texts with how many have them.

    ``by_texts`` has for each number of texts how many words are in so many, ``share`` is that of toxic texts.
    """
    rng = np.random.default_rng(seed)
    texts_with, clean = clean, sorted(w for w in clean if len(w) >= SHORTEST)
    toxic = {d: w for d, ws in toxic.items() if (w := sorted({x for x in ws if len(x) > 2}))}
    counts: dict[str, int] = {}
    for c in "".join([*clean, *(w for ws in toxic.values() for w in ws)]):
        counts[c] = counts.get(c, 0) + 1
    letters = sorted((c for c in counts if c.isalpha()), key=lambda c: (-counts[c], c))[: LETTERS - 1]
    sub = Subsequences({c: i + 1 for i, c in enumerate(letters)})
    if not toxic or not clean:
        return Model(sub, None)
    unseen = set(texts_with)
    positives = _explaining(_apart(toxic), unseen, by_texts or {}, share)
    negatives = [clean[i] for i in rng.choice(len(clean), min(len(clean), 3000), replace=False)]
    model = Model(sub, None)
    for _ in range(4):
        marks = _spread(sub, sorted(set(positives)), LANDMARKS // 2)
        pool = [negatives[i] for i in rng.choice(len(negatives), min(len(negatives), 1000), replace=False)]
        marks += _spread(sub, pool, LANDMARKS - len(marks))
        vectors = sub.vectors(marks)
        values, axes = np.linalg.eigh(sub.score(marks, vectors))
        keep = values > 1e-6 * values.max()
        root = axes[:, keep] / np.sqrt(values[keep])  # Nyström features are the kernel to the landmarks times this
        own = sorted(set(positives))
        words = own + _variants(own, rng) + negatives
        y = np.array([1.0] * (len(words) - len(negatives)) + [-1.0] * len(negatives))
        kernel = np.concatenate([sub.score(words[a : a + 500], vectors) for a in range(0, len(words), 500)])
        weigh = [1.0] * (len(words) - len(negatives)) + [np.sqrt(texts_with[w]) for w in negatives]
        w = _separate(kernel @ root, y, np.array(weigh))
        model = Model(sub, (vectors @ (root @ w[:-1])).astype(np.float32), float(w[-1]))
        model.weights[0] = 0
        decided = model.decide(clean)
        hard = np.argsort(-decided, kind="stable")[:1500]
        negatives = sorted({*negatives, *(clean[i] for i in hard if decided[i] > -0.9)})
        for ws in toxic.values():
            fresh = [w for w in ws if w not in unseen]
            if fresh:
                values = model.decide(fresh)
                if values.max() > 0:
                    positives.append(fresh[int(values.argmax())])
    worst_toxic = np.array([max(model.decide(ws)) for ws in toxic.values()])
    decided = model.decide(clean)
    last = np.argsort(decided, kind="stable")[-max(20, len(worst_toxic)) :]
    worst_clean = decided[last]
    x = np.concatenate([worst_toxic, worst_clean])
    weigh = np.array([1.0] * len(worst_toxic) + [np.sqrt(texts_with[clean[i]]) for i in last])
    t = np.array([1 - 1 / (len(worst_toxic) + 2)] * len(worst_toxic) + [1 / (len(worst_clean) + 2)] * len(worst_clean))
    a, b = 1.0, 0.0
    for _ in range(100):  # logistic curve by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        v = weigh * (p * (1 - p) + 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(weigh * (p - t) * x).sum(), (weigh * (p - t)).sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    model.slope, model.shift = float(a), float(b)
    return model


def train(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1)) -> Model:
    """Fits on at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean labelled texts outside the held-out ``fold``.

    The sample is of the smallest hashes of doc_id. A doc_id with both labels counts as toxic; rows without a doc_id or
    a label are not learned from; equal texts count once.
    """
    marks = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"), *fold))
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    docs = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text")
    ).filter("text is not null")
    chosen: dict[int, bool] = {}
    for toxic, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN)):
        rows = marks.filter(F.col("toxic") == toxic).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        chosen |= {r.doc_id: toxic for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    toxic_ids = [d for d, t in chosen.items() if t]
    schema = pa.schema([("doc_id", pa.int64()), ("word", pa.string())])

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            pairs = [
                (d, w) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for w in sorted({c for w in text_words(t) for c in candidates(w) if c})
            ]
            yield record_batch(schema, doc_id=[d for d, _ in pairs], word=[w for _, w in pairs])

    sample = docs.filter(F.col("doc_id").isin(list(chosen))).groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("doc_id"))
    found = sample.select("doc_id", "text").mapInArrow(words, "doc_id bigint, word string")
    found = found.groupBy("word").agg(
        F.collect_set(F.when(F.col("doc_id").isin(toxic_ids), F.col("doc_id"))).alias("toxic"),
        F.sum((~F.col("doc_id").isin(toxic_ids)).cast("int")).alias("clean"),
    )
    found = found.persist()
    by_texts = {r.n: r["count"] for r in found.groupBy((F.size("toxic") + F.col("clean")).alias("n")).count().collect()}
    clean = {r.word: r.clean for r in found.filter("clean > 0").orderBy(F.desc("clean"), F.xxhash64("word"), "word").limit(SAMPLE_WORDS).select("word", "clean").collect()}
    toxic: dict[int, list[str]] = {}
    for r in found.filter("clean = 0").select(F.explode("toxic").alias("d"), "word").collect():
        toxic.setdefault(r.d, []).append(r.word)
    found.unpersist()
    return fit(dict(sorted(toxic.items())), clean, by_texts, len(toxic_ids) / max(1, len(chosen)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every document.

    The score of a text is that of its worst word; null and empty texts get the low score of no word. Without learned
    labels all score 0. Rows with one doc_id, or none, are each scored. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a weight for each subsequence, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        take_memory(own)
        for batch in chunks(batches):
            yield record_batch(_SCORED, doc_id=batch.column("doc_id"), score=own.score(batch.column("text").to_pylist()))

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that has not seen the held-out fold: doc_id, held_out, score, predicted."""
    found = score(documents, train(documents, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
