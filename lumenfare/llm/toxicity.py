"""Toxicity: logistic regression on words and word beginnings, regularised by counterfactual swaps of identity terms.

Fitting: a bounded sample of labelled rows (`sample_rows`, those of the smallest hash) is drawn; a first scan counts in
how many of its toxic and clean documents each feature occurs, pre-aggregated in each task; features whose log odds
differ clearly (at most `most_features`, the clearest) make the vocabulary. A second scan turns each sampled document into its
vocabulary features, and the same document with its identity terms swapped within their groups into a counterfactual, of
which only the features that come and go are kept. Every document that mentions no group is also learnt, under its own
label, with a mention of one put behind it (`MENTION`; which one is a matter of its hash), and with the mention swapped: so
every corpus has pairs, both labels mention every group alike, and the identity terms' own features are always in the
vocabulary. A mention stands apart from the text, so its features are added to the text's without reading the text again.
The loss is the log loss plus `fairness` times the squared difference between the scores of each pair, so that weight
cannot rest on which group a sentence mentions. `group_gap` reports what is left of it. The driver holds numbers of
features as arrays: four bytes for each feature of a sampled document, at most `most_features` and the terms' own for one.
Scoring is one scan without a shuffle, over whole texts.

Features are 64-bit hashes of words (case folded, marks removed) and of their first 4 to 8 bytes; a feature counts once
in a document. Defined cases: null and empty texts have no features and get the intercept's score. Rows with a null label
or doc_id are never learnt from; repeated labels of a doc_id count as their maximum, and repeated documents of one doc_id
are learnt one by one. If the sample has labels of one kind
only, every score is that kind's smoothed rate. Ties of the sample's hash are broken by doc_id. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, plain_words, slices, utf8

#: Identity terms: a swap exchanges a term for the next one of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives"), ("transgender", "cisgender"), ("disabled", "able-bodied"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: A neutral sentence that mentions a group.
MENTION = " {}."
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    intercept: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct features of a slice of texts, ordered by row."""
    data, offsets = utf8(texts)
    return _features(data, offsets)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    spans, start, end, first = plain_words(data, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield row, spans.hash(start, end)
    for k in PREFIXES:
        # A word's beginning differs from the word of the same bytes.
        long = end - start > k
        yield row[long], ~spans.hash(start[long], start[long] + k)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, h = (np.concatenate(x) for x in zip(*_hashes(data, offsets)))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def swapper(groups: tuple[tuple[str, ...], ...] = IDENTITY):
    """A function that swaps a text's identity terms, or gives None where it has none."""
    to = {a: g[(i + 1) % len(g)] for g in groups for i, a in enumerate(g)}
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(to, key=len, reverse=True))) + r")(?!\w)", re.I)

    def swap(text: str) -> str | None:
        new, n = pattern.subn(lambda m: to[m.group().lower()], text)
        return new if n else None

    return swap


@dataclass
class Mentions:
    """Vocabulary numbers of each term's mention: those it adds to a text, and those that come and go as the term is swapped."""

    adds: list[np.ndarray]
    goes: list[np.ndarray]
    comes: list[np.ndarray]

    @classmethod
    def of(cls, vocabulary: np.ndarray, groups: tuple[tuple[str, ...], ...]) -> Mentions:
        swap = swapper(groups)
        own = [MENTION.format(t) for g in groups for t in g]
        here, there = (_numbers(vocabulary, some) for some in (own, [swap(t) for t in own]))
        return cls(here, [np.setdiff1d(x, y) for x, y in zip(here, there)], [np.setdiff1d(y, x) for x, y in zip(here, there)])


def mentioned(doc_id: int, n: int) -> int:
    """Which of n terms is put behind a document."""
    return zlib.crc32(str(doc_id).encode()) % n


def group_gap(model: Model, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> float:
    """The largest difference between the scores of a bare mention of one term and of the next of its group."""
    swap = swapper(groups)
    own = [MENTION.format(t) for g in groups for t in g]
    a, b = (raw_scores(model, *utf8(pa.array(some, pa.string()))) for some in (own, [swap(t) for t in own]))
    return float(np.abs(1 / (1 + np.exp(-a)) - 1 / (1 + np.exp(-b))).max())


def raw_scores(model: Model, data: np.ndarray, offsets: np.ndarray, sieve: np.ndarray | None = None) -> np.ndarray:
    """Log odds of each row."""
    raw = np.full(len(offsets) - 1, model.intercept)
    if len(model.features):
        for lo, hi in slices(offsets):
            row, at = _known(model.features, data, offsets[lo : hi + 1], sieve)
            raw[lo:hi] += np.bincount(row, model.weights[at], hi - lo)
    return raw


def sample_labels(labels: DataFrame, label: str, learnable: Column, sample_rows: int) -> dict[int, int]:
    """At most sample_rows labelled rows, those of the smallest hash of doc_id."""
    known = labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    return {r[0]: int(r[1]) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learnable: Column | None = None, sample_rows: int = 20_000, most_features: int = 20_000, fairness: float = 10.0, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    sample = sample_labels(labels, label, F.lit(True) if learnable is None else learnable, sample_rows)
    n1 = sum(sample.values())
    n0 = len(sample) - n1
    rate = (n1 + 0.5) / (len(sample) + 1)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    if not n1 or not n0:
        return flat

    def sampled(batch: pa.RecordBatch) -> tuple[pa.Array, list[int]]:
        ids = batch.column(0).to_pylist()
        own = [i for i, d in enumerate(ids) if d in sample]
        return batch.column(1).take(pa.array(own, pa.int64())), [ids[i] for i in own]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = sampled(batch)
            if not ids:
                continue
            y = np.array([sample[d] for d in ids], np.int64)
            data, offsets = utf8(texts)
            toxic: Counter = Counter()
            total: Counter = Counter()
            for lo, hi in slices(offsets):
                row, h = _features(data, offsets[lo : hi + 1])
                for into, some in ((total, h), (toxic, h[y[lo:hi][row] == 1])):
                    keys, n = np.unique(some, return_counts=True)
                    into.update(dict(zip(keys.tolist(), n.tolist())))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], ["feature", "toxic", "total"])

    own = docs.select("doc_id", "text")
    sums = arrow_map(own, count, "feature long, toxic long, total long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("total").alias("t")).where("t >= 3")
    a, b = F.col("a"), F.col("t") - F.col("a")
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    chosen = sums.select("feature", F.abs(z).alias("z")).where("z >= 2.5").orderBy(F.desc("z"), "feature").limit(most_features).collect()
    if not chosen:
        return flat
    terms = features(pa.array([t for g in groups for t in g], pa.string()))[1]
    vocabulary = np.unique(np.concatenate([np.array([r[0] for r in chosen], np.int64).view(np.uint64), terms]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(groups)
        for batch in batches:
            texts, ids = sampled(batch)
            for lo, hi in slices(utf8(texts)[1]):
                own = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                here = _numbers(vocabulary, own)
                swapped = [(i, t) for i, t in enumerate(map(swap, own)) if t is not None]
                there = dict(zip([i for i, _ in swapped], _numbers(vocabulary, [t for _, t in swapped])))
                goes = [np.setdiff1d(x, there[i]).tobytes() if i in there else None for i, x in enumerate(here)]
                comes = [np.setdiff1d(there[i], x).tobytes() if i in there else None for i, x in enumerate(here)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), *(pa.array(x, pa.binary()) for x in ([x.tobytes() for x in here], goes, comes))], ["doc_id", "at", "goes", "comes"])

    rows = sorted(arrow_map(own, pairs, "doc_id long, at binary, goes binary, comes binary").collect(), key=lambda r: (r[0], r[1]))
    weights, intercept = _regress(*_learnt(rows, sample, Mentions.of(vocabulary, groups), len(vocabulary)), len(vocabulary), fairness)
    return Model(vocabulary, weights, intercept)


def _numbers(vocabulary: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """Vocabulary numbers of each text's features, ascending."""
    if not texts:
        return []
    row, at = _known(vocabulary, *utf8(pa.array(texts, pa.string())))
    return np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))


@dataclass
class Cells:
    """Features of rows: cell i says that row[i] has at[i], counted sign[i] times."""

    row: np.ndarray
    at: np.ndarray
    sign: np.ndarray | float = 1.0

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Cells:
        return cls(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64))

    def times(self, w: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.sign, n)

    def back(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, x[self.row] * self.sign, n)


def _learnt(rows: list, sample: dict[int, int], mentions: Mentions, n: int) -> tuple[np.ndarray, Cells, np.ndarray, Cells, int, Cells]:
    """Labels and features of the sampled documents; the documents with a mention and what it adds to each; the number of pairs and their signed differences."""
    own = [np.frombuffer(r[1], np.int32) for r in rows]
    y = np.array([sample[r[0]] for r in rows], float)
    told = np.array([i for i, r in enumerate(rows) if r[2] is None], np.int64)
    swapped = [i for i, r in enumerate(rows) if r[2] is not None]
    term = [mentioned(rows[i][0], len(mentions.adds)) for i in told]
    cells = Cells.of(own)
    seen = cells.row * n + cells.at

    def added(lists: list[np.ndarray]) -> Cells:
        """A list for each told document, without what the document has itself."""
        c = Cells.of(lists)
        new = ~np.isin(told[c.row] * n + c.at, seen) if len(told) else np.zeros(0, bool)
        return Cells(c.row[new], c.at[new])

    goes, comes = added([mentions.goes[t] for t in term]), added([mentions.comes[t] for t in term])
    less, more = (Cells.of([np.frombuffer(rows[i][k], np.int32) for i in swapped]) for k in (2, 3))
    gaps = Cells(
        np.concatenate([goes.row, comes.row, less.row + len(told), more.row + len(told)]), np.concatenate([goes.at, comes.at, less.at, more.at]),
        np.repeat([1.0, -1.0, 1.0, -1.0], [len(goes.row), len(comes.row), len(less.row), len(more.row)]),
    )
    return y, cells, told, added([mentions.adds[t] for t in term]), len(told) + len(swapped), gaps


def _known(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vocabulary numbers of a slice's distinct features, ordered by row."""
    rows, found = [], []
    for row, h in _hashes(data, offsets):
        if sieve is not None:
            near = sieve[(h >> np.uint64(42)).astype(np.int64)]
            row, h = row[near], h[near]
        at = np.searchsorted(vocabulary, h)
        at[at == len(vocabulary)] = 0
        ok = vocabulary[at] == h
        rows.append(row[ok])
        found.append(at[ok])
    both = np.unique(np.concatenate(rows) * len(vocabulary) + np.concatenate(found))
    return both // len(vocabulary), both % len(vocabulary)


def _regress(y: np.ndarray, own: Cells, told: np.ndarray, adds: Cells, pairs: int, gaps: Cells, n: int, fairness: float, ridge: float = 1e-5, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss over the documents and those with a mention, a ridge and the pairs' squared score differences."""
    both = len(y) + len(told)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    mean = (y.sum() + y[told].sum()) / both
    w[n] = np.log((mean + 1e-6) / (1 - mean + 1e-6))
    for step in range(1, rounds + 1):
        raw = own.times(w, len(y)) + w[n]
        error = 1 / (1 + np.exp(-raw)) - y
        more = 1 / (1 + np.exp(-raw[told] - adds.times(w, len(told)))) - y[told]
        grad = np.append(own.back(error + np.bincount(told, more, len(y)), n) + adds.back(more, n), error.sum() + more.sum()) / both
        grad[:n] += ridge * w[:n]
        if pairs:
            grad[:n] += 2 * fairness / pairs * gaps.back(gaps.times(w, pairs), n)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row, one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << 22, bool)
        sieve[(model.features >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            raw = raw_scores(model, *utf8(batch.column(1)), sieve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -50, 50))))], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows whose crc32(doc_id as text) mod 4 is 2 are held out."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, labels, learnable=~held, **options)
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
