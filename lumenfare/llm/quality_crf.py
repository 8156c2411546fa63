"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character kinds, word shape and repetition, and the
same of its neighbours; the chain adds a weight for each pair of adjacent labels. Lines of a labelled document carry its
label, and the chain is fitted by maximum likelihood (forward-backward) on a bounded sample of labelled documents
(`sample_rows`, those of the smallest hash), read in one scan. Scoring is one scan without a shuffle: forward-backward
marginals of the whole text's lines, averaged by line length, give the document's quality.

Defined cases: a null or empty text is one empty line. Rows with a null label or doc_id are never learnt from; repeated
labels of a doc_id count as their maximum. If the sample has labels of one kind only, every score is that kind's smoothed
rate. Very long texts are scored whole, taken alone. Ties of the sample's hash are broken by doc_id. Extra columns are
not read by `score`, and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Spans, arrow_map, fold, slices, utf8, word_bounds
from .toxicity import sample_labels

#: Kinds of bytes: lower-case letters and leading bytes of longer characters, capitals, digits, white space, sentence marks, ! and ?, bars, other marks, bytes inside a character, line feeds.
LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, BAR, MARK, INSIDE, FEED = range(10)
_KIND = np.full(256, MARK, np.int64)
_KIND[97:123] = LOWER
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
_KIND[IS_SPACE] = SPACE
_KIND[[ord(c) for c in ".,;:'\"()-"]] = STOP
_KIND[[ord("!"), ord("?")]] = SHOUT
_KIND[ord("|")] = BAR
_KIND[128:192] = INSIDE
_KIND[192:] = LOWER
_KIND[10] = FEED

#: Features of a line itself; each also comes for the line before and the one after, and the chain's start and end.
OWN = 15


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    rate: float


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's line features, lengths in code points (1 added), and its rows' first lines."""
    part = data[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    # An empty row, or one that ends in a line feed, has a line that starts where the next row does.
    rows = len(bounds) - 1
    feeds = np.flatnonzero(part == 10)
    first = np.arange(rows) + np.searchsorted(feeds, bounds[:-1])
    n = rows + len(feeds)
    begin = np.zeros(n, np.int64)
    begin[first] = bounds[:-1]
    inner = np.ones(n, bool)
    inner[first] = False
    begin[inner] = feeds + 1
    stop = np.append(begin[1:], len(part))
    line = np.repeat(np.arange(n), stop - begin)
    counts = np.bincount(line * 10 + _KIND[part], minlength=n * 10).reshape(n, 10).astype(float)
    folded = fold(part)
    capitals = np.bincount(line[folded != part], minlength=n) - counts[:, UPPER]
    counts[:, UPPER] += capitals
    counts[:, LOWER] -= capitals
    start, end = word_bounds(IS_SPACE[part], bounds)
    word = Spans(folded).hash(start, end)
    of = line[start] if len(start) else np.zeros(0, np.int64)
    words = np.bincount(of, minlength=n).astype(float)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((word, of))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    ends = np.zeros(len(word), bool)
    if len(word):
        ends = np.isin(part[end - 1], np.frombuffer(b".!?,", np.uint8), invert=True) & (_KIND[part[end - 1]] == MARK)
    chars = counts[:, :8].sum(1)
    ink = np.maximum(chars - counts[:, SPACE], 1)
    some = np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    x = np.stack(
        [
            counts[:, UPPER] / letters, counts[:, DIGIT] / ink, counts[:, STOP] / ink, counts[:, SHOUT] / ink, counts[:, BAR] / ink, counts[:, MARK] / ink,
            np.log1p(chars), np.log1p(words), np.minimum(ink / some, 40), np.bincount(of, again, minlength=n) / some, distinct / some,
            np.bincount(of, ends, minlength=n) / some, (chars == 0) * 1.0, (counts[:, MARK] + counts[:, BAR] + counts[:, SHOUT] > 0) * 1.0, counts[:, SPACE] / np.maximum(chars, 1),
        ],
        1,
    )
    return _around(x, first), chars + 1, first


def marginals(good: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once: P(line good), summed pair marginals (2 x 2), summed log normaliser.

    good: each line's log weight of good against bad; steps: log weights of adjacent labels.
    """
    n, size = len(good), np.diff(np.append(first, len(good)))
    order = np.argsort(-size, kind="stable")
    at, left = first[order], size[order]
    top = np.maximum(good, 0)
    emit = np.exp(np.stack([-top, good - top], 1))
    move = np.exp(steps)
    ahead, back, scale = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    longest = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(longest), "left")
    for t in range(longest):
        i = at[: active[t]] + t
        a = emit[i] if not t else (ahead[i - 1] @ move) * emit[i]
        s = a.sum(1)
        ahead[i], scale[i] = a / s[:, None], s
    for t in range(longest - 1, 0, -1):
        i = at[: active[t]] + t
        back[i - 1] = ((emit[i] * back[i]) @ move.T) / scale[i][:, None]
    p = ahead * back
    p = p[:, 1] / p.sum(1)
    inner = np.ones(n, bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    pair = np.einsum("ia,ab,ib->ab", ahead[i - 1] / scale[i][:, None], move, emit[i] * back[i]) if len(i) else np.zeros((2, 2))
    return p, pair, float(np.log(scale).sum() + top.sum())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learnable: Column | None = None, sample_rows: int = 4000, rounds: int = 150) -> Model:
    sample = sample_labels(labels, label, F.lit(True) if learnable is None else learnable, sample_rows)
    rate = (sum(sample.values()) + 0.5) / (len(sample) + 1)
    flat = Model(np.zeros(3 * OWN + 3), np.ones(3 * OWN + 3), np.zeros(3 * OWN + 3), np.zeros((2, 2)), rate)
    if len(set(sample.values())) < 2:
        return flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            own = [i for i, d in enumerate(ids) if d in sample]
            data, offsets = utf8(batch.column(1).take(pa.array(own, pa.int64())))
            for lo, hi in slices(offsets):
                x, _, first = lines(data, offsets[lo : hi + 1])
                parts = np.split(x[:, :OWN].astype(np.float32), first[1:])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own[lo:hi]], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "lines"])

    got = sorted(arrow_map(docs.select("doc_id", "text"), run, "doc_id long, lines binary").collect())
    if not got:
        return flat
    xs = [np.frombuffer(r[1], np.float32).reshape(-1, OWN) for r in got]
    y = np.repeat(np.array([sample[r[0]] for r in got], float), [len(x) for x in xs])
    first = np.cumsum([0, *(len(x) for x in xs[:-1])])
    x = _around(np.vstack(xs).astype(float), first)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    x = (x - mean) / scale
    inner = np.ones(len(x), bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
    w, steps = np.zeros(x.shape[1]), np.zeros((2, 2))
    flat_w = np.zeros(len(w) + 4)
    m, v = np.zeros_like(flat_w), np.zeros_like(flat_w)
    chains = len(first)
    for step in range(1, rounds + 1):
        p, pair, _ = marginals(x @ w, steps, first)
        grad = np.append(x.T @ (p - y) / chains + 1e-3 * w, ((pair - seen) / chains + 1e-2 * steps).ravel())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        flat_w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, steps = flat_w[:-4], flat_w[-4:].reshape(2, 2)
    return Model(mean, scale, w, steps, rate)


def _around(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Lines' own features with their neighbours', as lines() has them."""
    n = len(x)
    head, tail = np.zeros(n), np.zeros(n)
    head[first] = 1
    tail[np.append(first[1:], n) - 1] = 1
    before = np.vstack([np.zeros(OWN), x[:-1]]) * (1 - head)[:, None]
    after = np.vstack([x[1:], np.zeros(OWN)]) * (1 - tail)[:, None]
    return np.hstack([x, before, after, head[:, None], tail[:, None], np.ones((n, 1))])


def quality(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted marginals of a slice's rows."""
    if not model.weights.any():
        return np.full(len(offsets) - 1, model.rate)
    x, length, first = lines(data, offsets)
    p, _, _ = marginals(((x - model.mean) / model.scale) @ model.weights, model.steps, first)
    return np.clip(np.add.reduceat(p * length, first) / np.add.reduceat(length, first), 0, 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and `_quality` for each row, one scan."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            for lo, hi in slices(offsets):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(quality(model, data, offsets[lo : hi + 1]))], [*names, "_quality"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{kinds}, _quality double")


def held_out() -> Column:
    """Rows that are never learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, learnable=~held_out(), **options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """docs of a quality of `least` or more."""
    return score(docs, fit(docs, labels, learnable=~held_out(), **options)).where(F.col("_quality") >= least).drop("_quality")
