"""Secret scans: fixed patterns, and a battery of randomness tests that adds what only looks random.

Base spans come from three patterns (assigned values, access ids, hex runs). Beside them every maximal run of
`[A-Za-z0-9+/_=-]` of at least `least` characters is a candidate:

1. Its encoding is inferred from its characters (decimal, hex, one case, letters, base 32, 36, 62, 64, 64url): an alphabet
   of k symbols.
2. Three tests ask whether it may be random in that alphabet: chi-squared uniformity of its symbols and of its character
   classes (mean and variance exact for its length), Wald and Wolfowitz's runs about the alphabet's middle, and the serial
   correlation of neighbouring symbols. Fisher's method combines their p-values into one score: near 0 for text.
3. False discoveries are controlled by length. Each candidate has a decoy: an identifier of the same length and character
   classes made of the words before it. Over all documents, in each stratum of alphabet family and length class, the cut is
   the least score at which decoys are at most `rate` of the candidates that reach it. Where no cut does, none is added.

What goes through the driver are counts of 18 strata and eleven cuts. A candidate within a base span adds nothing.

Defined cases: null and empty texts have no spans (zero counts, the digest of the empty string). Each row is judged by its
own text, repeated and null doc_ids included. Spans of one start stand in the order of KINDS. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow_map, materialize, slices, utf8, word_bounds

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: What a text must hold, in lower case, to have an assigned value.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Least length of a candidate.
LEAST = 20
#: Scores that may be cuts.
CUTS = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
#: Upper ends of the length classes, the last open.
LENGTHS = (24, 32, 48, 96, 256)

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CLASS = np.full(256, 3, np.uint8)
for _k, _some in enumerate((_UPPER, _LOWER, _DIGITS)):
    _CLASS[[ord(c) for c in _some]] = _k
#: Alphabets by name, smallest first: the first that holds all characters of a run is its encoding.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "hex upper": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base36 upper": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "any": _UPPER + _LOWER + _DIGITS + "+/-_=",
}


class Alphabet:
    def __init__(self, symbols: str):
        self.size = len(symbols)
        self.index = np.full(256, -1, np.int16)
        self.index[[ord(c) for c in symbols]] = np.arange(self.size)
        self.shares = np.bincount(_CLASS[[ord(c) for c in symbols]], minlength=4) / self.size
        #: 0: at most 16 symbols, 1: letters only, 2: the rest.
        self.family = 0 if self.size <= 16 else 1 if symbols.isalpha() else 2


_ALPHABETS = [Alphabet(s) for s in ALPHABETS.values()]
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[ord(c) for c in _UPPER + _LOWER + _DIGITS + "+/_=-"]] = True
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[ord(c) for c in _DIGITS + "abcdef"]] = True
_IS_LETTER = _CLASS < 2


def encoding(run: np.ndarray) -> Alphabet:
    return next(a for a in _ALPHABETS if (a.index[run] >= 0).all())


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(counts: np.ndarray, shares: np.ndarray) -> float:
    """Two-sided p-value of counts against shares (over 0 all), by a gamma distribution of the statistic's exact mean and variance."""
    n, k = int(counts.sum()), len(shares)
    if k < 2:
        return 1.0
    x = float((counts * counts / shares).sum() / n - n)
    mean = k - 1
    var = 2 * (k - 1) * (n - 1) / n + (float((1 / shares).sum()) - k * k) / n
    scale, dof = var / (2 * mean), 2 * mean * mean / var
    # Wilson and Hilferty: the cube root of a gamma variable is nearly normal.
    z = ((max(x, 0.0) / scale / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return min(1.0, 2 * min(_normal_tail(z), _normal_tail(-z)))


def runs(above: np.ndarray) -> float:
    """Two-sided p-value of Wald and Wolfowitz's number of runs."""
    n, n1 = len(above), int(np.count_nonzero(above))
    n2 = n - n1
    if not n1 or not n2:
        return 2.0 ** (1 - n)
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    seen = 1 + int(np.count_nonzero(above[1:] != above[:-1]))
    return min(1.0, 2 * _normal_tail(abs(seen - mean) / math.sqrt(var))) if var > 0 else 1.0


def serial(index: np.ndarray) -> float:
    """Two-sided p-value of the correlation of neighbouring symbols."""
    x = index - index.mean()
    square = float((x * x).sum())
    if not square:
        return 0.0
    n = len(x)
    return 2 * _normal_tail(abs(float((x[1:] * x[:-1]).sum()) / square + 1 / n) * math.sqrt(n))


def fisher(ps: list[float]) -> float:
    """Fisher's combination: the chi-squared tail at -2 * sum(log p), 2 degrees of freedom for each."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return math.exp(-half) * total


def randomness(run: np.ndarray, alphabet: Alphabet) -> float:
    """How well the bytes of run agree with random symbols of the alphabet: about uniform over 0 to 1 for those, near 0 for text."""
    index = alphabet.index[run].astype(np.int64)
    some = alphabet.shares > 0
    symbols = chi_squared(np.bincount(index, minlength=alphabet.size), np.full(alphabet.size, 1 / alphabet.size))
    classes = chi_squared(np.bincount(_CLASS[run], minlength=4)[some], alphabet.shares[some])
    return fisher([min(1.0, 2 * min(symbols, classes)), runs(2 * index >= alphabet.size), serial(index)])


def decoy(run: np.ndarray, alphabet: Alphabet, before: np.ndarray) -> np.ndarray | None:
    """An identifier as long as run, from the letters `before` it (word starts capital where run has capitals), with run's digits and marks at its end.

    In alphabets without all letters, a letter stands for the symbol of its number. None where too few letters are before.
    """
    classes = np.bincount(_CLASS[run], minlength=4)
    if alphabet.family == 0:
        letters = before[_IS_LETTER[before]][-len(run) :]
        symbols = np.flatnonzero(alphabet.index >= 0)
        return symbols[(letters & 31) % alphabet.size].astype(np.uint8) if len(letters) == len(run) else None
    n = int(classes[0] + classes[1])
    is_letter = _IS_LETTER[before]
    starts = is_letter.copy()
    starts[1:] &= ~is_letter[:-1]
    letters, starts = before[is_letter][-n:] if n else before[:0], starts[is_letter][-n:] if n else is_letter[:0]
    if len(letters) < n:
        return None
    letters = letters | 32 if classes[1] else letters & 223
    if classes[0] and classes[1]:
        letters = np.where(starts, letters & 223, letters)
    out = np.concatenate([letters, np.sort(run[_CLASS[run] == 2]), np.sort(run[_CLASS[run] == 3])]).astype(np.uint8)
    return out if (alphabet.index[out] >= 0).all() else np.where(alphabet.index[out] >= 0, out, ord("A") if alphabet.index[65] >= 0 else ord("a")).astype(np.uint8)


def stratum(alphabet: Alphabet, n: int) -> int:
    return alphabet.family * (len(LENGTHS) + 1) + int(np.searchsorted(LENGTHS, n, "right"))


_SPAN = "struct<start:int,kind:int,end:int>"
_CANDIDATE = "struct<start:int,end:int,stratum:int,score:double,decoy:double>"
SCANNED = f"doc_id long, base array<{_SPAN}>, candidates array<{_CANDIDATE}>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_CANDIDATE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("score", pa.float64()), ("decoy", pa.float64())]))


def _long_runs(part: np.ndarray, wanted: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    start, end = word_bounds(~wanted[part], bounds)
    some = end - start >= least
    return start[some], end[some]


def _candidates(part: np.ndarray, bounds: np.ndarray, least: int) -> list[tuple[int, int, int, float, float | None]]:
    """(start, end, stratum, score, decoy's score) of each candidate of a slice, in bytes. Those that no cut takes are left out where their decoy is, too."""
    out = []
    start, end = _long_runs(part, _IS_TOKEN, bounds, least)
    home = bounds[np.searchsorted(bounds, start, "right") - 1]
    for a, b, row in zip(start.tolist(), end.tolist(), home.tolist()):
        # Marks at the ends are padding and punctuation.
        solid = np.flatnonzero(_CLASS[part[a:b]] < 3)
        if not len(solid) or solid[-1] - solid[0] + 1 < least:
            continue
        a, b = a + int(solid[0]), a + int(solid[-1]) + 1
        run = part[a:b]
        alphabet = encoding(run)
        score = randomness(run, alphabet)
        other = decoy(run, alphabet, part[max(row, a - 4 * (b - a) - 64) : a])
        against = None if other is None else randomness(other, alphabet)
        if max(score, against or 0.0) >= CUTS[0]:
            out.append((a, b, stratum(alphabet, b - a), score, against))
    return out


def _matches(part: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base span of a slice, in bytes."""
    out = [(a, 2, b) for a, b in zip(*(x.tolist() for x in _long_runs(part, _IS_HEX, bounds, 16)))]
    raw, low = part.tobytes(), ASCII_LOWER[part].tobytes()
    for kind, text, words, pattern in ((0, low, KEYWORDS, ASSIGN), (1, raw, (b"AKIA",), ACCESS)):
        told: set[int] = set()
        for word in words:
            at = text.find(word)
            while at >= 0:
                told.add(row := int(np.searchsorted(bounds, at, "right")) - 1)
                at = text.find(word, int(bounds[row + 1]))
        for row in told:
            lo, hi = int(bounds[row]), int(bounds[row + 1])
            for m in pattern.finditer(raw, lo, hi):
                if (kind == 0 and m.end(2) - m.start(2) >= 12) or (kind == 1 and m.end() - m.start() >= 18):
                    out.append((m.start(), kind, m.end()))
    return out


def scan(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """SCANNED for each row of docs: base spans and scored candidates, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                base: list[list] = [[] for _ in range(hi - lo)]
                more: list[list] = [[] for _ in range(hi - lo)]
                row = lambda at: int(np.searchsorted(bounds, at, "right")) - 1
                place = lambda at, k: int(points[at] - points[bounds[k]])
                for a, kind, b in _matches(part, bounds):
                    k = row(a)
                    base[k].append({"start": place(a, k), "kind": kind, "end": place(b, k)})
                for a, b, at, score, against in _candidates(part, bounds, least):
                    k = row(a)
                    more[k].append({"start": place(a, k), "end": place(b, k), "stratum": at, "score": score, "decoy": against})
                for own in base:
                    own.sort(key=lambda s: (s["start"], s["kind"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(base, _SPAN_TYPE), pa.array(more, _CANDIDATE_TYPE)], ["doc_id", "base", "candidates"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCANNED)


def cuts(scanned: DataFrame, rate: float) -> dict[int, float]:
    """The least cut of each stratum that keeps decoys at most at `rate` of the candidates that reach it, over all rows."""
    c = scanned.select(F.explode("candidates").alias("c")).select("c.*")
    sums = [F.count_if(F.col(of) >= t).alias(f"{of}{k}") for of in ("score", "decoy") for k, t in enumerate(CUTS)]
    out = {}
    for r in c.groupBy("stratum").agg(*sums).collect():  # a row for each stratum
        ok = [t for k, t in enumerate(CUTS) if r[f"score{k}"] and r[f"decoy{k}"] <= rate * r[f"score{k}"]]
        if ok:
            out[r["stratum"]] = ok[0]
    return out


def find(docs: DataFrame, rate: float = 0.05, least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, base and added, arrays of (start, kind, end) with the kind's number in KINDS."""
    scanned = materialize(scan(docs, least), "scanned")
    known = sorted(cuts(scanned, rate).items())

    def taken(c: Column) -> Column:
        reaches = F.lit(False)
        for k, t in known:
            reaches = reaches | ((c["stratum"] == k) & (c["score"] >= t))
        return reaches & ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))

    added = F.transform(F.filter("candidates", taken), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", added.alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rate: float = 0.05, least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (`kind:start:end` by start, code points, end exclusive)."""
    found = find(docs, rate, least)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size("added").cast("long").alias("n_random"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))
