"""Shared helpers of the training-data operators: tables, cut lineage, vectorised text hashing, components.

The kernels work on the raw UTF-8 bytes of an Arrow string column, a bounded slice of rows at a time, so that memory
follows the slice (or one long text) and never a partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Bytes of text that a kernel takes at once; a longer single text is taken alone.
SLICE_BYTES = 1_000_000

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieve(df: DataFrame, key: Column, wanted: DataFrame, column: str, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """df in two parts, without a shuffle: the rows whose 64-bit hash `key` may be in wanted[column], and rows whose key surely isn't.

    What is broadcast is a table of 2 ** bits bits, 64 to a row (2 MB at 23), whatever the size of `wanted`: the more keys,
    the more rows pass by chance, up to all of them. A null key is in neither table and so is no hit.
    """
    place = F.shiftrightunsigned(key, 64 - bits)
    words = wanted.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("_p")).groupBy(F.expr("_p div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_set"))
    words = materialize(words, "sieve")
    met = df.withColumn("_place", place).join(F.broadcast(words), F.expr("_place div 64") == F.col("_word"), "left")
    hit = F.coalesce(F.getbit("_set", (F.col("_place") % 64).cast("int")) == 1, F.lit(False))
    return tuple(met.where(h).select(*[df[c] for c in df.columns]) for h in (hit, ~hit))


def release() -> None:
    """Give freed memory back to the system: the workers beside an executor's JVM live on from operator to operator."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow on workers that have this package; a task's freed memory goes back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def arrow_groups(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """df.groupBy(keys).applyInArrow on workers that have this package; freed memory goes back after each group of over 1 MB."""

    def group(rows: pa.Table) -> pa.Table:
        out, size = run(rows), rows.nbytes
        del rows
        if size > 1_000_000:
            release()
        return out

    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(group, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def rows_at_once(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `most` bytes of a string column, one row at least."""
    for lo, hi in slices(utf8(batch.column(column))[1], most):
        yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
_RADIX = 0xD1342543DE82EF95
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_GRAM = mix64(np.arange(1001, 1065, dtype=np.uint64) * _STEP)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, r in enumerate((_RADIX, _RADIX_INV)):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Spans:
    """Hashes of byte spans of one slice by prefix sums of a polynomial over randomised bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _radix_powers(max(len(data), 1 << 20))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _STEP)


def word_bounds(space: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where `space` is False; a run never crosses one of the row bounds."""
    n = len(space)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[bounds[(bounds < n)]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = bounds[(bounds > 0) & (bounds <= n)] - 1
    after[ends] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


#: Whatever is neither an ASCII letter or digit nor part of a longer UTF-8 sequence.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def fold(part: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 to lower case, on UTF-8 bytes."""
    out = ASCII_LOWER[part]
    after = np.flatnonzero(part[:-1] == 0xC3) + 1
    after = after[(part[after] >= 0x80) & (part[after] <= 0x9E) & (part[after] != 0x97)]
    out[after] += 0x20
    return out


def marks(part: np.ndarray) -> np.ndarray:
    """Which bytes are part of a mark: ASCII ones, Latin-1's, general punctuation (curly quotes, dashes, wide spaces) and CJK's."""
    out = IS_MARK[part]
    lead = np.flatnonzero((part == 0xC2) | (part == 0xE2) | (part == 0xE3))
    if lead.size:
        after, third = (part[np.minimum(lead + k, len(part) - 1)] for k in (1, 2))
        two = (part[lead] == 0xC2) & ~np.isin(after, (0xAA, 0xB5, 0xBA))
        three = (part[lead] == 0xE2) & ((after == 0x80) | (after == 0x81) & (third < 0xB0)) | (part[lead] == 0xE3) & (after == 0x80) & ~((third >= 0x85) & (third <= 0x87))
        for some, width in ((lead[two], 2), (lead[three], 3)):
            for k in range(width):
                out[np.minimum(some + k, len(part) - 1)] = True
    return out


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with case folded and every mark a separator; the span hasher instead of the hashes."""
    part = fold(data[offsets[0] : offsets[-1]])
    bounds = offsets - offsets[0]
    start, end = word_bounds(marks(part), bounds)
    return Spans(part), start, end, np.searchsorted(start, bounds)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte (from the first offset) of each lower-cased word, and the first word of each row (and their number)."""
    part = ASCII_LOWER[data[offsets[0] : offsets[-1]]]
    bounds = offsets - offsets[0]
    start, end = word_bounds(IS_SPACE[part], bounds)
    first = np.searchsorted(start, bounds)
    return Spans(part).hash(start, end), start, end, first


def grams(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word grams and their rows' first grams. A row of fewer words has its whole sequence as one."""
    rows = len(first) - 1
    sizes = np.diff(first)
    row = np.repeat(np.arange(rows), sizes)
    total = len(word)
    if total >= n:
        span = total - n + 1
        h = word[:span] * _GRAM[0]
        for i in range(1, n):
            h = h + word[i : i + span] * _GRAM[i]
        full = row[:span] == row[n - 1 :]
        h, owner = mix64(h[full] + _U(n)), row[:span][full]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if (short := np.flatnonzero((sizes > 0) & (sizes < n))).size:
        own = [mix64(np.array([sum(int(w) * int(_GRAM[i]) for i, w in enumerate(word[first[k] : first[k + 1]])) + int(sizes[k]) & (1 << 64) - 1], np.uint64))[0] for k in short]
        h, owner = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word grams as sorted hashes, and their rows' first ones."""
    word, _, _, first = words(data, offsets)
    h, at = grams(word, first, n)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.searchsorted(owner[keep], np.arange(len(at)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node of an edge, component its smallest node.

    Alternating large and small stars: each round joins edges with their nodes' smallest neighbours, sums are combined
    before each exchange, and the rounds grow with the logarithm of the number of nodes. Null ends are left out; loops
    and repeated edges do no harm; no edges give no rows.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(e.select("b", F.col("b").alias("c")).distinct())
        seen = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(least).distinct(), "small")
