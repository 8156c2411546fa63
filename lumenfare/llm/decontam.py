"""Benchmark decontamination: rare n-gram seeds join passages with test items, then Smith-Waterman alignment scores them.

1. One scan of the documents gives the places of those n-grams that items hold too: a bit table of the items' n-grams, of
   bounded size, passes them and a few others. Rows of equal text are counted and are one text from here on.
2. The places joined with the items' n-grams are the seeds, and their counts are the document frequencies. An item's rare
   seeds are those n-grams that occur in no more documents than its median n-gram, so that every item has some, however
   often it was copied. Seeds of like diagonal make a passage; one with a rare seed, or with two different seeds, is a
   candidate for its item.
3. Texts with candidates (a bit table tells the others apart as they are scanned) meet them by a join, and each passage is
   aligned with the item's words (match 2, mismatch -1, gap -1). The score is the best local alignment's share of the
   item's own; of an item of more than `whole` words, that many words' own alignment is a full score, so that a long
   verbatim part of a long item counts. Words are compared without case and punctuation.

Defined cases: null or empty documents and items have no n-grams and match nothing. An item shorter than n words has its
whole sequence as its n-gram; an item of one common word matches all documents that hold it. Repeated documents and items
each give their own rows; of equal alignments the one ending first is reported. Very long documents are aligned around
seeds only. Null ids are carried through: rows are judged by their text, never by their id, so that `clean` drops every
row of a contaminated text and no other row of the same doc_id. Extra columns are not read by `matches`, kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, grams, materialize, plain_words, sieve, slices, utf8

MATCH, MISMATCH, GAP = 2, -1, -1

MATCHES = "doc_id long, item_id long, score double, start_word long, end_word long"


def _text_key(text: str = "text") -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.lit(11)).alias("h2")]


def item_words(items: DataFrame) -> DataFrame:
    """(item_key, item_id, n_words, words): every item that has words, with their hashes; item_key is the row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                spans, start, end, first = plain_words(data, offsets[lo : hi + 1])
                words = [w.tobytes() for w in np.split(spans.hash(start, end), first[1:-1])]
                keys, ids = (batch.column(i).slice(lo, hi - lo) for i in range(2))
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(np.diff(first).astype(np.int32)), pa.array(words, pa.binary())], ["item_key", "item_id", "n_words", "words"])

    kept = arrow_map(items.select(F.monotonically_increasing_id(), "item_id", "text"), run, "item_key long, item_id long, n_words int, words binary")
    return materialize(kept.where("n_words > 0"), "items")


def item_grams(words: DataFrame, n: int) -> DataFrame:
    """(gram, item_key, at, n_words): the n-grams of each item and their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, _ = grams(np.frombuffer(own, np.uint64), np.array([0, size]), min(n, size))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([key] * len(h), pa.int64()), pa.array(np.arange(len(h), dtype=np.int32)), pa.array([size] * len(h), pa.int32())], ["gram", "item_key", "at", "n_words"])

    return materialize(arrow_map(words.select("item_key", "n_words", "words"), run, "gram long, item_key long, at int, n_words int"), "grams")


def _bit_table(own: DataFrame, most_bits: int) -> np.ndarray:
    """Which top bits of a gram some item's gram has: at most 2 ** most_bits bits, whatever the number of items."""
    bits = min(most_bits, max(20, (16 * own.count()).bit_length()))
    got = own.select(F.shiftrightunsigned("gram", 64 - bits).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("set"))
    table = np.zeros(1 << bits - 6, np.int64)
    for r in got.toLocalIterator():
        table[r[0]] = r[1]
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def places(docs: DataFrame, own: DataFrame, n: int, most_bits: int) -> DataFrame:
    """(h1, h2, gram, place, copies): where the texts hold grams that (but for a few) some item holds. One scan."""
    table = _bit_table(own, most_bits)
    shift = np.uint64(64 - (len(table).bit_length() - 1))
    sizes = sorted(r[0] for r in own.select(F.least("n_words", F.lit(n))).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                spans, start, end, first = plain_words(data, offsets[lo : hi + 1])
                word = spans.hash(start, end)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                for size in sizes:
                    if len(word) < size:
                        continue
                    h, _ = grams(word, np.array([0, len(word)]), size)
                    at = np.flatnonzero(table[(h >> shift).astype(np.int64)] & (row[: len(h)] == row[size - 1 :]))
                    if len(at):
                        of = pa.array(lo + row[at])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(h[at].view(np.int64)), pa.array((at - first[row[at]]).astype(np.int32))], ["h1", "h2", "gram", "place"])

    found = arrow_map(docs.select(*_text_key(), "text"), run, "h1 long, h2 long, gram long, place int")
    return materialize(found.groupBy("h1", "h2", "gram", "place").agg(F.count("*").alias("copies")), "places")


def candidates(found: DataFrame, own: DataFrame) -> DataFrame:
    """(h1, h2, item_key, lo, hi): the passages to align, as word ranges around seeds of like diagonal."""
    frequency = found.groupBy("h1", "h2", "gram").agg(F.max("copies").alias("copies")).groupBy("gram").agg(F.sum("copies").alias("n"))
    counted = materialize(own.join(frequency, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))), "counted")
    middle = counted.groupBy("item_key").agg(F.median("n").alias("middle"))
    seeds = materialize(counted.join(middle, "item_key").select("gram", "item_key", "at", "n_words", (F.col("n") <= F.col("middle")).alias("rare")), "seeds")
    diagonal, pad = F.col("place") - F.col("at"), F.expr("n_words div 2") + 4
    hits = found.join(seeds, "gram").select("h1", "h2", "item_key", "at", "rare", "place", diagonal.alias("diagonal"), (diagonal - pad).alias("lo"), (diagonal + F.col("n_words") + pad).alias("hi"))
    line = Window.partitionBy("h1", "h2", "item_key").orderBy("diagonal", "place", "at")
    opens = hits.withColumn("opens", F.coalesce((F.col("lo") > F.lag("hi").over(line)).cast("int"), F.lit(1)))
    runs = opens.withColumn("run", F.sum("opens").over(line)).groupBy("h1", "h2", "item_key", "run").agg(F.greatest(F.min("lo"), F.lit(0)).alias("lo"), F.max("hi").alias("hi"), F.max("rare").alias("rare"), (F.min("at") < F.max("at")).alias("two"))
    return materialize(runs.where("rare or two").select("h1", "h2", "item_key", "lo", "hi"), "candidates")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first word and end of its part of the passage."""
    m = len(passage)
    column = np.arange(1, m + 1, dtype=np.int64)
    rise = (-GAP * column) << 32
    fresh = column.copy()
    above = np.arange(0, m + 1, dtype=np.int64)
    best, at = 0, 0
    for w in item:
        step = np.where(passage == w, MATCH, MISMATCH).astype(np.int64) << 32
        row = np.maximum(np.maximum(above[:-1] + step, above[1:] + (GAP << 32)), fresh)
        row = np.maximum(np.maximum.accumulate(row + rise) - rise, fresh)
        above = np.concatenate([[0], row])
        if (top := int(row.argmax())) >= 0 and row[top] >> 32 > best >> 32:
            best, at = int(row[top]), top + 1
    return best >> 32, best & 0xFFFFFFFF, at


def _aligned(docs: DataFrame, items: DataFrame, n: int, least: float, whole: int, most_bits: int) -> DataFrame:
    """MATCHES with the text's key h1, h2."""
    words = item_words(items)
    own = item_grams(words, n)
    told = candidates(places(docs, own, n, most_bits), own).join(words, "item_key")
    passages = materialize(told.groupBy("h1", "h2").agg(F.collect_list(F.struct("item_key", "item_id", "words", "lo", "hi")).alias("passages")), "passages")
    touched, _ = sieve(docs.select("doc_id", "text"), F.xxhash64("text"), passages, "h1")
    # Shuffled at any size: the plan must not hang on whether the candidates of a small corpus would fit a broadcast.
    met = touched.select("doc_id", "text", *_text_key()).join(passages.hint("merge"), ["h1", "h2"]).select("doc_id", "h1", "h2", "text", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            rows: list[int] = []
            out: list[tuple] = []
            for lo, hi in slices(offsets):
                spans, start, end, first = plain_words(data, offsets[lo : hi + 1])
                word = spans.hash(start, end)
                for r, told in enumerate(batch.column(4).slice(lo, hi - lo).to_pylist()):
                    text, best = word[first[r] : first[r + 1]], {}
                    for p in told:
                        item = np.frombuffer(p["words"], np.uint64)
                        score, begin, stop = align(item, text[p["lo"] : p["hi"]])
                        share = min(1.0, score / (MATCH * min(len(item), whole)))
                        if share >= least:
                            got = (p["item_id"], share, p["lo"] + begin, p["lo"] + stop)
                            if (old := best.get(p["item_key"])) is None or (share, -got[3]) > (old[1], -old[3]):
                                best[p["item_key"]] = got
                    rows += [lo + r] * len(best)
                    out += best.values()
            of = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(3)), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], ["doc_id", "h1", "h2", "item_id", "score", "start_word", "end_word"])

    return arrow_map(met, run, "doc_id long, h1 long, h2 long, item_id long, score double, start_word long, end_word long")


def matches(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, whole: int = 60, most_bits: int = 27) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each item's best alignment in each document, from a score of `least` on."""
    return _aligned(docs, items, n, least, whole, most_bits).select("doc_id", "item_id", "score", "start_word", "end_word")


def clean(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, whole: int = 60, most_bits: int = 27) -> DataFrame:
    """docs without the rows whose text holds a copy of an item."""
    leaked = materialize(_aligned(docs, items, n, least, whole, most_bits).select("h1", "h2").distinct(), "leaks")
    touched, others = sieve(docs, F.xxhash64("text"), leaked, "h1")
    kept = touched.join(leaked.hint("merge"), (F.xxhash64(touched["text"]) == leaked["h1"]) & (F.xxhash64(F.lit(7), touched["text"], F.lit(11)) == leaked["h2"]), "left_anti")
    return kept.union(others)
