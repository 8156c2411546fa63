"""Spelling variants: words one edit apart, found by an index of variable-length grams.

1. A scan counts each text's words (runs of letters, A-Z lowered) and sums them before the shuffle. Words of fewer than
   `n_least` occurrences or five code points go.
2. The gram dictionary is pruned by frequency. A gram starts at every place of a word and is lengthened, from `q_min` on,
   as long as it is frequent: a frequent gram's list would be long, its extensions' lists are shorter. So the dictionary is
   told by its frequent grams alone: those that more than max(`frequent`, all gram occurrences / 2^`dictionary`) words hold,
   which no corpus has more than 2^`dictionary` of (proven: their occurrences would exceed all). That set goes to tasks.
3. Each word is decomposed, place by place. One edit changes a gram only if it falls into it (or if the gram was cut by the
   word's end and the end moves), so the most grams that any one edit covers is the word's affected-gram bound. All other
   grams stand in every near word, at the same place or one further.
4. Lists are merged by that bound: of bound + 1 grams at least one stays, so a word looks only into its bound + 1 shortest
   lists. Lists are kept by gram, place and the word's length: near words are in five of those (same length and place; one
   longer, same or next place; one shorter, same or former place).
5. A word without bound + 1 grams, or whose lists hold more than `most` words, takes another exact way, with all others like
   it: two words one edit apart share a word or a hash of one with a code point left out. Pairs of a word of either kind
   with one that looks into lists are found by the latter.
6. Pairs are verified by edit distance, and each word's form, root (pointer doubling: a form has at least twice as many
   occurrences, so chains are short) and number of near words are derived by joins.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string in the hash that decides on
damage. Repeated rows count as often as they stand. No words, no rows. Extra columns are not read. Order is by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow_map, materialize, slices, utf8

LEAST_LENGTH, LEAST_COUNT = 5, 3
Q_MIN, Q_MAX = 2, 8
#: Words that a frequent gram is in, at least; binary logarithm of the dictionary's bound.
FREQUENT, DICTIONARY = 64, 17
#: Words in the lists that one word looks into, at most.
MOST = 256
_RUN = re.compile("[a-zÀ-ÿ]{5,}")


def damaged_words(text: str, doc_id: object) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text whose A-Z are lower-case, of five code points or more after damage."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def words(docs: DataFrame, n_least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words and their occurrences over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for lo, hi in slices(offsets):
                seen: Counter[str] = Counter()
                low = ASCII_LOWER[data[offsets[lo] : offsets[hi]]].tobytes()
                for k in range(lo, hi):
                    for word, n in damaged_words(low[offsets[k] - offsets[lo] : offsets[k + 1] - offsets[lo]].decode(errors="replace"), ids[k].as_py()):
                        seen[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counted = arrow_map(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= n_least)


def frequent_grams(vocabulary: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, frequent: int = FREQUENT, dictionary: int = DICTIONARY) -> set[str]:
    """The grams of q_min to q_max - 1 code points that more words hold than max(frequent, all occurrences / 2^dictionary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for word in batch.column(0).to_pylist():
                seen.update({word[i : i + q] for q in range(q_min, q_max) for i in range(len(word) - q + 1)})
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["gram", "n"])
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["gram", "n"])

    counted = materialize(arrow_map(vocabulary.select("word"), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 1), "grams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    # More than total / 2^dictionary occurrences each: fewer than 2^dictionary rows.
    return {r.gram for r in counted.where(F.col("n") > max(frequent, total >> dictionary)).select("gram").toLocalIterator()}


def decompose(word: str, known: set[str], q_min: int = Q_MIN, q_max: int = Q_MAX) -> list[tuple[int, int, bool]]:
    """(start, end, cut by the word's end) of the gram at each place: the first that is not frequent, from q_min code points on."""
    n, out = len(word), []
    for i in range(n - q_min + 1):
        end = i + q_min
        while end < n and end - i < q_max and word[i:end] in known:
            end += 1
        out.append((i, end, end == n and end - i < q_max and word[i:end] in known))
    return out


def affected(grams: list[tuple[int, int, bool]], n: int) -> int:
    """The most grams of a word of n code points that one inserted, deleted or replaced code point may change."""
    steps = np.zeros(n + 2, np.int64)
    inner = np.zeros(n + 2, np.int64)
    cut = 0
    for a, b, ends in grams:
        # Replaced or deleted: any of its code points. Inserted before code point g: between two of its own, or at a moving end.
        steps[a] += 1
        steps[b] -= 1
        inner[a + 1] += 1
        inner[b] -= 1
        cut += ends
    return max(int(np.cumsum(steps).max(initial=0)), int(np.cumsum(inner).max(initial=0)), cut)


def index(vocabulary: DataFrame, known: set[str], q_min: int = Q_MIN, q_max: int = Q_MAX) -> DataFrame:
    """(word, n, size, bound, place, gram) for each gram of each word; bound: how many of them one edit may change."""
    box = vocabulary.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                rows = batch.slice(lo, 1024)
                of, size, bound, place, gram = [], [], [], [], []
                for k, word in enumerate(rows.column(0).to_pylist()):
                    own = decompose(word, box.value, q_min, q_max)
                    most = affected(own, len(word))
                    for a, b, _ in own:
                        of.append(k), size.append(len(word)), bound.append(most), place.append(a), gram.append(word[a:b])
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), *(pa.array(x, pa.int32()) for x in (size, bound, place)), pa.array(gram, pa.string())], ["word", "n", "size", "bound", "place", "gram"])

    return arrow_map(vocabulary.select("word", "n"), run, "word string, n long, size int, bound int, place int, gram string")


def lookups(grams: DataFrame, most: int = MOST) -> DataFrame:
    """Each word with the bound + 1 shortest of its lists (`lists`: gram, place), null where it has fewer or they hold more than `most` words."""
    lengths = grams.groupBy("gram", "size", "place").agg(F.count("*").alias("held"))
    told = grams.join(lengths.hint("merge"), ["gram", "size", "place"])
    by_word = told.groupBy("word").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("bound").alias("bound"), F.array_sort(F.collect_list(F.struct("held", "place", "gram"))).alias("own"))
    first = F.slice("own", 1, F.col("bound") + 1)
    held = F.aggregate(first, F.lit(0).cast("long"), lambda s, x: s + x["held"])
    return by_word.select("word", "n", "size", F.when((F.size("own") > F.col("bound")) & (held <= most), first).alias("lists"))


#: (code points more than the word, places further) of the lists that hold words one edit apart.
AROUND = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def _left_out(rest: DataFrame) -> DataFrame:
    """(word, n, key): hashes of a word and of the word without each of its code points, by prefix sums: as many as it has code points, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = batch.slice(lo, 256)
                of, keys = [], []
                for k, word in enumerate(rows.column(0).to_pylist()):
                    own = np.unique(variant_keys(word))
                    of.append(np.full(len(own), k, np.int32))
                    keys.append(own)
                at = pa.array(np.concatenate([np.zeros(0, np.int32), *of]))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["word", "n", "key"])

    return arrow_map(rest.select("word", "n"), run, "word string, n long, key long")


def variant_keys(word: str) -> np.ndarray:
    """64-bit polynomial hashes of the word and of each of its variants with one code point left out."""
    radix = np.uint64(0xD1342543DE82EF95)
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    points = (points ^ (points >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    n = len(points)
    powers = np.cumprod(np.append(np.uint64(1), np.full(n, radix)), dtype=np.uint64)
    # Prefix sums with the code points' own powers, and with the next lower ones for those behind the gap.
    own = np.append(np.uint64(0), np.cumsum(points * powers[1:], dtype=np.uint64))
    lower = np.append(np.uint64(0), np.cumsum(points * powers[:-1], dtype=np.uint64))
    out = np.append(own[:-1] + (lower[-1] - lower[1:]), own[-1])
    sizes = np.append(np.full(n, n - 1), n).astype(np.uint64)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + sizes
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def near_pairs(vocabulary: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, frequent: int = FREQUENT, dictionary: int = DICTIONARY, most: int = MOST) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of words that differ by one inserted, deleted or replaced code point."""
    grams = materialize(index(vocabulary, frequent_grams(vocabulary, q_min, q_max, frequent, dictionary), q_min, q_max), "index")
    looked = materialize(lookups(grams, most), "lookups")
    asked = looked.where("lists is not null").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "size", F.explode("lists").alias("own"))
    shifts = F.explode(F.array(*(F.struct(F.lit(more).alias("more"), F.lit(further).alias("further")) for more, further in AROUND)))
    asked = asked.select("a", "n_a", "size", "own", shifts.alias("to")).select("a", "n_a", F.col("own.gram").alias("gram"), (F.col("size") + F.col("to.more")).alias("size"), (F.col("own.place") + F.col("to.further")).alias("place"))
    found = asked.join(grams.select("gram", "size", "place", F.col("word").alias("b"), F.col("n").alias("n_b")).hint("merge"), ["gram", "size", "place"]).select("a", "n_a", "b", "n_b")
    # A vocabulary has no word without grams: all have five code points.
    kept = materialize(_left_out(looked.where("lists is null")), "left_out")
    met = kept.select("key", F.col("word").alias("a"), F.col("n").alias("n_a")).join(kept.select("key", F.col("word").alias("b"), F.col("n").alias("n_b")).hint("merge"), "key").where("a < b").drop("key")
    swap = F.col("a") > F.col("b")
    ordered = found.where("a <> b").select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("n_a", "n_b"), ("b", "a"), ("n_b", "n_a"))))
    return ordered.union(met.select("a", "n_a", "b", "n_b")).where(F.levenshtein("a", "b", 1) == 1).distinct()


def variants(docs: DataFrame, n_least: int = LEAST_COUNT, times: int = 2, **how) -> DataFrame:
    """Per word: word, n, n_near, form (near word of most occurrences, ties the least, if at least `times` as many), form_n, root.

    how: near_pairs' parameters; they change no result.
    """
    vocabulary = materialize(words(docs, n_least), "words")
    pairs = materialize(near_pairs(vocabulary, **how), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "n_b", "a", "n_a"))
    told = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    named = vocabulary.join(told.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.near")).alias("form"), F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")).alias("form_n"))
    named = materialize(named, "named")
    roots = materialize(named.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        # Each round doubles how far a root is; a word whose root has none itself is done.
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("_next")).hint("merge"), "root", "left")
        moved = materialize(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return named.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
