"""Document fingerprints by randomised edit embedding.

A shared random function says, for each step and character, whether a walk over the text stays or moves on; the symbols
it stands on are the embedding. Walks over texts of small edit distance meet again after each edit, so that edit distance
becomes Hamming distance of embeddings. The walk covers the whole text. A fingerprint keeps a bit sample of the embedding:
the steps that a shared hash picks, at the rate (a power of two) that leaves 128 to 256 of them, each as four bits of the
symbol. A step picked at a low rate is picked at every higher one, so that texts of any lengths can be compared on the
steps both kept. Two independent walks make a fingerprint; the likeness is the better walk's share of equal samples among
the steps that either walk reached, less the share that unrelated texts have by chance.

`digest` also fingerprints each text with its latter half replaced by the beginning of the next document: rows are
range-partitioned by doc_id once, and each partition streams its rows with one row of look-ahead; only the partitions'
edges (a row each) are completed by a join. `near_classes` bands fingerprints into shared keys, verifies candidates and
gives each document its class; `near_pairs` lists the verified pairs of texts themselves.

Defined cases: a null or empty text has the empty fingerprint's string (level and no samples), like only to itself
(likeness 1 to an empty one, 0 to any other). Rows of equal doc_id follow a hash of their text; null doc_ids come first. A
single row is its own next. Very long texts are walked whole. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, components, materialize, mix64

#: Walks, random table's period in steps, samples at least, and how often unrelated samples agree.
WALKS, PERIOD, SAMPLES, CHANCE = 2, 4093, 128, 0.13
#: Code points of texts that are walked side by side.
SIDE_BY_SIDE = 4_000_000
#: Fingerprints of one part of a band, about.
PART = 512

_U = np.uint64
#: Moves[walk][step, character class]; class 0 stands for the text's end, where the walk stays.
_MOVES = [(mix64(np.arange(PERIOD * 256, dtype=np.uint64) + _U(1 + k * PERIOD * 256)) >> _U(63)).astype(np.int64).reshape(PERIOD, 256) for k in range(WALKS)]
for _m in _MOVES:
    _m[:, 0] = 0


def _levels(n: int) -> np.ndarray:
    """For each step, the lowest rate (as a power of one half) at which it is still picked."""
    if len(_picked[0]) < n:
        h = mix64(np.arange(max(n, 1 << 16), dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(5))
        low = h & (~h + _U(1))
        _picked[0] = np.where(h == 0, 63, np.log2(low.astype(np.float64))).astype(np.uint8)
    return _picked[0][:n]


_picked = [np.zeros(0, np.uint8)]


def level_of(n_chars: int) -> int:
    """The sampling rate for a text: its about 2 n steps leave SAMPLES to 2 * SAMPLES."""
    return max(0, (2 * n_chars // SAMPLES).bit_length() - 1)


def _classes(text: str) -> np.ndarray:
    """A code point's class hangs on that code point alone, so that an edit anywhere leaves the others' classes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points > 255, 1 + points % 255, np.maximum(points, 1)).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of whole texts, walked side by side in groups of like length."""
    out = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lo = 0
    while lo < len(order):
        hi, size = lo, 0
        while hi < len(order) and (hi == lo or size + len(texts[order[hi]]) <= SIDE_BY_SIDE):
            size += len(texts[order[hi]])
            hi += 1
        for i, f in zip(order[lo:hi], _walked([texts[i] for i in order[lo:hi]])):
            out[i] = f
        lo = hi
    return out


def _walked(texts: list[str]) -> list[str]:
    """Texts by falling length: step after step for all that have not ended."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.zeros(int(sizes.sum()) + len(texts), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for s, t in zip(starts, texts):
        flat[s : s + len(t)] = _classes(t)
    levels = np.array([level_of(len(t)) for t in texts])
    symbol = (mix64(np.arange(256, dtype=np.uint64) + _U(77)) % _U(15)).astype(np.uint8) + 1
    bodies = []
    for moves in _MOVES:
        at, alive, step = starts.copy(), len(texts), 0
        # Every 256 steps, walks at their end stop; they stand on class 0 until then.
        kept_steps, kept = [], []
        pick = _levels(4 * int(sizes[0]) + 4096)
        fewest = int(levels.min()) if len(levels) else 0
        where = np.arange(len(texts))
        while alive:
            for _ in range(256):
                c = flat.take(at)
                if pick[step] >= fewest:
                    kept_steps.append(step)
                    kept.append((where, c))
                at = at + moves[step % PERIOD].take(c)
                step += 1
                if step + 256 >= len(pick):
                    pick = _levels(2 * len(pick))
            on = flat.take(at) > 0
            if not on.all():
                at, where = at[on], where[on]
                levels_left = levels[where]
                fewest = int(levels_left.min()) if len(levels_left) else 0
                alive = len(at)
        rows: list[list] = [[] for _ in texts]
        if kept:
            steps = np.repeat(np.array(kept_steps), [len(w) for w, _ in kept])
            who = np.concatenate([w for w, _ in kept])
            c = np.concatenate([x for _, x in kept])
            ok = (c > 0) & (pick[steps] >= levels[who])
            who, c = who[ok], c[ok]
            by = np.argsort(who, kind="stable")
            digits = symbol[c[by]]
            cut = np.searchsorted(who[by], np.arange(len(texts) + 1))
            rows = [digits[cut[i] : cut[i + 1]] for i in range(len(texts))]
        bodies.append(["".join(map("0123456789abcdef".__getitem__, r)) if len(r) else "" for r in rows])
    return [f"{lv:02x}:" + ":".join(body[i] for body in bodies) for i, lv in enumerate(levels.tolist())]


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    la, *xs = a.split(":")
    lb, *ys = b.split(":")
    level, best = max(int(la, 16), int(lb, 16)), 0.0
    for x, y in zip(xs, ys):
        x, y = _at_level(x, int(la, 16), level), _at_level(y, int(lb, 16), level)
        n = min(len(x), len(y))
        most = max(len(x), len(y))
        if most:
            same = np.count_nonzero(x[:n] == y[:n]) / most
            best = max(best, (same - CHANCE) / (1 - CHANCE))
    return float(min(1.0, max(0.0, best)))


def _at_level(samples: str, own: int, level: int) -> np.ndarray:
    """The samples of the steps that the lower rate picks too."""
    x = np.frombuffer(samples.encode(), np.uint8)
    if own == level or not len(x):
        return x
    n = len(x) << (own + 1)
    while True:
        picked = _levels(n)
        steps = np.flatnonzero(picked >= own)
        if len(steps) >= len(x):
            return x[picked[steps[: len(x)]] >= level]
        n *= 2


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], nexts: list[str]) -> list[pa.Array]:
    """The result's columns for texts whose next texts are known."""
    changed = [edited(t, x) for t, x in zip(texts, nexts)]
    fresh = [i for i, x in enumerate(nexts) if i + 1 == len(texts) or x is not texts[i + 1]]
    prints = fingerprints([*texts, *changed, *(nexts[i] for i in fresh)])
    own, other, late = prints[: len(texts)], prints[len(texts) : 2 * len(texts)], dict(zip(fresh, prints[2 * len(texts) :]))
    following = [late[i] if i in late else own[i + 1] for i in range(len(texts))]
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(own, pa.string()), pa.array(other, pa.string()), pa.array(list(map(likeness, own, other)), pa.float64()), pa.array(list(map(likeness, own, following)), pa.float64()),
    ]


def digest(docs: DataFrame, batch_chars: int = 8_000_000) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[pa.Array], edge: str | None, text: str | None) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())], [*RESULT, "edge", "edge_text"])

        def edge(doc, text: str, kind: str) -> pa.RecordBatch:
            return out([pa.array([doc], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], kind, text)

        ids, texts, size, started = [], [], 0, False
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                texts.append(t or "")
                size += len(texts[-1])
                if not started:
                    started = True
                    yield edge(d, texts[0], "first")
                if size >= batch_chars and len(texts) > 1:
                    yield out(_rows(ids[:-1], texts[:-1], texts[1:]), None, None)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if ids:
            if len(ids) > 1:
                yield out(_rows(ids[:-1], texts[:-1], texts[1:]), None, None)
            yield edge(ids[-1], texts[-1], "last")

    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(arrow_map(ordered, run, f"{_RESULT}, edge string, edge_text string").withColumn("partition", F.spark_partition_id()), "fingerprints")
    # A first and a last row for each partition; the partitions' order names each last row's next.
    firsts = rows.where("edge = 'first'").select("partition", F.col("edge_text").alias("next_text"))
    lasts = rows.where("edge = 'last'").select("partition", "doc_id", F.col("edge_text").alias("text"))
    end = firsts.agg(F.max("partition")).first()[0]
    chain = firsts.select("partition", F.coalesce(F.lag("partition").over(Window.orderBy("partition")), F.lit(end)).alias("before"))
    after = firsts.join(chain, "partition").select(F.col("before").alias("partition"), "next_text")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(_rows(*(b.column(i).to_pylist() for i in range(3))), RESULT)

    return rows.where("edge is null").select(*RESULT).union(arrow_map(lasts.join(after, "partition").select("doc_id", "text", "next_text"), complete, _RESULT))


def band_rows(prints: DataFrame, width: int = 6) -> DataFrame:
    """(doc_id, level, place, key): for each level from the fingerprint's own to the next, the walks' samples in bands of `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, *bodies = f.split(":")
                for level in (int(own, 16), int(own, 16) + 1):
                    for k, body in enumerate(bodies):
                        x = _at_level(body, int(own, 16), level).tobytes().decode()
                        out += [(d, level, k * 4096 + i, x[i : i + width]) for i in range(0, len(x) - width + 1, width)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "level", "place", "key"])

    return arrow_map(prints.select("doc_id", "fingerprint"), run, "doc_id long, level int, place int, key string").distinct()


def _compared(prints: list[str], level: int, apart: np.ndarray, least: float, few: int | None = None) -> Iterator[tuple[int, int, float]]:
    """(i, j, likeness) from `least` on, i < j (i < few, where that is given), for fingerprints that meet in a band of this level; only those of different numbers in `apart`."""
    own = np.array([int(f[:2], 16) for f in prints])
    # Two texts of the level below are compared by all the samples they have, as likeness does.
    for at in (level - 1, level):
        here = np.flatnonzero((own <= at) & (own >= level - 1))
        if len(here) < 2:
            continue
        walks = []
        for k in range(WALKS):
            xs = [_at_level(prints[i].split(":")[1 + k], own[i], at) for i in here.tolist()]
            sizes = np.array([len(x) for x in xs])
            samples = np.zeros((len(xs), max(1, int(sizes.max()))), np.uint8)
            for row, x in zip(samples, xs):
                row[: len(x)] = x
            walks.append((samples, sizes))
        for p in range(len(here) - 1 if few is None else min(len(here) - 1, int(np.searchsorted(here, few)))):
            best = np.zeros(len(here) - 1 - p)
            for samples, sizes in walks:
                most = np.maximum(sizes[p + 1 :], sizes[p])
                # Beyond the longer one both rows hold zeros, which are no samples.
                same = np.count_nonzero(samples[p + 1 :] == samples[p], axis=1) - (samples.shape[1] - most)
                best = np.maximum(best, (same / np.maximum(most, 1) - CHANCE) / (1 - CHANCE))
            met = (best >= least) & (np.maximum(own[here[p + 1 :]], own[here[p]]) == at) & (apart[here[p + 1 :]] != apart[here[p]])
            for q in np.flatnonzero(met).tolist():
                yield int(here[p]), int(here[p + 1 + q]), float(min(1.0, best[q]))


def near_pairs(prints: DataFrame, least: float = 0.8, width: int = 6, part: int = PART) -> DataFrame:
    """Pairs (a, b, likeness), a < b, from `least` on: all documents that share a band, each two of them verified.

    Equal fingerprints are one class beforehand, which the smallest doc_id stands for. A band is dealt into parts of about
    `part` documents, and each part is compared with itself and with every other one, so that no task holds more than two
    parts. The work of a band that m different fingerprints share grows with m * m, and a group of n near ones gives up to
    n * (n - 1) / 2 rows. A doc_id of several texts is judged by the nearest of them, and is no pair with itself.
    """
    band = ["level", "place", "key"]
    classes = materialize(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "classes")
    bands = materialize(band_rows(classes, width), "bands")
    # Written, so that a hot band's side of the join can be split.
    shared = materialize(bands.groupBy(*band).agg(F.count("*").alias("n")).where("n > 1"), "shared")
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = bands.join(shared, band).select(*band, "doc_id", F.pmod(F.xxhash64("doc_id", "place"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cell = [*band, "low", "high"]
    held = dealt.join(classes, "doc_id").select(*band, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "doc_id", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, float]] = []

        def compare(at: tuple, rows: list[tuple]) -> None:
            numbers = np.array([r[0] for r in rows]) if at[3] < at[4] else np.arange(len(rows))
            found.extend((min(x, y), max(x, y), near) for i, j, near in _compared([r[2] for r in rows], at[0], numbers, least) if (x := rows[i][1]) != (y := rows[j][1]))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "likeness"])

        at, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:5] != at:
                    if len(rows) > 1:
                        compare(at, rows)
                    at, rows = r[:5], []
                    if len(found) >= 10_000:
                        yield out()
                        found.clear()
                rows.append(r[5:])
        if len(rows) > 1:
            compare(at, rows)
        yield out()

    # Bands of one pair name it again and again; each is kept once.
    return arrow_map(held.repartition(*cell).sortWithinPartitions(*cell), run, "a long, b long, likeness double").groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def prints_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fingerprint) of every whole text; mark: 16 bytes that stand for the fingerprint."""

    def out(ids: list, texts: list[str]) -> pa.RecordBatch:
        prints = fingerprints(texts)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([hashlib.md5(f.encode()).digest() for f in prints], pa.binary()), pa.array(prints, pa.string())], ["doc_id", "mark", "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The more texts are walked side by side, the cheaper a step is.
        ids, texts, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= SIDE_BY_SIDE:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield out(ids, texts)

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, mark binary, fingerprint string")


#: Samples of a band (by reckoning CHANCE ** WIDTH of unlike pairs meet in one), and every how many samples one begins.
WIDTH, STRIDE = 10, 16
#: Members of a crowded band that one task compares with a part of its loose ones, about, and how many of them it holds at a time.
CROWD, HELD = 32_768, 4_096
#: From so many samples on a text may be near one of the next level, whose texts have 2 * SAMPLES at its own rate or more.
ALMOST = int(1.4 * SAMPLES)


def _band_keys(x: np.ndarray, spots: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the bands of `width` samples that begin at these places, the end followed by the beginning."""
    h = mix64(spots.astype(np.uint64) + _U(width << 32))
    for j in range(min(width, len(x))):
        h = mix64(h ^ x[(begins + j) % len(x)].astype(np.uint64))
    return h.astype(np.int64)


_BANDS = "key long, spot int, name long"


def _first_bands(prints: DataFrame) -> DataFrame:
    """(key, spot, name): the bands of prints (name, fingerprint) at their own sampling level, and at the next if they almost reach it. spot: level, walk and number of a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, names = [], [], []
            for name, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, *bodies = f.split(":")
                for level in range(int(own, 16), int(own, 16) + 1 + (max(map(len, bodies)) >= ALMOST)):
                    for k, body in enumerate(bodies):
                        x = _at_level(body, int(own, 16), level)
                        begins = np.arange(0, len(x) - WIDTH + 1, STRIDE) if len(x) >= WIDTH else np.zeros(min(1, len(x)), np.int64)
                        spots = (level * WALKS + k) * 4096 + begins // STRIDE
                        keys.append(_band_keys(x, spots, begins, WIDTH) if len(begins) else np.zeros(0, np.int64))
                        places.append(spots)
                        names += [name] * len(begins)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int32()), pa.array(names, pa.int64())], ["key", "spot", "name"])

    return arrow_map(prints, run, _BANDS)


def _verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose fingerprints have a likeness from `least` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(f, g) >= least for f, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, other = prints.select(F.col("name").alias("a"), F.col("fingerprint").alias("f")), prints.select(F.col("name").alias("b"), F.col("fingerprint").alias("g"))
    return arrow_map(pairs.join(one, "a").join(other, "b").select("a", "b", "f", "g"), run, "a long, b long")


def _crowded_links(loose: DataFrame, met: DataFrame, prints: DataFrame, least: float, part: int, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: the members of crowded bands that are near one of their band's loose ones, every two of them compared.

    loose, met: key, level, name, n (members of the band). A band's loose ones are dealt into parts of about `part`, its
    members into crowds, and a task compares a part with a crowd: it holds the part and streams the crowd. The work grows
    with loose ones times members, the rows that are moved with that by the part's size.
    """
    band = ["key", "level"]
    sizes = loose.groupBy(*band).agg(F.count("*").alias("loose"), F.first("n").alias("n"))
    sizes = sizes.select(*band, F.ceil(F.col("loose") / part).cast("int").alias("parts"), F.ceil(F.col("n") / crowd).cast("int").alias("crowds"))
    deal = lambda of: F.pmod(F.xxhash64("name"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = loose.select(*band, "name").join(sizes, band).select(*band, deal("parts").alias("part"), every("crowds").alias("crowd"), F.lit(0).alias("side"), "name")
    streamed = met.select(*band, "name").join(sizes, band).select(*band, every("parts").alias("part"), deal("crowds").alias("crowd"), F.lit(1).alias("side"), "name")
    cell = [*band, "part", "crowd"]
    dealt = held.union(streamed).join(prints.select("name", "fingerprint"), "name").select(*cell, "side", "name", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, few, crowd = None, [], []

        def compare() -> pa.RecordBatch:
            rows = few + crowd
            apart = np.repeat([0, 1], [len(few), len(crowd)])
            found = {(min(x, y), max(x, y)) for i, j, _ in _compared([f for _, f in rows], at[1], apart, least, len(few)) if (x := rows[i][0]) != (y := rows[j][0])}
            crowd.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

        for b in batches:
            for *now, side, name, f in zip(*(c.to_pylist() for c in b.columns)):
                if now != at:
                    if crowd:
                        yield compare()
                    at, few = now, []
                if side:
                    crowd.append((name, f))
                    if len(crowd) >= HELD:
                        yield compare()
                else:
                    few.append((name, f))
        if crowd:
            yield compare()

    return arrow_map(dealt.repartition(*cell).sortWithinPartitions(*cell, "side"), run, "a long, b long").distinct()


def near_classes(docs: DataFrame, least: float = 0.8, part: int = PART) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the smallest doc_id that is reached by likenesses from `least` on, its own included.

    Equal fingerprints are one node. In every band, of any size, each member is verified against the band's first one: near
    copies end there, in time linear in their number. Those that are not near the first, the loose ones, are verified
    against all others of their band, in any band of any size; where it has more than `part` members (a passage that many
    documents share at one place), they are dealt into parts for that. So no two that share a band are passed over, and a
    crowded band's work grows with its loose ones times its members. Every link is verified, so classes hold no chance
    hits; the share of links found is measured in the tests.

    Null or empty texts are one class. Rows of null doc_id are linked as others are; a class without any doc_id has a null
    one. Repeated doc_ids are judged by their own texts. An empty table gives no rows. Extra columns are not read.
    """
    known = materialize(prints_of(docs), "prints")
    # Numbers are given as the nodes are written, and only read from there.
    prints = materialize(known.groupBy("mark").agg(F.first("fingerprint").alias("fingerprint")).withColumn("name", F.monotonically_increasing_id()), "nodes")
    bands = materialize(_first_bands(prints.select("name", "fingerprint")), "bands")
    first = bands.groupBy("key").agg(F.min("name").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = materialize(bands.select("key", F.floor(F.col("spot") / (4096 * WALKS)).cast("int").alias("level"), "name").join(first, "key").where("name <> first"), "met")
    near = materialize(_verified(met.select(F.col("first").alias("a"), F.col("name").alias("b")).distinct(), prints, least), "near")
    loose = materialize(met.join(near.select(F.col("a").alias("first"), F.col("b").alias("name")), ["first", "name"], "left_anti"), "loose")
    # The band's first was looked at; `met` holds all others.
    pairs = loose.where(F.col("n") <= part).select("key", F.col("name").alias("x")).join(met.select("key", F.col("name").alias("y")), "key").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    few = materialize(_verified(pairs, prints, least), "near")
    crowded = materialize(_crowded_links(loose.where(F.col("n") > part), met, prints, least, part), "near")
    joined = components(near.union(few).union(crowded).distinct()).select(F.col("node").alias("name"), "component")
    homes = prints.select("mark", "name").join(joined, "name", "left").select("mark", F.coalesce("component", "name").alias("component"))
    placed = materialize(known.select("doc_id", "mark").join(homes, "mark").select("doc_id", "component"), "placed")
    return placed.join(placed.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("doc_id", "class_id")
