"""N-gram Jaccard self-join by signature trees.

A document is its set of distinct word n-grams; two link when their Jaccard similarity reaches a bound. The work:

1. A scan counts grams in 2^22 cells of their hashes, which gives all grams one order: those of ordinary cells first, those
   of crowded cells (passages that many documents share) last. Cells are fine, so that a passage of some dozen documents
   stands out of a large corpus too.
2. A second scan gives each text its set's size, a 128-bit key of the set, its prefix and its token bitmap. The prefix is
   the set's first size - ceil(bound * size) + 1 grams in that order: two sets that reach the bound have at least one gram
   of their prefixes in common, whatever the order is, so that no link is missed. Equal sets form one class with a number
   of its own, which one row stands for; copies go no further. Ids of documents play no part until step 5.
3. Classes that share a prefix gram are a node of sets, named by its smallest class, and fall into size ranges (a factor of
   two; a set near the upper end is also a guest of the next), so that linked sets meet in one range. Over each node's
   range a signature tree is built: a leaf is a set's bitmap, an inner node holds the OR (and AND) of its children's bitmaps
   and the range of their sizes. The tree is traversed against itself; a pair of nodes is pruned when the largest overlap
   that bitmaps and sizes allow is too small. Sets that no pair is left for go no further.
4. The texts of the sets that are left are read once more, and in each node the leaf pairs are compared exactly, unless
   their sets are linked already. A node of more sets than `part` is dealt into parts; sets that their part doesn't tie to
   the node's first class are compared with the other parts too, by the same trees, so that no link between parts is lost.
5. The links' connected components, spread to the members of each class.

Defined cases: null or empty texts (and texts of white space) have empty sets and link with nothing, not even each
other. Texts of fewer words than n have their whole sequence as their one gram. Repeated rows of a doc_id stay repeated
rows of the result and each row is judged by its own text; a null doc_id takes the component of its group (null when no
row of the group has a doc_id). Ties do not matter: similarity is compared in integers. Extra columns are not read. Grams are
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, arrow_map, components, gram_sets, materialize, mix64, sieve, slices, utf8

#: Cells that grams are counted in, as a power of two; counts that a task hands on, at most (its largest).
CELLS, COUNTS = 22, 1 << 18
#: Sets of one part of a node, at most.
PART = 512
#: Children of a tree's node.
FANOUT = 8
#: Bytes of bitmaps that are compared at once.
AT_ONCE = 1 << 23

_A = mix64(np.arange(1, 3, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS)).astype(np.int64)


def crowding(docs: DataFrame, n: int) -> np.ndarray:
    """For each cell how many times the mean it holds, as a power of two: a table of one size whatever the corpus.

    The result of the join does not hang on it, only how few sets meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int32)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                np.add.at(total, _cell(gram_sets(data, offsets[lo : hi + 1], n)[0]), 1)
        some = np.flatnonzero(total)
        every = int(total.sum(dtype=np.int64))
        if len(some) > COUNTS:
            some = some[np.argpartition(total[some], -COUNTS)[-COUNTS:]]
        # All that the task counted, under a number that is no cell.
        cells, counts = np.append(some, -1).astype(np.int32), np.append(total[some].astype(np.int64), every)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], ["cell", "n"])

    counted = materialize(arrow_map(docs.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    mean = (counted.where("cell < 0").agg(F.sum("n")).first()[0] or 0) / (1 << CELLS)
    crowded = counted.where((F.col("cell") >= 0) & (F.col("n") >= max(2, 2 * mean))).select("cell", F.floor(F.log2(F.col("n") / mean)).cast("int").alias("level")).toArrow()
    out = np.zeros(1 << CELLS, np.uint8)
    out[crowded.column("cell").to_numpy()] = crowded.column("level").to_numpy()
    return out


def _range(size: np.ndarray) -> np.ndarray:
    """The number of a size's range: its binary logarithm, whole."""
    return np.frexp(size.astype(np.float64))[1] - 1


def _bits(band: int) -> int:
    """Bits of the bitmaps of a size range: one to two for each gram, enough to tell strangers apart."""
    return 1 << max(7, band + 1)


def _bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _folded(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap that the same set has in fewer bits."""
    while len(bitmap) * 64 > bits:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


SETS = "doc_id long, row_hash long, n_shingles long, key1 long, key2 long, bands array<int>, prefix array<long>, bitmap binary"


def set_rows(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """SETS for each row of docs. Two scans, no shuffle of text."""
    levels = crowding(docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                h, at = gram_sets(data, offsets[lo : hi + 1], n)
                size = np.diff(at)
                keys = np.zeros((2, hi - lo), np.uint64)
                if len(some := np.flatnonzero(size)):
                    for k, a in enumerate(_A):
                        keys[k, some] = mix64(np.add.reduceat(mix64(h * a), at[:-1][some]))
                owner = np.repeat(np.arange(hi - lo), size)
                order = np.lexsort((h, levels[_cell(h)], owner))
                length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                inside = np.arange(len(h)) - np.repeat(at[:-1], size) < np.repeat(length, size)
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(h[order][inside].view(np.int64)))
                low, high = _range(np.maximum(size, 1)), _range(np.maximum(size * 100 // percent, 1))
                bands = [list(range(a, b + 1)) if s else [] for a, b, s in zip(low.tolist(), high.tolist(), size.tolist())]
                maps = [_bitmap(h[at[i] : at[i + 1]], _bits(b[-1])).tobytes() if b else None for i, b in enumerate(bands)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(2)), pa.array(size.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(bands, pa.list_(pa.int32())), prefix, pa.array(maps, pa.binary())], ["doc_id", "row_hash", "n_shingles", "key1", "key2", "bands", "prefix", "bitmap"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text"), run, SETS)


class Tree:
    """A signature tree over bitmaps and sizes, as levels of nodes; level 0 holds the sets themselves."""

    def __init__(self, own: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        self.levels = [(own, own, sizes, sizes)]
        while n > 1:
            cut = np.arange(0, n, FANOUT)
            any_, all_, lo, hi = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(any_, cut), np.bitwise_and.reduceat(all_, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))
            n = len(cut)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def _allowed(tree: Tree, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For node pairs of one level: whether the largest overlap that bitmaps and sizes allow reaches the bound."""
    any_, all_, lo, hi = tree.levels[level]
    # Each bit that all sets of one node have and none of the other has is a gram outside the overlap.
    most = np.minimum(hi[a] - _count(all_[a] & ~any_[b]), hi[b] - _count(all_[b] & ~any_[a]))
    most = np.minimum(most, np.minimum(hi[a], hi[b]))
    # overlap >= p / (100 + p) * (size + size); the smaller sizes give the weakest demand, and the overlap bounds both.
    return (100 + percent) * most >= percent * (lo[a] + lo[b])


def _possible(tree: Tree, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """_allowed, a bounded number of pairs at a time."""
    step = max(1, AT_ONCE // (8 * tree.levels[0][0].shape[1]))
    return np.concatenate([np.zeros(0, bool), *(_allowed(tree, level, a[k : k + step], b[k : k + step], percent) for k in range(0, len(a), step))])


def traverse(tree: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The tree against itself: pairs of sets whose nodes are left, and how many node pairs were pruned on the way."""
    a = b = np.zeros(1, np.int64)
    pruned = 0
    for level in range(len(tree.levels) - 1, 0, -1):
        ok = _possible(tree, level, a, b, percent)
        pruned += len(ok) - int(np.count_nonzero(ok))
        a, b = a[ok], b[ok]
        below = len(tree.levels[level - 1][2])
        step = np.arange(FANOUT)
        x = (a[:, None, None] * FANOUT + step[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
        y = (b[:, None, None] * FANOUT + step[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
        ok = (x <= y) & (x < below) & (y < below)
        a, b = x[ok], y[ok]
    return a[a < b], b[a < b], pruned


def left_over(bitmaps: list[np.ndarray], sizes: np.ndarray, percent: int, node: int, nodes: list[list[int]]) -> tuple[np.ndarray, int]:
    """Which sets of a node (in one size range) may link with another there, by bitmaps and sizes alone; and pairs pruned.

    nodes: all nodes of each set. A pair that meets in several counts in the first of these only.
    """
    # Most alike sets beside each other, so that their common nodes' bitmaps are tight.
    order = sorted(range(len(sizes)), key=lambda i: (int(bitmaps[i][0]), int(sizes[i])))
    tree = Tree(np.stack([bitmaps[i] for i in order]), sizes[order])
    a, b, pruned = traverse(tree, percent)
    ok = _possible(tree, 0, a, b, percent)
    out = np.zeros(len(sizes), bool)
    earlier = [{x for x in own if x < node} for own in nodes]
    for i, j in zip(a[ok].tolist(), b[ok].tolist()):
        i, j = order[i], order[j]
        if not (out[i] and out[j]) and earlier[i].isdisjoint(earlier[j]):
            out[i] = out[j] = True
    return out, pruned + len(ok) - int(np.count_nonzero(ok))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def tree_links(sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: pairs of their numbers. apart: only sets of different numbers there are compared."""
    n = len(sets)
    if n < 2:
        return []
    order = sorted(range(n), key=lambda i: (int((sets[i] * _A[0]).min()), int((sets[i] * _A[1]).min()), len(sets[i])))
    own = [sets[i] for i in order]
    group = None if apart is None else apart[order]
    bits = min(1 << max(7, int(np.median([len(s) for s in own]) * 2).bit_length()), 1 << 16)
    tree = Tree(np.stack([_bitmap(s, bits) for s in own]), np.array([len(s) for s in own], np.int64))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    a, b, _ = traverse(tree, percent)
    if group is not None:
        ok = group[a] != group[b]
        a, b = a[ok], b[ok]
    # Nearest neighbours in the order come first: they tie most of a group of copies, and tied pairs need no comparison.
    first = np.argsort(b - a, kind="stable")
    for lo in range(0, len(first), 4096):
        x, y = a[first[lo : lo + 4096]], b[first[lo : lo + 4096]]
        roots = np.fromiter(map(root, range(n)), np.int64, n)
        ok = roots[x] != roots[y]
        x, y = x[ok], y[ok]
        ok = _possible(tree, 0, x, y, percent)
        for i, j in zip(x[ok].tolist(), y[ok].tolist()):
            if (ri := root(i)) != (rj := root(j)):
                both = _overlap(own[i], own[j])
                if 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                    parent[ri] = rj
                    found.append((order[i], order[j]))
    return found


def representatives(rows: DataFrame) -> DataFrame:
    """One row for each class of equal sets: cls (its name here, a number), its smallest doc_id (null last) with that row's hash, and SETS' other columns.

    Sets that are alone in their class are not shuffled; copies are combined before they are. The names are given once, as
    the result is written.
    """
    keys = ["key1", "key2", "n_shingles"]
    some = rows.where("n_shingles > 0")
    copied = materialize(some.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select("key1"), "classes")
    touched, others = sieve(some, F.col("key1"), copied, "key1")
    of_set = ["bands", "prefix", "bitmap"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("_first")
    one = touched.groupBy(*keys).agg(least, *(F.first(c).alias(c) for c in of_set))
    every = one.select("_first.doc_id", "_first.row_hash", *keys, *of_set).union(others.select("doc_id", "row_hash", *keys, *of_set))
    return materialize(every.withColumn("cls", F.monotonically_increasing_id()), "representatives")


def members(rows: DataFrame) -> DataFrame:
    """(cls, node, band): classes that share a prefix gram with another, by node (its smallest class) and size range."""
    grams = rows.select("cls", F.explode("prefix").alias("gram"))
    heads = grams.groupBy("gram").agg(F.min("cls").alias("node"), F.max("cls").alias("last"), F.count("*").alias("n")).where("node < last")
    heads = materialize(heads, "heads")
    # A gram of two classes names both; only those of more are looked up in the rows.
    two = heads.where("n = 2").select("node", F.explode(F.array("node", "last")).alias("cls"))
    more = heads.where("n > 2").select("gram", "node")
    touched, _ = sieve(grams, F.col("gram"), more, "gram")
    found = two.union(touched.join(more.hint("merge"), "gram").select("node", "cls")).distinct()
    return found.join(rows.select("cls", F.explode("bands").alias("band")).distinct().hint("merge"), "cls")


def candidates(rows: DataFrame, percent: int, part: int) -> DataFrame:
    """(cls, node, band, head, parts): members that a signature tree leaves, in nodes of one part, and all members of larger nodes."""
    member = materialize(members(rows), "members")
    sizes = materialize(member.groupBy("node", "band").agg(F.count("*").alias("n"), F.min("cls").alias("head")).where("n > 1"), "nodes")
    placed = member.join(sizes.hint("merge"), ["node", "band"]).select("cls", "node", "band", "head", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    placed = materialize(placed, "placed")
    lists = placed.groupBy("cls", "band").agg(F.collect_set("node").alias("nodes"))
    told = placed.where("parts = 1").join(lists.hint("merge"), ["cls", "band"]).join(rows.select("cls", "n_shingles", "bitmap").hint("merge"), "cls").select("node", "band", "cls", "head", "n_shingles", "bitmap", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(node: int, band: int, own: list) -> pa.RecordBatch:
            bits = _bits(band)
            stay, _ = left_over([_folded(np.frombuffer(r[4], np.uint64), bits) for r in own], np.array([r[3] for r in own], np.int64), percent, node, [r[5] for r in own])
            kept = [r for r, s in zip(own, stay) if s]
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in kept], pa.int64()), pa.array([node] * len(kept), pa.int64()), pa.array([band] * len(kept), pa.int32()), pa.array([r[2] for r in kept], pa.int64()), pa.array([1] * len(kept), pa.int32())], ["cls", "node", "band", "head", "parts"])

        key, own = None, []
        # Rows become Python values a few at a time: with their bitmaps and nodes, those of a whole batch weigh many times the batch.
        for node, *r in (r for b in batches for lo in range(0, len(b), 256) for r in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns))):
            if key != (node, r[0]):
                if len(own) > 1:
                    yield judge(*key, own)
                key, own = (node, r[0]), []
            if not own or own[-1][1] != r[1]:
                own.append(r)
        if len(own) > 1:
            yield judge(*key, own)

    walk = told.repartition("node", "band").sortWithinPartitions("node", "band", "cls")
    left = arrow_map(walk, run, "cls long, node long, band int, head long, parts int")
    return materialize(left.union(placed.where("parts > 1")), "candidates")


def _row_name() -> list:
    """A row's doc_id and text hash as join keys without nulls."""
    return [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("row_hash")]


def _sets(placed: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """placed (cls, ...) with the class's set as binary: the texts of the classes that are left travel once, one text for each class."""
    ids = classes.join(placed.select("cls").distinct().hint("merge"), "cls").select("cls", "doc_id", "row_hash")
    ids = materialize(ids.select("cls", *_row_name(), F.xxhash64("doc_id", "row_hash").alias("h")), "ids")
    named = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row_hash"))
    touched, _ = sieve(named, F.xxhash64("doc_id", "row_hash"), ids, "h")
    once = touched.select(*_row_name(), "text").dropDuplicates(["_id", "_none", "row_hash"])
    # Shuffled at any size: the plan must not hang on whether the members of a small corpus would fit a broadcast.
    texts = once.join(ids.hint("merge"), ["_id", "_none", "row_hash"]).select("cls", "text")
    both = placed.hint("merge").join(texts, "cls").select(*placed.columns, "text")
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(names)))
            for lo, hi in slices(offsets):
                h, at = gram_sets(data, offsets[lo : hi + 1], n)
                own = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(names))), own], [*names, "grams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    return arrow_map(both, run, f"{kinds}, grams binary")


def links(docs: DataFrame, classes: DataFrame, n: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """Links (a, b) between classes (cls of representatives()) that span the same components as all links do."""
    placed = candidates(classes, percent, part)
    # A node's first class goes to each of its parts.
    dealt = placed.withColumn("part", F.explode(F.when(F.col("cls") == F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls", "node"), F.col("parts")).cast("int")))))
    held = materialize(_sets(dealt, classes, docs, n), "sets")

    def first(batches: pa.Table) -> pa.Table:
        return _part_links(batches, percent)

    schema = "a long, b long, node long, band int, part int, loose boolean"
    one = materialize(arrow_groups(held, ["node", "band", "part"], first, schema), "links")
    found = one.where("not loose").select("a", "b")
    # Sets of divided nodes that their part doesn't tie to the node's first class, against the node's other parts.
    loose = one.where("loose").select(F.col("a").alias("cls"), "node", "band", "part")
    if loose.isEmpty():
        return found
    homes = held.where("parts > 1 and cls <> head").select("node", "band", "part", "cls", "parts", "grams")
    probe = homes.join(loose, ["cls", "node", "band", "part"])
    sent = probe.select("node", "band", "cls", "grams", F.col("part").alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where("part <> share")
    kept = sent.select("node", "band", "part", "share").distinct()
    cell = ["node", "band", "part", "share"]
    met = sent.select(*cell, "cls", "grams", F.lit(True).alias("probe")).union(homes.join(kept, ["node", "band", "part"]).select(*cell, "cls", "grams", F.lit(False)))

    def second(batches: pa.Table) -> pa.Table:
        ids = batches.column("cls").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in batches.column("grams").to_pylist()]
        got = tree_links(sets, percent, np.array(batches.column("probe").to_pylist()))
        return pa.table({"a": pa.array([ids[i] for i, _ in got], pa.int64()), "b": pa.array([ids[j] for _, j in got], pa.int64())})

    return found.union(arrow_groups(met, cell, second, "a long, b long"))


def _part_links(rows: pa.Table, percent: int) -> pa.Table:
    ids = rows.column("cls").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    node, band, head, part, parts = (rows.column(c)[0].as_py() for c in ("node", "band", "head", "part", "parts"))
    got = tree_links(sets, percent)
    out = [(ids[i], ids[j], False) for i, j in got]
    if parts > 1:
        to = {x: x for x in ids}

        def root(x: int) -> int:
            while to[x] != x:
                x = to[x]
            return x

        for a, b, _ in out:
            to[root(a)] = root(b)
        home = root(head)
        out += [(x, x, True) for x in ids if root(x) != home]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "node": pa.array([node] * len(out), pa.int64()), "band": pa.array([band] * len(out), pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "loose": pa.array([x[2] for x in out], pa.bool_())})


def groups(docs: DataFrame, n: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    return keyed_groups(docs, n, percent, part).select("doc_id", "n_shingles", "component_id")


def keyed_groups(docs: DataFrame, n: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """groups with row_hash (of the text) and the number of the row's group of linked classes (`grp`, null for an empty set)."""
    rows = materialize(set_rows(docs, n, percent), "sets")
    classes = representatives(rows)
    tied = materialize(components(links(docs, classes, n, percent, part)), "tied")
    keys = ["key1", "key2", "n_shingles"]
    named = classes.select("cls", *keys, "doc_id")
    linked = named.join(tied.hint("merge"), F.col("cls") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = tied.join(least.hint("merge"), "component")
    told = named.join(grouped.hint("merge"), F.col("cls") == F.col("node"), "left").select(*keys, F.coalesce("component", "cls").alias("grp"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    bare = rows.select("doc_id", "row_hash", *keys)
    out = ["doc_id", "row_hash", "n_shingles", "grp", "component_id"]
    return bare.where("n_shingles > 0").join(told, keys).select(*out).union(bare.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.lit(None).cast("long"), F.col("doc_id")))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """docs with one row of each group of linked documents: the smallest doc_id's (null last; of its texts the smallest hash's).

    Rows are judged by doc_id and text together: of repeated rows one stays, rows of one doc_id with texts that are near
    nothing all stay, and a row of a null doc_id stays where no other document of its group does. Rows of empty sets are
    linked with nothing and all stay.
    """
    some = materialize(keyed_groups(docs, n, percent, part).where("n_shingles > 0").select("doc_id", "row_hash", "grp"), "grouped")
    first = some.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first"), F.count("*").alias("n")).where("n > 1").select("grp", "first")
    met = some.join(first.hint("merge"), "grp")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash"))
    told = materialize(met.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"), stays.alias("_stays")).groupBy("_doc", "_row").agg(F.max("_stays").alias("_stays")), "told")
    touched, others = sieve(docs, F.xxhash64("text"), told, "_row")
    judged = touched.withColumn("_hash", F.xxhash64("text")).join(told.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_row")), "left")
    alone = judged.where("_stays is null").select(*docs.columns)
    one = judged.where("_stays").dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)
    return alone.union(one).union(others)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
  HAVING 100 * count(*) >= 80 * (na.n_shingles + nb.n_shingles - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n_shingles), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
