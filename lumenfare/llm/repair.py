"""Conversation structure repair: the cheapest edits that make a transcript `(s?(ua)+)?`, decided by integer minima.

Rows are judged in order of turn (nulls first; ties by role, then by the text's digest). A row's fault is the first of:
blank, duplicate (role and text stood before), truncated (no sentence's end). Edits: Keep 0, Rerole to user or assistant 1,
Delete 2 (blank and duplicate rows must go), Insert an empty turn 5; a truncated row that stays adds 5.

A repair is a path through a graph whose nodes are (row, state), with four states: nothing yet, after s, after u, after a.
Each node's best suffix is one integer: high digits are its cost, the low ones its audit letters, three bits each, first
letter highest, in a field of fixed width with zeros behind the last letter. D, I, K and R count 1 to 4, as in ASCII order,
so that the least integer is the cheapest repair and, among equals, the least audit: one letter in front shifts the field,
and `min` decides everything. Rows are taken from the last to the first, in blocks of `block` rows: a block's integers, for
each state it may end in, are as wide as the block, and blocks are chained by the same minimum.

Two sorted walks: the first takes ten bytes a row (no text) and decides; the second hashes the repaired rows as they pass.
What a task holds is one conversation's role letters and faults (a byte a row) and its audit; texts stream.

Defined cases: a null role or text counts as one space, and so does a null conv_id or turn in the key of the damage. Null
conv_ids are one conversation. A conversation whose rows are all dropped, like one whose rows all go, has an empty audit
and the digest of the empty string. Repeated rows are duplicates. Extra columns are not read. No rows, no result rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

#: Rows of a block.
BLOCK = 256
#: Audit letters and their digits.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: States by number: nothing, s, u, a; which states a kept or inserted role leads on from, and to.
FROM = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
_ENDS = (0, 3)
#: What a row's byte says beside its role letter.
_GOES, _CUT = 8, 16


def byte_of(initial: str, goes: bool, cut: bool) -> int:
    return "?sua".index(initial if initial in ("s", "u", "a") else "?") | _GOES * goes | _CUT * cut


class Weights:
    """Integers of a field of `width` letters: cost above, letters below."""

    def __init__(self, width: int):
        self.bits = 3 * width
        self.field = (1 << self.bits) - 1

    def after(self, cost: int, letter: int, weight: int) -> int:
        """weight with one letter in front, and its cost."""
        return (((weight >> self.bits) + cost) << self.bits) | (letter << (self.bits - 3)) | ((weight & self.field) >> 3)

    def letters(self, weight: int) -> str:
        digits = format(weight & self.field, f"0{self.bits // 3}o") if self.bits else ""
        return digits.rstrip("0").translate({ord(str(i + 1)): c for i, c in enumerate(LETTERS)})


def _inserted(w: Weights, best: list[int | None]) -> list[int | None]:
    """The best of each state where turns may be inserted first: two at the most, as a third leads to a state that one has reached."""
    for _ in range(2):
        out = list(best)
        for froms, to in (FROM["u"], FROM["a"]):
            if best[to] is not None:
                for q in froms:
                    some = w.after(5, INSERT, best[to])
                    out[q] = some if out[q] is None else min(out[q], some)
        best = out
    return best


def _edited(w: Weights, row: int, best: list[int | None]) -> list[int | None]:
    """The best of each state before a row, from that of each state behind it."""
    out: list[int | None] = [None if x is None else w.after(2, DELETE, x) for x in best]
    if not row & _GOES:
        late = 5 if row & _CUT else 0
        own = "?sua"[row & 3]
        for role, (froms, to) in FROM.items():
            if best[to] is None:
                continue
            ways = [w.after(late, KEEP, best[to])] if role == own else []
            if role != "s":
                ways.append(w.after(1 + late, REROLE, best[to]))
            if ways:
                least = min(ways)
                for q in froms:
                    out[q] = least if out[q] is None else min(out[q], least)
    return out


def repair(rows: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows (byte_of each)."""
    chain: list[tuple[int, str] | None] = [(0, "") if q in _ENDS else None for q in range(4)]
    starts = list(range(0, len(rows), block)) or [0]
    for lo in reversed(starts):
        own = rows[lo : lo + block]
        # No best suffix costs more than deleting all rows and two inserted turns and what a change of state may need.
        w = Weights(len(own) + (2 * len(own) + 20) // 5 + 2)
        reached: list[list[tuple[int, str]]] = [[] for _ in range(4)]
        for end, rest in enumerate(chain):
            if rest is None:
                continue
            best: list[int | None] = [0 if q == end else None for q in range(4)]
            if lo == starts[-1]:
                best = _inserted(w, best)
            for row in reversed(own):
                best = _inserted(w, _edited(w, row, best))
            for q, x in enumerate(best):
                if x is not None:
                    reached[q].append(((x >> w.bits) + rest[0], w.letters(x) + rest[1]))
        # The letters' order as characters is that of their digits, and a shorter audit's end counts as zero in both.
        chain = [min(r) if r else None for r in reached]
    return chain[0]


#: White space that does not count.
_SPACE = " \t\n\x0b\x0c\r"


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped` of rows after damage by crc32(`conv_id:turn`) % 20; dropped rows stay as markers of their conversation."""
    h = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(_or_space("text"), ".!?", "")).otherwise(_or_space("text"))
    role = F.when(h == 4, "user").otherwise(_or_space("role"))
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (h == 0).alias("dropped"), h.alias("_h"))
    return own.withColumn("_copy", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_h", "_copy")


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped) with `digest` (of role and text) and `fault` (0 none, 1 blank, 2 duplicate, 3 truncated).

    Copies meet in a window of their own, whose task holds no list of them.
    """
    bare = F.rtrim("text", F.lit(_SPACE))
    first = Window.partitionBy("conv_id", "dropped", "digest").orderBy(F.col("turn").asc_nulls_first())
    own = rows.withColumn("digest", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # Told before the window, so that texts don't go through it.
    own = own.withColumn("_blank", F.length(bare) == 0).withColumn("_cut", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    return own.withColumn("fault", F.when(F.col("_blank"), 1).when(F.row_number().over(first) > 1, 2).when(F.col("_cut"), 3).otherwise(0)).drop("_blank", "_cut")


DECIDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ORDER = ("conv_id", "turn", "role", "digest")


def _walk(batches: Iterator[pa.RecordBatch], at_once: int = 1024) -> Iterator[list]:
    for batch in batches:
        for lo in range(0, len(batch), at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, at_once).columns))


def decide(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """DECIDED for each conversation of marked rows: one sorted walk without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, own = None, None

        def told() -> tuple:
            cost, audit = repair(bytes(own["rows"]), block)
            gaps = own["last"] - own["first"] + 1 - own["turns"] if own["turns"] else 0
            return key, gaps, *own["faults"], own["illegal"], cost, audit

        for conv, turn, role, fault, dropped in _walk(batches):
            if own is None or conv != key:
                if own is not None:
                    out.append(told())
                    if len(out) >= 4096 or own["rows"] and len(own["rows"]) > 4096:
                        yield _batch(out)
                        out = []
                key, own = conv, {"rows": bytearray(), "faults": [0, 0, 0], "illegal": 0, "before": None, "turns": 0, "first": 0, "last": None}
            if dropped:
                continue
            initial = role[:1]
            if own["before"] is not None and own["before"] + initial not in ("su", "ua", "au"):
                own["illegal"] += 1
            own["before"] = initial
            if fault:
                own["faults"][fault - 1] += 1
            own["rows"].append(byte_of(initial, fault in (1, 2), fault == 3))
            # Rows come in order of turn: a new one is larger than all before.
            if turn is not None and (not own["turns"] or turn != own["last"]):
                own["first"] = turn if not own["turns"] else own["first"]
                own["last"] = turn
                own["turns"] += 1
        if own is not None:
            out.append(told())
        if out:
            yield _batch(out)

    narrow = rows.select("conv_id", "turn", "role", "digest", "fault", "dropped")
    # Of equal rows the one that counts stands first.
    walk = narrow.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in _ORDER), F.col("fault") == 2)
    return arrow_map(walk.select("conv_id", "turn", F.substring("role", 1, 1), "fault", "dropped"), run, DECIDED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of DECIDED, with a digest behind or without."""
    names = [f.split()[0] for f in DECIDED.split(", ")] + ["repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, zip(*rows))], names[: len(rows[0])])


class _Transcript:
    """The digest of a repaired conversation, as its rows pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.hash = audit, 0, 0, 0, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def _next_role(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(self._next_role(), "")

    def row(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = FROM[role[0]][1]
            self._write(role, text)
        elif letter == "R":
            self._write(self._next_role(), text)

    def end(self) -> str:
        self.insertions()
        return self.hash.hexdigest()


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """DECIDED with repaired_sha256, of the repaired rows as `role:text` joined by newlines: a second sorted walk, each conversation's audit first."""
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    audits = decided.select("conv_id", F.lit(None).cast("long").alias("turn"), *none("role", "digest", "text"), F.struct(*decided.columns[1:]).alias("decided"))
    texts = rows.where("not dropped").select("conv_id", "turn", "role", "digest", "text", F.lit(None).cast(audits.schema["decided"].dataType).alias("decided"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        told, own = (), None
        for conv, role, text, decided_ in _walk(batches, 64):
            if decided_ is None:
                own.row(role, text)
                continue
            if own is not None:
                out.append((*told, own.end()))
                if len(out) >= 4096 or len(own.audit) > 4096:
                    yield _batch(out)
                    out = []
            told, own = (conv, *decided_.values()), _Transcript(decided_["audit"])
        if own is not None:
            out.append((*told, own.end()))
        if out:
            yield _batch(out)

    walk = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("decided").isNull(), *(F.col(c).asc_nulls_first() for c in _ORDER[1:]))
    return arrow_map(walk.select("conv_id", "role", "text", "decided"), run, f"{DECIDED}, repaired_sha256 string")


def digest(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of the damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = marked(damage(conversations))
    return repaired(rows, decide(rows, block))
