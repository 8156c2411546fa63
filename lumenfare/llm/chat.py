"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript comes in parts (rows of text in an order). Each line is in one of six states: the first or a further line of
a turn of the system, the user or the assistant. A line shows the kind of its speaker marker, its length and whether it
asks; the model's starts, transitions and emissions are counted over transcripts whose roles are known. The Viterbi path
is the transcript's parse: marked or not, each line gets a role and turns begin where the path says so.

One conversation may hold any share of all rows, so none is gathered in a task. Parts are cut into segments of 64; each
segment is reduced to its max-plus transfer matrix (best score from the state before it to the state at its end), the
matrices are chained in sorted walks that hold one state, which fixes the states at the segments' seams, and each segment
is then decoded between them. The result is that of one Viterbi run over the whole transcript. Turns are rendered in
chunks, one for each segment that a turn has lines in, so that a turn of any length is never gathered either: the chunks of
a turn, joined in order, are the turn.

Defined cases: null text is an empty part and has one empty line. Null conv_ids are one conversation; null parts come
first. Repeated rows are repeated lines. White space at a turn's two ends goes, in its first and last chunk. Of equal paths the one through the lower states wins. An unknown role counts as
a user's in fitting. An empty table gives no turns. Very long parts are one segment. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequential import fold_sorted
from .common import arrow_map, materialize

ROLES = ("system", "user", "assistant")
STATES = 6
#: Parts of a conversation that are read together.
SEGMENT = 64

_WORDS = {0: "system|note|context|instructions?", 1: "user|human|customer|client|question|q", 2: "assistant|ai|bot|agent|answer|support|a"}
_MARKER = re.compile(
    r"^\s*(?:"
    + "|".join(rf"(?:#{{1,4}}\s*(?P<h{k}>{w})\s*:?\s*$|\[(?P<b{k}>{w})\]\s*|<\|(?P<t{k}>{w})\|>\s*|\*\*(?P<s{k}>{w}):?\*\*\s*:?\s*|(?P<c{k}>{w})\s*(?::|\s-)\s+)" for k, w in _WORDS.items())
    + r"|(?P<q>>)\s+)",
    re.I,
)
#: Kinds of markers: of the three roles, a quote mark, none.
MARKERS, LENGTHS = 5, 6


def look(line: str) -> tuple[int, int, int, str]:
    """Marker kind, length class, whether it asks, and the line without its marker."""
    m = _MARKER.match(line)
    kind = 4
    if m:
        name = m.lastgroup
        kind = 3 if name == "q" else int(name[1])
        line = line[m.end() :]
    n = len(line)
    return kind, (n > 0) + (n > 20) + (n > 60) + (n > 120) + (n > 240), int(line.rstrip().endswith("?")), line


class Model:
    """Log probabilities: start (6), move (6 x 6), and three emission tables."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        def table(kind: str, columns: int, rows: int = STATES) -> np.ndarray:
            out = np.full((rows, columns), 0.5)
            for (k, a, b), n in counts.items():
                if k == kind:
                    out[a, b] += n
            return np.log(out / out.sum(1, keepdims=True))

        self.start = table("start", STATES, 1)[0]
        # A start or move into a further line of another turn can't be.
        self.start[1::2] = -1e9
        self.move = table("move", STATES)
        for a in range(STATES):
            for b in range(1, STATES, 2):
                if a // 2 != b // 2:
                    self.move[a, b] = -1e9
        self.marker, self.length, self.asks = table("marker", MARKERS), table("length", LENGTHS), table("asks", 2)

    def emit(self, seen: list[tuple[int, int, int, str]]) -> np.ndarray:
        k, n, q = (np.array([s[i] for s in seen], np.int64) for i in range(3))
        return (self.marker[:, k] + self.length[:, n] + self.asks[:, q]).T


def viterbi(first: np.ndarray, move: np.ndarray, emit: np.ndarray, last: int | None = None) -> tuple[list[int], float]:
    """The best path from scores of the first state; `last` fixes its end."""
    best, back = first + emit[0], []
    for e in emit[1:]:
        through = best[:, None] + move
        back.append(through.argmax(0))
        best = through.max(0) + e
    path = [int(best.argmax()) if last is None else last]
    score = float(best[path[0]])
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], score


def transfer(move: np.ndarray, emit: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines to each state at their end. into: scores of the first line's state, by the state before."""
    best = into + emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + move[None]).max(1) + e
    return best


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Rows of sorted batches, cut where conv_id and segment change: these two and the rows' other columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if key is not None and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row[2:])
    if key is not None:
        yield key, rows


def _lines(rows: list) -> list[tuple[int, int, str]]:
    """(row, position, line) of a segment's parts."""
    return [(i, j, line) for i, r in enumerate(rows) for j, line in enumerate((r[1] or "").split("\n"))]


def _dealt(parts: DataFrame, *more: str) -> DataFrame:
    """Parts with their segments, one task for each segment, in order."""
    order = ["conv_id", "segment", "part", "text"]
    own = parts.select("conv_id", F.coalesce(F.floor(F.col("part") / SEGMENT), F.lit(-1)).cast("long").alias("segment"), "part", "text", *more)
    return own.repartition("conv_id", "segment").sortWithinPartitions(*order)


def fit(parts: DataFrame) -> Model:
    """Counts over parts (conv_id, part, text, role), each a turn whose role is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (_, segment), rows in _segments(batches):
            before = None
            for _, text, role in rows:
                r = ROLES.index(role) if role in ROLES else 1
                for j, line in enumerate((text or "").split("\n")):
                    state = 2 * r + (j > 0)
                    kind, n, q, _ = look(line)
                    counts.update([("marker", state, kind), ("length", state, n), ("asks", state, q)])
                    if before is not None:
                        counts["move", before, state] += 1
                    elif segment <= 0:
                        counts["start", 0, state] += 1
                    before = state
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["kind", "a", "b", "n"])

    sums = arrow_map(_dealt(parts, "role"), run, "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return Model({(r[0], r[1], r[2]): r[3] for r in sums.collect()})


def parse(parts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, segment, part, row, pos, line, role, begins, turn, known): every line with its role, its turn's number in the conversation, and the role that its part was given with, if any."""
    known = F.col("role") if "role" in parts.columns else F.lit(None).cast("string")
    given = materialize(parts.select("conv_id", "part", F.coalesce("text", F.lit("")).alias("text"), known.alias("known")), "transcripts")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in _segments(batches):
            emit = model.emit([look(x) for _, _, x in _lines(rows)])
            out.append((*key, transfer(model.move, emit, model.move).ravel().tolist(), transfer(model.move, emit, np.tile(model.start, (STATES, 1)))[0].tolist()))
            if len(out) == 512:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["conv_id", "segment", "matrix", "first"])

    reduced = materialize(arrow_map(_dealt(given), reduce, "conv_id long, segment long, matrix array<double>, first array<double>"), "segments")

    # The matrices are chained in two walks over each conversation's segments, one state held at a time: forwards, which
    # leaves for each state at a segment's end the state it came from, and backwards, which follows these from the end.
    def forward(best: np.ndarray | None, segment: int, matrix: list, start: list) -> tuple[np.ndarray, tuple]:
        if best is None:
            best, back = np.array(start), None
        else:
            through = best[:, None] + np.array(matrix).reshape(STATES, STATES)
            best, back = through.max(0), through.argmax(0).tolist()
        return best, (segment, back, int(best.argmax()))

    def backward(state: int | None, segment: int, back: list | None, end: int) -> tuple[int | None, tuple]:
        after = end if state is None else state
        before = None if back is None else back[after]
        return before, (segment, before, after)

    came = fold_sorted(reduced.select("conv_id", "segment", "matrix", "first"), "conv_id", ["segment"], forward, "segment long, back array<int>, end int")
    seams = fold_sorted(came, "conv_id", [F.desc("segment")], backward, "segment long, before int, after int")
    own = given.withColumn("segment", F.coalesce(F.floor(F.col("part") / SEGMENT), F.lit(-1)).cast("long"))
    seams = seams.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "before", "after")
    met = own.join(seams, own.conv_id.eqNullSafe(F.col("_conv")) & (own.segment == F.col("_segment"))).select("conv_id", "segment", "part", "text", "before", "after", "known")
    dealt = met.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "part", "text")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, segment), rows in _segments(batches):
            lines = _lines(rows)
            seen = [look(x) for _, _, x in lines]
            before, after = rows[0][2], rows[0][3]
            path, _ = viterbi(model.start if before is None else model.move[before], model.move, model.emit(seen), after)
            turn = np.cumsum([s % 2 == 0 for s in path])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * len(lines), pa.int64()), pa.array([segment] * len(lines), pa.int64()), pa.array([rows[i][0] for i, _, _ in lines], pa.int64()), pa.array([i for i, _, _ in lines], pa.int32()), pa.array([j for _, j, _ in lines], pa.int32()),
                    pa.array([s[3] for s in seen], pa.string()), pa.array([ROLES[s // 2] for s in path], pa.string()), pa.array([s % 2 == 0 for s in path], pa.bool_()), pa.array(turn.astype(np.int64)), pa.array([rows[i][4] for i, _, _ in lines], pa.string()),
                ],
                ["conv_id", "segment", "part", "row", "pos", "line", "role", "begins", "local", "known"],
            )

    lines = materialize(arrow_map(dealt, decode, "conv_id long, segment long, part long, row int, pos int, line string, role string, begins boolean, local long, known string"), "lines")
    # Turns begun before each segment: a running sum over segments, not over lines.
    begun = lines.groupBy("conv_id", "segment").agg(F.max("local").alias("n"))
    begun = begun.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("segment")) - F.col("n")).alias("earlier"))
    return lines.join(begun, lines.conv_id.eqNullSafe(F.col("_conv")) & (lines.segment == F.col("_segment"))).select("conv_id", "segment", "part", "row", "pos", "line", "role", "begins", (F.col("earlier") + F.col("local") - 1).alias("turn"), "known")


def render(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, chunk, role, n_lines, n_right, text, rendered): the recovered turns, a row for each segment that a turn has lines in.

    rendered: the chunk's share of "<|role|>", the text and "<|end|>". n_right: lines whose role is the known one.
    """
    right = F.count(F.when(F.col("role") == F.col("known"), 1))
    pieces = lines.groupBy("conv_id", "turn", "segment").agg(F.first("role").alias("role"), F.count("*").alias("n_lines"), right.alias("n_right"), F.sort_array(F.collect_list(F.struct("row", "pos", "line"))).alias("lines"))
    joined = pieces.withColumn("text", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    turn = Window.partitionBy("conv_id", "turn").orderBy("segment")
    placed = joined.withColumn("chunk", F.row_number().over(turn) - 1).withColumn("last", F.lead("segment").over(turn).isNull())
    space = F.lit(" \t\r\n")
    left = F.when(F.col("chunk") == 0, F.ltrim("text", space)).otherwise(F.col("text"))
    text = F.when(F.col("last"), F.rtrim(left, space)).otherwise(F.concat(left, F.lit("\n")))
    rendered = F.concat(F.when(F.col("chunk") == 0, F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(""), "text", F.when(F.col("last"), "\n<|end|>").otherwise(""))
    return placed.withColumn("text", text).select("conv_id", "turn", "chunk", "role", "n_lines", "n_right", "text", rendered.alias("rendered"))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations as transcripts: each turn's text with the speaker marker of its conversation's style, one turn in ten unmarked."""
    c = F.coalesce(F.col("conv_id"), F.lit(-1))
    style = F.pmod(F.xxhash64(c), F.lit(6))
    marks = [("System: ", "User: ", "Assistant: "), ("Note: ", "Q: ", "A: "), ("### System:\n", "### Human:\n", "### Assistant:\n"), ("[system] ", "[user] ", "[assistant] "), ("**Context:** ", "> ", ""), ("Context - ", "Customer - ", "Agent - ")]
    which = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    table = F.array(*[F.array(*map(F.lit, m)) for m in marks])
    mark = F.when(F.pmod(F.xxhash64(c, "turn"), F.lit(10)) == 0, "").otherwise(F.element_at(F.element_at(table, (style + 1).cast("int")), which + 1))
    return conversations.select("conv_id", F.col("turn").alias("part"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"), "role")


def digest(conversations: DataFrame) -> DataFrame:
    """Every conversation written as a transcript and parsed again: the chunks of each recovered turn, with the number of lines that got back their role. The model is counted on conversations whose crc32(conv_id as text) mod 4 is not 2."""
    parts = as_transcripts(conversations)
    model = fit(parts.where(F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 4 != 2, F.lit(True))))
    return render(parse(parts, model))
