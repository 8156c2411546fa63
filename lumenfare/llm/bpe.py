"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the table holds the last token of that prefix's one valid encoding. A token may end a
prefix when it is a suffix of it and forms a valid pair with the last token of what is left: a pair is valid when undoing
merges on both sides of the seam never meets a merge across the seam that BPE would have done first. The encoding is read
off backwards. Since an entry depends only on the bytes before it, bytes can be appended exactly, and after an edit the
table is filled again only until it runs level with the old one for as many bytes as the longest token has.

Text is split by the tokenizer's pattern first and each match is encoded separately, without special tokens. Merge ranks
come from a rank file (base64 token and rank on each line); nothing is trained.

Defined cases: a null text is empty and has no tokens. Repeated rows and ties are encoded alike. Very long texts are
taken whole, their pieces in blocks. Bytes that do not form UTF-8 can be decoded from any ids. Extra columns pass through.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_at_once

#: Pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Pieces that are learnt and joined at a time, of many texts or of one long text.
BLOCK = 300_000

#: The usual split pattern, and for texts of basic Latin letters only the same in Python's own syntax.
SIMPLE_TEXT = re.compile("[\x00-\x1b\x20-\u024f]*")
_NUM = "\\d\xb2\xb3\xb9\xbc-\xbe"
_LET = "[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe]"
SIMPLE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LET}+| ?[{_NUM}]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


class PrefixTable:
    """The last token of each prefix of a byte string, under one encoder."""

    def __init__(self, encoder: "Encoder", data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Bytes added at the end; no older entry changes."""
        self.data += more
        self.encoder.fill(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """data[start:end] becomes new; returns how many entries were computed anew."""
        old, shift, n = self.last, len(new) - (end - start), len(self.data)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, level, at = old[:start], 0, start
        while at < len(self.data):
            at += 1
            self.encoder.fill(self.data, self.last, at)
            before = at - 1 - shift
            level = level + 1 if at > start + len(new) and end <= before < n and old[before] == self.last[-1] else 0
            if level >= self.encoder.longest:
                self.last += old[before + 1 :]
                break
        return at - start

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i - 1])
            i -= self.encoder.sizes[self.last[i - 1]]
        return out[::-1]


class Encoder:
    """Ranks, the merge that makes each token, and remembered pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.longest = max(self.sizes)
        self.split = regex.compile(pattern)
        self.simple = pattern == USUAL_PATTERN
        self.valid: dict[int, bool] = {}
        self.merged: dict[int, int] = {}
        self.parts = [(r, r) for r in range(len(self.tokens))]
        for rank, token in enumerate(self.tokens):
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None and a < rank and b < rank and self._pair(a, b):
                    self.parts[rank] = (a, b)
                    self.merged[a << 32 | b] = rank
                    break
        self.valid.clear()
        flat = np.array(self.sizes, np.int64)
        self._sizes, self._starts = flat, np.cumsum(flat) - flat
        self._flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.packed = [r.to_bytes(4, "little") for r in range(len(self.tokens))]
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for rank, token in enumerate(self.tokens):
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if (to := self.step.get(key)) is None:
                    to = self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = to
            if token:
                self.ends[node] = rank
        self.known: dict[str, bytes] = {}

    def _pair(self, a: int, b: int) -> bool:
        """Whether BPE leaves the seam between tokens a and b open."""
        bound = 1 << 62
        while True:
            made = self.merged.get(a << 32 | b)
            if made is not None and made < bound:
                return False
            # Undo the later of the two merges; a single byte has none left.
            for side in ("a", "b") if a > b else ("b", "a"):
                if side == "a" and self.sizes[a] > 1 and self.parts[a][0] != a:
                    bound, a = a, self.parts[a][1]
                    break
                if side == "b" and self.sizes[b] > 1 and self.parts[b][0] != b:
                    bound, b = b + 1, self.parts[b][0]
                    break
            else:
                return True

    def fill(self, data: bytes, last: list[int], upto: int) -> None:
        """Entries for data[len(last):upto]: the tokens that end at a byte are met walking backwards through a tree of reversed tokens."""
        step, ends, valid = self.step.get, self.ends, self.valid
        for end in range(len(last), upto):
            node, at = 0, end
            while at >= 0:
                node = step(node << 8 | data[at])
                if node is None:
                    raise ValueError(f"no token of the ranks ends at byte {end}")
                token = ends[node]
                if token >= 0:
                    if not at:
                        last.append(token)
                        break
                    key = last[at - 1] << 32 | token
                    fits = valid.get(key)
                    if fits is None:
                        if len(valid) > 2 * REMEMBERED:
                            valid.clear()
                        fits = valid[key] = self._pair(last[at - 1], token)
                    if fits:
                        last.append(token)
                        break
                at -= 1
            else:
                raise ValueError(f"no token of the ranks ends at byte {end}")

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, in order, so that each starts from the prefix entries it shares with the one before."""
        ranks, packed, sizes, known = self.ranks, self.packed, self.sizes, self.known
        before, last = b"", []
        for piece in sorted(pieces):
            data = piece.encode()
            whole = ranks.get(data)
            if whole is not None:
                known[piece] = packed[whole]
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same:]
            self.fill(data, last, i := len(data))
            before, out = data, []
            while i:
                out.append(packed[token := last[i - 1]])
                i -= sizes[token]
            known[piece] = b"".join(out[::-1])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, out, waiting, size = self.known, [], [], 0
        for text in texts:
            split = SIMPLE_SPLIT if self.simple and SIMPLE_TEXT.fullmatch(text) else self.split
            if len(text) >= BLOCK:
                found, own = (m.group() for m in split.finditer(text)), bytearray()
                out += self._joined(waiting)
                waiting, size = [], 0
                while block := list(itertools.islice(found, BLOCK)):
                    own += self._joined([block])[0]
                out.append(bytes(own))
                continue
            waiting.append(split.findall(text))
            size += len(waiting[-1])
            if size >= BLOCK:
                out += self._joined(waiting)
                waiting, size = [], 0
        return out + self._joined(waiting)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        known = self.known
        new = set().union(*split).difference(known)
        self.learn(list(new))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        if len(known) > REMEMBERED:
            known.clear()
        else:
            for piece in new:
                if len(piece) > 64:
                    del known[piece]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        n = np.frombuffer(ids, "<u4")
        out = bytearray()
        for lo in range(0, len(n), BLOCK):
            part = n[lo : lo + BLOCK]
            sizes = self._sizes[part]
            ends = np.cumsum(sizes)
            out += self._flat[np.arange(ends[-1]) + np.repeat(self._starts[part] - ends + sizes, sizes)].tobytes()
        return bytes(out)


#: Fixed value: the split pattern of the byte-level tokenizers.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = USUAL_PATTERN) -> Encoder:
    """The encoder of a rank file, built once and kept until a task that used it ends."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path, pattern] = Encoder(ranks, pattern)
    return _encoders[path, pattern]


def forget(path: str, pattern: str = USUAL_PATTERN) -> None:
    """Drop the encoder of a rank file, with the pieces that it remembers."""
    _encoders.pop((path, pattern), None)


def round_trip(docs: DataFrame, path: str, pattern: str = USUAL_PATTERN) -> DataFrame:
    """docs with `_ids` (binary, little-endian unsigned 32-bit) and `_decoded` (binary, decoded from those ids) added; no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        at = names.index("text")
        for part in (p for batch in batches for p in rows_at_once(batch, at)):
            ids = own.encode_all([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], [*names, "_ids", "_decoded"])
        # The worker lives on and may serve other operators: the encoder and the pieces it remembers go with the task.
        forget(path, pattern)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{kinds}, _ids binary, _decoded binary")


def digest(docs: DataFrame, path: str, pattern: str = USUAL_PATTERN) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = round_trip(docs.select("doc_id", "text"), path, pattern)
    return out.select("doc_id", F.expr("cast(octet_length(_ids) div 4 as long)").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))
