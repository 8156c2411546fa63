"""Names of rooms: normal form and similarity, as Arrow-batched functions; resolution is relational."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

# Words without meaning in a room's name, and short forms with what they stand for, in order.
STOP_WORDS = frozenset({"room", "rooms", "with", "the", "a", "an", "and", "our", "type", "category", "accommodation", "stay", "unit", "in", "of", "for", "per"})
SHORT_FORMS = {
    "dbl": "double", "sgl": "single", "trpl": "triple", "quad": "quadruple", "dlx": "deluxe", "std": "standard", "exec": "executive", "sup": "superior", "ste": "suite", "apt": "apartment",
    "bhk": "bedroom", "ac": "ac", "a/c": "ac", "aircon": "ac", "airconditioned": "ac", "nonac": "non ac", "non-ac": "non ac", "w/": "with", "&": "and", "+": "and",
}
#: Scores from which a name is matched, and from which a near miss is suggested.
MATCH, SUGGEST = 90.0, 60.0

_SHORT = [(re.compile(rf"(?<!\w){re.escape(a)}(?!\w)"), f" {b} ") for a, b in SHORT_FORMS.items()]


def normal_name(raw: str | None) -> str:
    """Accents folded, case lowered, short forms written out, marks and stop words gone, words sorted."""
    if not raw:
        return ""
    text = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).lower()
    for pattern, full in _SHORT:
        text = pattern.sub(full, text)
    return " ".join(sorted(w for w in re.sub(r"[^\w\s&+]", " ", text).split() if w not in STOP_WORDS))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, on bit rows of a Python integer."""
    marks: dict[str, int] = {}
    for i, ch in enumerate(a):
        marks[ch] = marks.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        hit = row & marks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def similarity(a: str | None, b: str | None) -> float:
    """The smaller of the sorted-words and the word-set ratio, 0 to 100; an empty name is like nothing."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        by_set = 100.0
    else:
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        by_set = max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else ()), 0.0)
    return min(by_set, ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def normalize(col: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(normal_name, na_action=None), "string")(col)


def score(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([similarity(p, q) for p, q in zip(x, y)], dtype="float64"), "double")(a, b)


def resolve(names: DataFrame, aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """names (hotel_id, raw_name) with room_type_id, score, is_exact, suggestion_id, normalized.

    Exact aliases (hotel_id, normalized, room_type_id) come first; what is left meets its own hotel's candidates (hotel_id, room_type_id,
    canonical_name) only. Of equal scores the smallest room_type_id wins. A name that normalises to nothing stays unmatched.
    Distinct names are compared once, however often they occur.
    """
    ship(names.sparkSession)
    distinct = names.select("hotel_id", "raw_name").distinct().withColumn("normalized", normalize(F.col("raw_name")))
    exact = aliases.groupBy("hotel_id", "normalized").agg(F.min("room_type_id").alias("exact_id"))
    known = distinct.join(exact, ["hotel_id", "normalized"], "left")
    rest = known.where("exact_id is null and normalized <> ''").select("hotel_id", "normalized").distinct()
    pairs = rest.join(candidates.withColumn("canonical", normalize(F.col("canonical_name"))), "hotel_id").withColumn("score", score(F.col("normalized"), F.col("canonical")))
    best = pairs.groupBy("hotel_id", "normalized").agg(F.max(F.struct(F.col("score"), (-F.col("room_type_id")).alias("turn"))).alias("b"))
    out = known.join(best, ["hotel_id", "normalized"], "left")
    s = F.col("b.score")
    chosen = F.when(F.col("exact_id").isNotNull(), F.col("exact_id")).when(s >= MATCH, -F.col("b.turn"))
    return out.select("hotel_id", "raw_name", "normalized", chosen.alias("room_type_id"), F.when(F.col("exact_id").isNotNull(), 100.0).otherwise(s).alias("score"), F.col("exact_id").isNotNull().alias("is_exact"), F.when(chosen.isNull() & (s >= SUGGEST), -F.col("b.turn")).alias("suggestion_id"))


def new_rooms(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """Rooms made for unfamiliar names: one for each hotel and normal form, ids by hash, sorted after the hotel's own."""
    fresh = resolved.where("room_type_id is null and normalized <> ''").groupBy("hotel_id", "normalized").agg(F.min("raw_name").alias("canonical_name"))
    top = existing.groupBy("hotel_id").agg(F.max("sort_order").alias("top"))
    turn = Window.partitionBy("hotel_id").orderBy("normalized")
    return fresh.join(top, "hotel_id", "left").select("hotel_id", F.xxhash64("hotel_id", "normalized").alias("room_type_id"), "canonical_name", (F.coalesce("top", F.lit(-1)) + F.row_number().over(turn)).alias("sort_order"))


def unmatched_queue(resolved: DataFrame, sightings: DataFrame, queue: DataFrame) -> DataFrame:
    """The queue of unresolvable names: counters summed up with this batch's sightings (hotel_id, raw_name, at), rows closed once their name resolves.

    A name that normalises to nothing is queued under its own lower-cased text.
    """
    held = F.substring(F.when(F.col("normalized") == "", F.lower("raw_name")).otherwise(F.col("normalized")), 1, 300)
    names = resolved.select("hotel_id", "raw_name", held.alias("normalized"), "room_type_id")
    now = sightings.join(names.where("room_type_id is null"), ["hotel_id", "raw_name"]).groupBy("hotel_id", "normalized").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("z"))
    merged = queue.join(now, ["hotel_id", "normalized"], "full").select("hotel_id", "normalized", (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrence_count"), F.least("first_seen_at", "a").alias("first_seen_at"), F.greatest("last_seen_at", "z").alias("last_seen_at"))
    done = names.where("room_type_id is not null").groupBy("hotel_id", "normalized").agg(F.min("room_type_id").alias("resolved_to"))
    return merged.join(done, ["hotel_id", "normalized"], "left")
