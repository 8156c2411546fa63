"""The ingest chain: offers of fetches are filtered, named, keyed, collapsed within their fetch, completed by what vanished, and folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, matching
from . import detector, presence


def room_id(hotel: str, name: str) -> Column:
    """The id of a room made for a name: the same whether it was seeded or met later."""
    return F.xxhash64(hotel, name)


def seeded_rooms(offers: DataFrame, rooms: DataFrame) -> DataFrame:
    """(hotel_id, room_type_id, name, canonical_name, sort_order): hotels without rooms get those of their first fetch.

    offers: hotel_id, run_at, checked_at, event_id, raw_name. Of names with one normal form the fetch's first counts; a name
    that normalises to nothing makes no room, but takes its place in the order.
    """
    bare = offers.join(rooms.select("hotel_id").distinct(), "hotel_id", "left_anti")
    first = bare.groupBy("hotel_id").agg(F.min("run_at").alias("run_at"))
    turn = Window.partitionBy("hotel_id").orderBy("checked_at", "event_id")
    placed = bare.join(first, ["hotel_id", "run_at"]).withColumn("sort_order", (F.row_number().over(turn) - 1).cast("long"))
    named = placed.select("hotel_id", "sort_order", F.substring(F.trim("raw_name"), 1, 200).alias("name"), F.substring(matching.normalize(F.col("raw_name")), 1, 200).alias("canonical_name"))
    kept = named.where("canonical_name <> ''").groupBy("hotel_id", "canonical_name").agg(F.min(F.struct("sort_order", "name")).alias("f"))
    return kept.select("hotel_id", room_id("hotel_id", "canonical_name").alias("room_type_id"), "f.name", "canonical_name", "f.sort_order")


def judged(offers: DataFrame, aliases: DataFrame, rooms: DataFrame, wanted: Column) -> DataFrame:
    """offers with room_type_id, offer_key and verdict: filtered, unmatched, collapsed or kept.

    A name that no room resembles gets a room of its own; only a name that normalises to nothing (or is null) is unmatched.
    Within a fetch (hotel_id, run_at) the first offer of a key is kept.
    """
    told = offers.withColumn("raw_name", F.coalesce("raw_name", F.lit(""))).withColumn("fits", presence.plan_filter(F.col("meal_plan"), wanted))
    known = rooms.select("hotel_id", "room_type_id", "canonical_name").unionByName(seeded_rooms(told, rooms).select("hotel_id", "room_type_id", "canonical_name"))
    names = matching.resolve(told.where("fits"), aliases, known)
    chosen = F.coalesce("room_type_id", F.when(F.col("normalized") != "", room_id("hotel_id", "normalized")))
    named = told.join(names.select("hotel_id", "raw_name", chosen.alias("room_type_id")), ["hotel_id", "raw_name"], "left")
    keyed = named.withColumn("offer_key", F.when(F.col("fits") & F.col("room_type_id").isNotNull(), keys.offer_key()))
    turn = F.row_number().over(Window.partitionBy("hotel_id", "run_at", "offer_key").orderBy("checked_at", "event_id"))
    return keyed.withColumn("verdict", F.when(~F.col("fits"), "filtered").when(F.col("offer_key").isNull(), "unmatched").when(turn > 1, "collapsed").otherwise("kept"))


def completed(offers: DataFrame) -> DataFrame:
    """(hotel_id, run_at, offer_key, checked_at, event_id, price, is_available): kept offers, and sold-out rows where open ones vanished."""
    kept = offers.where("verdict = 'kept'")
    gone = presence.vanished(kept)
    columns = ["hotel_id", "run_at", "offer_key", "checked_at", "event_id", "price", "is_available"]
    made = gone.select("hotel_id", "run_at", "offer_key", F.col("seen_at").alias("checked_at"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("decimal(12,2)").alias("price"), F.lit(False).alias("is_available"))
    return kept.select(*columns).unionByName(made)


def run_counters(offers: DataFrame, rows: DataFrame, t: detector.Thresholds = detector.Thresholds()) -> DataFrame:
    """What each fetch of judged offers brought, rows being these offers completed: a row for each (hotel_id, run_at)."""
    by = ["hotel_id", "run_at"]
    steps = detector.fold_stream(rows, t).select("offer_key", "checked_at", "outcome").join(rows.select(*by, "offer_key", "checked_at", "event_id"), ["offer_key", "checked_at"])
    told = F.col("outcome").isin(*detector.NOTIFIABLE)
    folded = steps.groupBy(*by).agg(F.count_if(F.col("event_id").isNull()).alias("vanished"), F.count_if(F.col("outcome") == "first_sight").alias("first_sights"), F.count_if(F.col("outcome") == "pending").alias("pending"), F.count_if(told).alias("changed"))
    seen = offers.groupBy(*by).agg(F.count("*").alias("seen"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("filtered", "unmatched", "collapsed", "kept")])
    return seen.join(folded, by, "left").na.fill(0, ["vanished", "first_sights", "pending", "changed"])
