"""The engine's domain tables, derived from the star-schema tables.

Each table has one definition, in expressions that both Spark and a plain SQL engine read the same way; VIEWS holds the
portable SQL, in order of dependence. `frames` makes them lazy DataFrames, `prelude` the same as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations from events: a hotel's room, seen tonight, with a price or sold out."""
    e = load(spark, sf_dir, "events")
    room = F.get_json_object("props", "$.k").cast("long") % 5
    o = e.select(
        "event_id", F.col("ts").cast("timestamp").alias("checked_at"), (F.col("user_id") % 10).alias("hotel_id"), room.alias("room_type_id"), F.lit(1).cast("long").alias("source_id"),
        F.lit(2).cast("long").alias("adults"), F.lit(0).cast("long").alias("children"), F.lit("INR").alias("currency"), F.to_date("ts").alias("check_in"), F.date_add(F.to_date("ts"), 1).alias("check_out"),
        F.when(room == 1, "  Room  ONLY").when(room > 1, "Breakfast").alias("meal_plan"), F.when(room > 0, room % 2 == 1).alias("refundable"), (F.col("event_type") != "error").alias("is_available"),
        F.when(F.col("event_type") != "error", (F.lit(1000) + F.ceil(F.col("value") / 20) * 25).cast("decimal(12,2)")).alias("price"),
    )
    return o.withColumn("offer_key", keys.offer_key())


#: The same for a plain SQL engine.
OBS_SQL = """obs_raw AS (
  SELECT event_id, ts AS checked_at, user_id % 10 AS hotel_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 5 AS room_type_id,
         CAST(ts AS DATE) AS check_in, CAST(ts AS DATE) + 1 AS check_out, event_type <> 'error' AS is_available,
         CASE WHEN event_type <> 'error' THEN CAST(1000 + ceil(value / 20) * 25 AS DOUBLE) END AS price FROM events),
obs AS (
  SELECT *, CASE room_type_id WHEN 0 THEN NULL WHEN 1 THEN '  Room  ONLY' ELSE 'Breakfast' END AS meal_plan,
         CASE WHEN room_type_id > 0 THEN room_type_id % 2 = 1 END AS refundable,
         sha256('v1|' || hotel_id || '|1|' || room_type_id || '|' || check_in || '|' || check_out || '|2|0|' ||
                CASE room_type_id WHEN 0 THEN '~' WHEN 1 THEN 'room only' ELSE 'breakfast' END || '|' ||
                CASE WHEN room_type_id = 0 THEN '~' WHEN room_type_id % 2 = 1 THEN '1' ELSE '0' END || '|INR') AS offer_key
  FROM obs_raw)"""


def hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("hotel_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), (F.col("s_acctbal") >= 0).alias("is_active"))


HOTELS_SQL = """hotels AS (
  SELECT s_suppkey AS hotel_id, s_name AS name, n_name AS city, r_name AS region, s_acctbal >= 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Rooms of every hotel.
ROOMS = ((0, "Standard Room"), (1, "Deluxe Room"), (2, "Premium Room"), (3, "Suite"), (4, "Family Room"))


def rooms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROOMS, "room_type_id long, room string")


ROOMS_SQL = "rooms AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{n}')" for k, n in ROOMS) + ") AS t(room_type_id, room))"
