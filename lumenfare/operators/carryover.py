"""Carry-over: tonight's first price of a room against the stay before it, under equal conditions.

Nights of one room, plan and refundability form a line; the night before is the latest earlier check-in of as many
nights, at most `max_gap` days back. It is read as of the moment tonight's offer was first seen, not as it stands at the
end. Set-based throughout: a window over the line names the earlier offer, an as-of join finds its state at that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import detector


def offers(obs: DataFrame) -> DataFrame:
    """One row for each offer: conditions, nights and when it was first seen."""
    return obs.groupBy("offer_key").agg(
        *[F.first(c).alias(c) for c in ("hotel_id", "room_type_id", "source_id", "adults", "children", "meal_plan", "refundable", "currency", "check_in", "check_out")], F.min("checked_at").alias("first_seen_at")
    ).withColumn("nights", F.datediff("check_out", "check_in"))


def previous_stays(own: DataFrame, max_gap: int = 7) -> DataFrame:
    """(offer_key, previous_offer_key, gap_days): lag over the line; grouping holds null conditions equal."""
    line = Window.partitionBy("hotel_id", "room_type_id", "source_id", "adults", "children", "meal_plan", "refundable", "currency", "nights").orderBy("check_in", "offer_key")
    gap = F.datediff("check_in", F.lag("check_in").over(line))
    return own.select("offer_key", "first_seen_at", F.lag("offer_key").over(line).alias("previous_offer_key"), gap.alias("gap_days")).where(F.col("gap_days").between(1, max_gap))


def carry_over(obs: DataFrame, steps: DataFrame, t: detector.Thresholds = detector.Thresholds(), max_gap: int = 7, final_state: bool = False) -> DataFrame:
    """(offer_key, previous_offer_key, old_price, new_price, delta, delta_pct, direction).

    final_state: compare with the earlier offer's last state (a backfill's view) rather than its state at first sight.
    """
    pairs = previous_stays(offers(obs), max_gap)
    first = steps.where("outcome = 'first_sight'").select("offer_key", F.col("new_price").alias("tonight"), F.col("is_available").alias("open_tonight"))
    state = steps.select(F.col("offer_key").alias("previous_offer_key"), F.col("checked_at").alias("at"), F.struct("checked_at", "event_id", "last_price", "is_available").alias("state"))
    met = pairs.join(first, "offer_key").join(state, "previous_offer_key")
    if not final_state:
        met = met.where("at <= first_seen_at")
    asof = met.groupBy("offer_key", "previous_offer_key", "tonight", "open_tonight").agg(F.max("state").alias("s"))
    old, new = F.col("s.last_price").cast("decimal(12,2)"), F.col("tonight").cast("decimal(12,2)")
    told = asof.where(F.col("open_tonight") & F.col("s.is_available") & F.col("s.last_price").isNotNull() & F.col("tonight").isNotNull() & detector.significant(new, old, t))
    return told.select("offer_key", "previous_offer_key", old.alias("old_price"), new.alias("new_price"), detector.delta(new, old).alias("delta"), detector.percent(new, old).alias("delta_pct"), F.when(new > old, "increase").otherwise("decrease").alias("direction"))


def _carry_sql(final: bool) -> str:
    when = "" if final else " AND p.checked_at <= l.first_seen_at"
    return f"""
SELECT offer_key, previous_offer_key, old_price, tonight AS new_price, tonight - old_price AS delta, round((tonight - old_price) / old_price * 100, 2) AS delta_pct, CASE WHEN tonight > old_price THEN 'increase' ELSE 'decrease' END AS direction
FROM (
  SELECT l.offer_key, l.previous_offer_key, f.new_price AS tonight, f.is_available AS open_tonight, p.last_price AS old_price, p.is_available AS was_open,
    row_number() OVER (PARTITION BY l.offer_key ORDER BY p.checked_at DESC, p.event_id DESC) AS k
  FROM (
    SELECT a.offer_key, a.first_seen_at, b.offer_key AS previous_offer_key FROM {{line}} a JOIN {{line}} b
      ON a.hotel_id = b.hotel_id AND a.room_type_id = b.room_type_id AND a.meal_plan IS NOT DISTINCT FROM b.meal_plan AND a.refundable IS NOT DISTINCT FROM b.refundable
      AND b.check_in < a.check_in AND date_diff('day', b.check_in, a.check_in) <= 7
      AND NOT EXISTS (SELECT 1 FROM {{line}} c WHERE c.hotel_id = a.hotel_id AND c.room_type_id = a.room_type_id AND c.check_in < a.check_in AND c.check_in > b.check_in)) l
  JOIN {{steps}} f ON f.offer_key = l.offer_key AND f.outcome = 'first_sight'
  JOIN {{steps}} p ON p.offer_key = l.previous_offer_key{when}) t
WHERE k = 1 AND open_tonight AND was_open AND old_price IS NOT NULL AND tonight IS NOT NULL AND abs(tonight - old_price) >= 50 AND round(abs((tonight - old_price) / old_price * 100), 2) >= 2"""


LINE_SQL = "SELECT offer_key, hotel_id, room_type_id, meal_plan, refundable, check_in, min(checked_at) AS first_seen_at FROM {obs} GROUP BY offer_key, hotel_id, room_type_id, meal_plan, refundable, check_in"
ORACLES = {"c11_carry_over": _carry_sql(False), "c13_carry_over_backfill": _carry_sql(True)}
