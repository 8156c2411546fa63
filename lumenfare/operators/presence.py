"""Presence: offers that a successful fetch should have shown and did not.

For each scope (hotel and stay) every later successful run is a chance to see each of its offers. An offer that was open
and is missing becomes unavailable: a synthetic observation joins the fold. Known offers meet the scope's runs by an
equi-join on the scope, seen pairs leave by an anti-join, and only the first miss after an open sighting is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("hotel_id", "source_id", "check_in", "check_out", "adults", "children")


def with_runs(obs: DataFrame) -> DataFrame:
    """Observations with their fetch: one for each hotel and hour."""
    return obs.withColumn("run_at", F.date_trunc("hour", "checked_at"))


def plan_filter(plan, wanted):
    """A target's meal-plan filter: a substring without case; a set filter drops offers without a plan."""
    return F.coalesce(wanted.isNull() | F.contains(F.lower(F.trim(plan)), F.lower(F.trim(wanted))), F.lit(False))


def first_of_key(obs: DataFrame) -> DataFrame:
    """Within a fetch the first offer of a key wins."""
    turn = Window.partitionBy("hotel_id", "run_at", "offer_key").orderBy("checked_at", "event_id")
    return obs.withColumn("_k", F.row_number().over(turn)).where("_k = 1").drop("_k")


def disappearances(obs: DataFrame) -> DataFrame:
    """Synthetic sold-out observations (offer_key, scope, run_at): offers missing from a later run of their scope while open."""
    return vanished(with_runs(obs))


def vanished(seen: DataFrame) -> DataFrame:
    """As disappearances, of observations that bear their fetch as run_at.

    Only the first miss tells: an offer that stood open in one run of its scope and is not in the scope's next one. So each
    sighting meets one run, whatever comes after.
    """
    scope = Window.partitionBy(*SCOPE).orderBy("run_at")
    runs = seen.groupBy(*SCOPE, "run_at").agg(F.max("checked_at").alias("run_end")).withColumn("next", F.lead(F.struct("run_at", "run_end")).over(scope)).where("next is not null").select(*SCOPE, "run_at", "next")
    last = seen.groupBy("offer_key", *SCOPE, "run_at").agg(F.max(F.struct("checked_at", "event_id", "is_available"))["is_available"].alias("open"))
    line = Window.partitionBy("offer_key", *SCOPE).orderBy("run_at")
    missed = last.withColumn("following", F.lead("run_at").over(line)).where("open").join(runs, [*SCOPE, "run_at"]).where(F.col("following").isNull() | (F.col("following") > F.col("next.run_at")))
    return missed.select("offer_key", "hotel_id", "check_in", F.col("next.run_at").alias("run_at"), F.col("next.run_end").alias("seen_at"))


SQL = """
SELECT offer_key, hotel_id, CAST(check_in AS STRING) AS check_in, US(run_at) AS run_at, US(seen_at) AS seen_at FROM (
  SELECT *, lag(is_available) OVER (PARTITION BY offer_key ORDER BY seen_at, event_id NULLS LAST) AS before FROM (
    SELECT offer_key, hotel_id, check_in, date_trunc('hour', checked_at) AS run_at, checked_at AS seen_at, is_available, event_id FROM {obs}
    UNION ALL
    SELECT k.offer_key, k.hotel_id, k.check_in, r.run_at, r.run_end, FALSE, NULL
    FROM (SELECT offer_key, hotel_id, check_in, min(date_trunc('hour', checked_at)) AS since FROM {obs} GROUP BY offer_key, hotel_id, check_in) k
    JOIN (SELECT hotel_id, check_in, date_trunc('hour', checked_at) AS run_at, max(checked_at) AS run_end FROM {obs} GROUP BY hotel_id, check_in, date_trunc('hour', checked_at)) r ON r.hotel_id = k.hotel_id AND r.check_in = k.check_in AND r.run_at > k.since
    WHERE NOT EXISTS (SELECT 1 FROM {obs} o WHERE o.offer_key = k.offer_key AND date_trunc('hour', o.checked_at) = r.run_at)) u) t
WHERE event_id IS NULL AND before"""
