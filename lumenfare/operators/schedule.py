"""Scheduling: due request groups, circuit breaking, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .sequential import fold_sorted

#: Failures in a row that open a circuit, and how long it cools, in seconds.
OPEN_AFTER, COOL_SECONDS = 5, 3600


def circuit_allows(state: Column, opened_at: Column, now: Column) -> Column:
    """closed runs; half-open waits for its probe; open becomes a probe once it has cooled."""
    return F.when(state == "closed", "run").when((state == "open") & (F.unix_seconds(now) - F.unix_seconds(opened_at) >= COOL_SECONDS), "probe").otherwise("skip")


def is_stale(last_success: Column, created: Column, interval_minutes: Column, now: Column) -> Column:
    """No success for more than three intervals; without any baseline, not stale."""
    base = F.coalesce(last_success, created)
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(base) > 180 * interval_minutes, F.lit(False))


def next_run(now: Column, interval_minutes: Column) -> Column:
    """A dispatched target runs again an interval from now, however late it was."""
    return F.timestamp_micros(F.unix_micros(now) + interval_minutes * 60_000_000)


def still_enabled(is_enabled: Column, strategy: Column, check_in: Column, today: Column) -> Column:
    """A fixed stay window that has passed switches its target off; a rolling one never passes."""
    return is_enabled & ~((strategy == "fixed") & F.coalesce(check_in < today, F.lit(False)))


def circuits(runs: DataFrame, open_after: int = OPEN_AFTER) -> DataFrame:
    """(target_id, state, failures, n_runs, n_opened) after each target's runs (target_id, run_id, ran_at, ok, refused) in order of time.

    Success closes and clears; a refusal, a failed probe, or `open_after` failures in a row open. An open circuit's next run is its probe.
    """
    # Between two successes lies a streak of failures. It opens once at the most: by a refusal, by its length, and while
    # open every further failure is a failed probe. So a streak needs its length and whether it was refused, no state.
    line = Window.partitionBy("target_id").orderBy("ran_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    streaks = runs.withColumn("streak", F.count_if("ok").over(line)).groupBy("target_id", "streak").agg(F.count_if(~F.col("ok")).alias("failures"), F.coalesce(F.bool_or(~F.col("ok") & F.col("refused")), F.lit(False)).alias("refused"), F.count("*").alias("n"))
    judged = streaks.withColumn("open", F.col("refused") | (F.col("failures") >= open_after))
    last = F.max_by(F.struct(F.when(F.col("open"), "open").otherwise("closed").alias("state"), "failures"), "streak")
    folded = judged.groupBy("target_id").agg(last.alias("s"), F.sum("n").alias("n_runs"), F.count_if("open").alias("n_opened"))
    return folded.select("target_id", "s.state", "s.failures", "n_runs", "n_opened")


CIRCUIT_SQL = """
SELECT target_id, state, failures, k AS n_runs, opened AS n_opened FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY k DESC) AS newest FROM circuit_walk) t WHERE newest = 1"""
CIRCUIT_CTE = """circuit_rows AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ran_at, run_id) AS k FROM target_runs),
circuit_walk AS (
  SELECT target_id, k, CASE WHEN ok THEN 'closed' WHEN refused THEN 'open' ELSE 'closed' END AS state, CASE WHEN ok THEN 0 ELSE 1 END::BIGINT AS failures, CASE WHEN NOT ok AND refused THEN 1 ELSE 0 END::BIGINT AS opened FROM circuit_rows WHERE k = 1
  UNION ALL
  SELECT r.target_id, r.k, CASE WHEN r.ok THEN 'closed' WHEN r.refused OR w.state = 'open' OR w.failures + 1 >= 5 THEN 'open' ELSE w.state END, CASE WHEN r.ok THEN 0 ELSE w.failures + 1 END,
    w.opened + CASE WHEN NOT r.ok AND (r.refused OR w.failures + 1 >= 5) AND w.state <> 'open' THEN 1 ELSE 0 END
  FROM circuit_walk w JOIN circuit_rows r ON r.target_id = w.target_id AND r.k = w.k + 1)"""


def due_groups(targets: DataFrame, hotels: DataFrame, today: Column) -> DataFrame:
    """Targets of live hotels whose stay window resolves, grouped by the page they would load: one request for each group."""
    fixed_in = F.date_add(today, F.col("lead_days").cast("int"))
    window = dates.stay_window(F.col("strategy"), today, fixed_in, F.date_add(fixed_in, F.col("stay_nights").cast("int")), F.col("lead_days").cast("int"), F.col("stay_nights").cast("int"))
    live = targets.where("is_enabled").join(hotels.where("is_active").select("hotel_id"), "hotel_id")
    ready = live.select("target_id", "hotel_id", "adults", "children", "interval_minutes", window.alias("w")).where("w.check_in is not null")
    keys = ["hotel_id", "check_in", "check_out", "adults", "children"]
    return ready.select("target_id", "hotel_id", "adults", "children", "interval_minutes", "w.check_in", "w.check_out").groupBy(*keys).agg(
        F.count("*").alias("n_targets"), F.min("target_id").alias("first_target"), F.array_join(F.transform(F.array_sort(F.collect_list("target_id")), lambda x: x.cast("string")), ",").alias("target_ids"), F.min("interval_minutes").alias("interval_minutes"))


DUE_SQL = """
SELECT hotel_id, CAST(check_in AS STRING) AS check_in, CAST(check_out AS STRING) AS check_out, adults, children, count(*) AS n_targets, min(target_id) AS first_target, string_agg(CAST(target_id AS STRING), ',' ORDER BY target_id) AS target_ids, min(interval_minutes) AS interval_minutes
FROM (SELECT t.*, today + CAST(lead_days AS INT) AS check_in, today + CAST(lead_days + stay_nights AS INT) AS check_out
      FROM {targets} t JOIN {hotels} h ON h.hotel_id = t.hotel_id CROSS JOIN (SELECT max(check_in) AS today FROM {obs}) d WHERE t.is_enabled AND h.is_active) x
GROUP BY hotel_id, check_in, check_out, adults, children"""


def token_bucket(requests: DataFrame, per_minute: float, capacity: float, penalty_seconds: int = 3600) -> DataFrame:
    """requests (source_id, at, request_id, failed) with `allowed`: a bucket for each source that refills continuously.

    A failed request halves the refill for `penalty_seconds`. Folded in order of time for each source.
    """
    rows = requests.select("source_id", F.unix_micros("at").alias("at"), "request_id", "failed")

    def step(state: tuple | None, at: int, request: int, failed: bool) -> tuple[tuple, tuple]:
        tokens, before, until = state or (float(capacity), 0, 0)
        tokens = min(capacity, tokens + (at - before) * ((per_minute / 2 if at < until else per_minute) / 60e6))
        allowed = tokens >= 1
        return (tokens - 1 if allowed else tokens, at, at + penalty_seconds * 1_000_000 if allowed and failed else until), (request, allowed)

    return fold_sorted(rows, "source_id", ["at", "request_id"], step, "request_id long, allowed boolean")
