"""Registered queries of streams and of tables that are kept up to date: stored rows come in parts, and the run is stopped and started anew between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import dates
from ..operators import detector
from ..sources import cursor, sinks
from ..streaming import ledger, timers
from . import derive
from .domain import Domain, oracle

#: Parts that a stream's rows come in, by time.
PARTS = 3


def _base(spark: SparkSession, name: str) -> str:
    return f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _in_parts(rows: DataFrame, time: str, base: str, run: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> DataFrame:
    """What run(stream) has written after the rows have come in `parts` parts in order of time; between parts the query stops and starts from its checkpoint."""
    spark = rows.sparkSession
    at = F.unix_micros(time)
    least, most = rows.agg(F.min(at), F.max(at)).first()
    rows.limit(0).write.parquet(f"{base}/in")
    for k in range(parts if least is not None else 0):
        low, high = (least + (most - least) * i // parts for i in (k, k + 1))
        rows.where((at > low if k else at >= low) & (at <= high)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        with timers.stateful(spark):
            query = run(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out") if least is not None else run(rows.limit(0))


def _successes(spark: SparkSession, sf: str) -> DataFrame:
    """Successful runs of live targets, which are to run every ten to forty days."""
    d = Domain(spark, sf)
    live = d["targets"].where("is_enabled").select("target_id", ((F.lit(10) + F.col("target_id") % 4 * 10) * 1440).alias("interval_minutes"))
    return d["target_runs"].where("ok").join(live, "target_id").select("target_id", F.col("ran_at").cast("timestamp").alias("ran_at"), "interval_minutes")


def w5_silence_alarms(spark, sf):
    """Silences of over three intervals, told by a timer for each target that each success sets anew."""
    out = _in_parts(_successes(spark, sf), "ran_at", _base(spark, "silence"), timers.silence_alarms)
    return out.select("target_id", "last_success_us", "stale_us")


W5_SQL = """
SELECT target_id, CAST(moment AS BIGINT) AS last_success_us, CAST(moment + allowed AS BIGINT) AS stale_us FROM (
  SELECT target_id, moment, allowed, lead(moment) OVER (PARTITION BY target_id ORDER BY moment) AS following, max(moment) OVER () - 86400000000 AS watermark FROM (
    SELECT DISTINCT r.target_id, US(r.ran_at) AS moment, (10 + r.target_id % 4 * 10) * 1440 * 180000000 AS allowed FROM {target_runs} r JOIN {targets} t ON t.target_id = r.target_id WHERE t.is_enabled AND r.ok) s) g
WHERE CASE WHEN following IS NULL THEN moment + allowed < watermark ELSE following > moment + allowed END"""


def w4_quiet_release(spark, sf):
    """Orders as messages: those of quiet hours wait in their recipient's list until a timer releases them in order."""
    o = derive.load(spark, sf, "orders")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 977 % 86400)
    quiet = dates.in_quiet_hours(dates.second_of_day(F.from_utc_timestamp(at, "Asia/Kolkata")), F.lit(22 * 3600), F.lit(7 * 3600))
    messages = o.select(F.col("o_custkey").alias("recipient_id"), F.col("o_orderkey").alias("message_id"), at.alias("at"), F.when(quiet, dates.release_time(at, F.lit(7 * 3600), "Asia/Kolkata")).alias("release_at"))
    return _in_parts(messages, "at", _base(spark, "held"), timers.released).select("recipient_id", "message_id", "at_us", "released_us", "place")


W4_SQL = """
SELECT o_custkey AS recipient_id, o_orderkey AS message_id, CAST(moment * 1000000 AS BIGINT) AS at_us, CAST(coalesce(release, moment) * 1000000 AS BIGINT) AS released_us,
  CAST(CASE WHEN release IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY o_custkey, release ORDER BY moment, o_orderkey) END AS BIGINT) AS place
FROM (SELECT *, CASE WHEN s >= 79200 OR s < 25200 THEN moment - s + 25200 + CASE WHEN s >= 25200 THEN 86400 ELSE 0 END END AS release, max(moment) OVER () - 3600 AS watermark
  FROM (SELECT o_custkey, o_orderkey, moment, (moment + 19800) % 86400 AS s FROM (SELECT o_custkey, o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + o_orderkey * 977 % 86400 AS moment FROM orders) a) b) t
WHERE release IS NULL OR release <= watermark"""


def w10_digest_delay(spark, sf):
    """Changes handed over for digests by run, a minute after the run's newest."""
    d = Domain(spark, sf)
    told = d["steps"].where("direction is not null").select(F.col("event_id").alias("change_id"), F.col("checked_at").alias("changed_at"))
    about = d["obs"].select(F.col("event_id").alias("change_id"), "hotel_id", F.date_trunc("hour", "checked_at").alias("run_at"))
    base = _base(spark, "handed")
    told.join(about, "change_id").write.parquet(f"{base}/changes")
    changes = spark.read.schema("change_id long, changed_at timestamp, hotel_id long, run_at timestamp").parquet(f"{base}/changes")
    out = _in_parts(changes, "changed_at", base, timers.handed_over)
    return out.select("hotel_id", "run_us", "handed_us", F.size("change_ids").cast("long").alias("n"), F.array_join(F.col("change_ids").cast("array<string>"), ",").alias("change_ids"))


W10_SQL = """
SELECT hotel_id, run_us, newest + 60000000 AS handed_us, n, change_ids FROM (
  SELECT hotel_id, epoch_us(date_trunc('hour', changed_at)) AS run_us, max(US(changed_at)) AS newest, count(*) AS n, string_agg(CAST(change_id AS VARCHAR), ',' ORDER BY change_id) AS change_ids FROM {changes} GROUP BY ALL) r
WHERE newest + 60000000 <= (SELECT max(US(changed_at)) // 1000 * 1000 - 3600000000 FROM {changes})"""


def w3_ledger_sink(spark, sf):
    """Observations that are delivered twice, in batches of their own, each stored once by the ledger."""
    base = _base(spark, "ledger")
    obs = derive.observations(spark, sf).select("event_id", "offer_key", "checked_at", "hotel_id", F.col("price").cast("double").alias("price"))
    for _ in range(2):
        obs.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(obs.schema).parquet(f"{base}/in")
        stream.writeStream.foreachBatch(ledger.sink(f"{base}/table", "checked_at", "event_id")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return ledger.read(spark, f"{base}/table", "event_id long, offer_key string, checked_at timestamp, hotel_id long, price double").groupBy("day", "hotel_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("price"), 2).alias("total"))


W3_SQL = "SELECT strftime(checked_at, '%Y-%m-%d') AS day, hotel_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(price), 2) AS total FROM {obs} GROUP BY ALL"


def w12_cursor_reads(spark, sf, step: int = 4_000, reads: int = 64):
    """Confirmed changes read by cursor from a table that grows while the reader is away: each once, with the id that the read began after that gave it; a micro-batch holds up to `reads` reads."""
    base = _base(spark, "cursor")
    cursor.register(spark)
    changes = Domain(spark, sf)["changes"].select("change_id", "hotel_id", "direction", F.col("delta").cast("double").alias("delta"))
    sorted_ = changes.repartitionByRange("change_id").sortWithinPartitions("change_id")
    sorted_.write.parquet(f"{base}/all")
    stored = spark.read.schema(changes.schema).parquet(f"{base}/all")
    half = stored.agg(F.max("change_id")).first()[0] or 0
    for low, high in ((0, half // 2), (half // 2, half)):
        stored.where((F.col("change_id") > low) & (F.col("change_id") <= high)).write.mode("append").parquet(f"{base}/in")
        cursor.publish(f"{base}/head", high)
        stream = spark.readStream.format("changes_by_cursor").schema("change_id long, hotel_id long, direction string, delta double, read long").option("path", f"{base}/in").option("cursor", f"{base}/cursor").option("head", f"{base}/head").option("step", step).option("reads", reads).option("read", "read").load()

        def keep(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").start()
        query.processAllAvailable()
        query.stop()
    out = spark.read.schema("change_id long, hotel_id long, direction string, delta double, read long").parquet(f"{base}/out") if half else stored.withColumn("read", F.lit(0).cast("long"))
    # Cursor order: no later read gave a smaller id.
    return out.groupBy("read").agg(F.min("change_id").alias("first"), F.max("change_id").alias("last"), F.count("*").alias("n"), F.round(F.sum("delta"), 2).alias("moved")).where("n > 0").select("first", "last", "n", "moved")


W12_SQL = """
SELECT min(change_id) AS first, max(change_id) AS last, count(*) AS n, round(sum(delta), 2) AS moved FROM (
  SELECT change_id, delta, CASE WHEN change_id <= half THEN (change_id - 1) // 4000 ELSE 1000000 + (change_id - half - 1) // 4000 END AS part
  FROM (SELECT *, max(change_id) OVER () // 2 AS half FROM {changes}) c) p GROUP BY part"""


def w11_state_retention(spark, sf, retention_seconds: int = 10_800):
    """The detector as a stream that forgets offers silent for over three hours: they start anew."""
    obs = derive.observations(spark, sf).select("offer_key", "checked_at", "event_id", "price", "is_available")
    out = _in_parts(obs, "checked_at", _base(spark, "retention"), lambda s: timers.detect_with_retention(s, retention_seconds))
    return out.where("outcome <> 'late'").select("offer_key", "event_id", "outcome", "old_price", "last_price")


def _retention_oracle() -> str:
    own = derive.OBS_SQL.replace("\nobs AS (", "\nwhole_obs AS (")
    split = """obs AS (
  SELECT * REPLACE (offer_key || '#' || CAST(sum(gap) OVER (PARTITION BY offer_key ORDER BY checked_at, event_id) AS VARCHAR) AS offer_key) FROM (
    SELECT *, CASE WHEN epoch_us(checked_at) - lag(epoch_us(checked_at)) OVER (PARTITION BY offer_key ORDER BY checked_at, event_id) > 10800000000 THEN 1 ELSE 0 END AS gap FROM whole_obs))"""
    return f"WITH RECURSIVE {own},\n{split},\n{detector.STEPS_SQL}\nSELECT regexp_replace(offer_key, '#.*', '') AS offer_key, event_id, outcome, old_price, last_price FROM steps"


def s16_monthly_table(spark, sf):
    """A table of orders by month: loaded, brought up to date in some months, expired by its directories, and read back."""
    path = f"{_base(spark, 'months')}/orders"
    o = derive.load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price"), F.lit(1).alias("version"))
    sinks.upsert_months(spark, path, o, "day", "o_orderkey", "day", newest="version")
    newer = o.where((F.month("day") == 3) & (F.col("o_orderkey") % 3 > 0)).withColumn("price", F.col("price") + 1).withColumn("version", F.lit(2))
    sinks.upsert_months(spark, path, newer, "day", "o_orderkey", "day", newest="version")
    most = o.agg(F.max("day")).first()[0]
    sinks.expire_months(spark, path, str(most or "2000-01-01"), months=36)
    table = spark.read.parquet(path) if sinks.months_of(spark, path) else o.withColumn("month", F.lit(""))
    return table.withColumn("month", F.date_format("day", "yyyy-MM")).groupBy("month").agg(F.count("*").alias("n"), F.sum(F.col("version").cast("long")).alias("versions"), F.round(F.sum("price"), 2).alias("total"))


S16T_SQL = """
SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions, round(sum(price), 2) AS total FROM (
  SELECT day, CASE WHEN newer THEN 2 ELSE 1 END AS version, CASE WHEN newer THEN price + 1 ELSE price END AS price, max(day) OVER () AS most FROM (
    SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DOUBLE) AS price, month(o_orderdate) = 3 AND o_orderkey % 3 > 0 AS newer FROM orders) a) t
WHERE strftime(day, '%Y-%m') >= strftime(date_trunc('month', most) - INTERVAL 36 MONTHS, '%Y-%m') GROUP BY 1"""


def _settings(spark, sf):
    """Settings of hotels, which change at noon of some days: floors and how many checks confirm, some left to the default."""
    n, day = F.col("hotel_id"), F.dayofmonth("check_in")
    own = derive.observations(spark, sf).select("hotel_id", "check_in").distinct().where(day % 3 < 2)
    return own.select("hotel_id", F.timestamp_seconds(F.unix_seconds(F.col("check_in").cast("timestamp")) + 43_200).alias("since"), F.when(n % 4 > 0, n * 25).cast("decimal(12,2)").alias("min_abs"), F.when(n % 3 > 0, day % 4).cast("decimal(7,2)").alias("min_pct"), F.when(day % 2 > 0, 1 + (n + day) % 3).cast("int").alias("confirm"))


def _counted(steps: DataFrame) -> DataFrame:
    return steps.groupBy("offer_key", "outcome").agg(F.count("*").alias("n"))


def c9_target_thresholds(spark, sf):
    """The fold with each hotel's settings as they held at each observation's time: walked in sorted partitions."""
    return _counted(detector.fold_stream(detector.as_of(derive.observations(spark, sf), _settings(spark, sf), "hotel_id"), own_thresholds=True))


def c9_target_thresholds_expression(spark, sf):
    """The same inside the JVM."""
    return _counted(detector.fold(detector.as_of(derive.observations(spark, sf), _settings(spark, sf), "hotel_id"), own_thresholds=True))


C9_SQL = "WITH RECURSIVE " + derive.OBS_SQL.replace("\nobs AS (", "\nplain AS (") + """,
settings AS (
  SELECT hotel_id, CAST(check_in AS TIMESTAMP) + INTERVAL 12 HOURS AS since, CASE WHEN hotel_id % 4 > 0 THEN hotel_id * 25 END AS min_abs, CASE WHEN hotel_id % 3 > 0 THEN day(check_in) % 4 END AS min_pct, CASE WHEN day(check_in) % 2 > 0 THEN 1 + (hotel_id + day(check_in)) % 3 END AS confirm
  FROM (SELECT DISTINCT hotel_id, check_in FROM plain) d WHERE day(check_in) % 3 < 2),
obs AS (
  SELECT p.*, coalesce(s.min_abs, 50) AS min_abs, coalesce(s.min_pct, 2) AS min_pct, coalesce(s.confirm, 2) AS confirm FROM plain p ASOF LEFT JOIN settings s ON p.hotel_id = s.hotel_id AND p.checked_at >= s.since),
""" + detector.STEPS_SQL.replace("< 50 OR", "< o.min_abs OR").replace("2) < 2 THEN", "2) < o.min_pct THEN").replace("ELSE 1 END < 2 THEN", "ELSE 1 END < o.confirm THEN") + """
SELECT offer_key, outcome, count(*) AS n FROM steps GROUP BY 1, 2"""


QUERIES = {f.__name__: f for f in (w10_digest_delay, w3_ledger_sink, w4_quiet_release, w5_silence_alarms, w11_state_retention, w12_cursor_reads, s16_monthly_table, c9_target_thresholds, c9_target_thresholds_expression)}
ORACLE_SQL = {"w10_digest_delay": oracle(W10_SQL), "w3_ledger_sink": oracle(W3_SQL), "w4_quiet_release": W4_SQL, "w5_silence_alarms": oracle(W5_SQL), "w11_state_retention": _retention_oracle(), "w12_cursor_reads": oracle(W12_SQL), "s16_monthly_table": S16T_SQL, "c9_target_thresholds": C9_SQL, "c9_target_thresholds_expression": C9_SQL}
