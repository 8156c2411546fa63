"""Registered queries of delivery, log-in throttling, attaching by URL and audit snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts
from ..streaming import delivery
from . import derive, streams


def _provider(message_id: int, attempt: int) -> tuple[bool, bool, str | None]:
    """A provider's recorded answers: four in ten sent, four that may be tried again, two refused."""
    r = (message_id * 7 + attempt * 3) % 10
    return r < 4, r < 8, None if r < 4 else "unavailable" if r < 8 else "refused"


def n10_delivery(spark, sf):
    """Orders as messages: each attempt, retried by timers; one recipient in eleven is inactive."""
    o = derive.load(spark, sf, "orders")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 977 % 86400)
    messages = o.select(F.col("o_orderkey").alias("message_id"), at.alias("at"), (F.col("o_custkey") % 11 != 0).alias("is_active"))
    out = streams._in_parts(messages, "at", streams._base(spark, "delivery"), lambda s: delivery.delivered(s, _provider))
    return out.select("message_id", "attempt", "at_us", "status", "error_code")


N10_SQL = """
WITH m AS (SELECT *, max(moment) OVER () - 3600 AS watermark FROM (SELECT o_orderkey AS id, o_custkey % 11 <> 0 AS live, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + o_orderkey * 977 % 86400 AS moment FROM orders) o),
tries AS (SELECT m.*, k, (id * 7 + k * 3) % 10 AS r, moment + CASE k WHEN 1 THEN 0 WHEN 2 THEN 60 ELSE 360 END AS due FROM m, (VALUES (1), (2), (3)) v(k)),
made AS (SELECT *, bool_and(k = 1 OR due <= watermark) OVER w AND coalesce(bool_and(r BETWEEN 4 AND 7) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_made FROM tries WHERE live WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT id AS message_id, CAST(k AS BIGINT) AS attempt, CAST(due * 1000000 AS BIGINT) AS at_us, CASE WHEN r < 4 THEN 'sent' WHEN r < 8 AND k < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN r < 4 THEN NULL WHEN r < 8 THEN 'unavailable' ELSE 'refused' END AS error_code FROM made WHERE is_made
UNION ALL SELECT id, 0, CAST(moment * 1000000 AS BIGINT), 'failed', 'recipient_inactive' FROM m WHERE NOT live"""


def q36_login_throttle(spark, sf):
    """Events as log-ins, eight in ten wrong, in a time that runs two hundred times as fast."""
    e = derive.load(spark, sf, "events")
    at = F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 200"))
    tries = e.select(F.col("user_id").alias("account"), at.alias("at"), F.col("event_id").alias("attempt_id"), (F.col("event_id") * 7 % 10 >= 8).alias("ok"))
    return accounts.throttled(tries)


Q36_SQL = """
WITH RECURSIVE tries AS (SELECT user_id, event_id, epoch_us(ts) // 200 AS moment, event_id * 7 % 10 >= 8 AS ok FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS n FROM tries),
walk AS (
  SELECT user_id, n, event_id, moment, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS outcome, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS failed, CAST(NULL AS BIGINT) AS until FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.user_id, b.n, b.event_id, b.moment, CASE WHEN coalesce(w.until > b.moment, FALSE) THEN 'locked' WHEN b.ok THEN 'ok' ELSE 'failed' END,
    CASE WHEN coalesce(w.until > b.moment, FALSE) THEN w.failed WHEN b.ok THEN 0 ELSE w.failed + 1 END,
    CASE WHEN coalesce(w.until > b.moment, FALSE) THEN w.until WHEN b.ok THEN NULL WHEN w.failed + 1 >= 5 THEN b.moment + 900000000 ELSE w.until END
  FROM walk w JOIN numbered b ON b.user_id = w.user_id AND b.n = w.n + 1)
SELECT user_id AS account, event_id AS attempt_id, moment AS at_us, outcome, failed, until AS locked_until_us FROM walk"""


def q35_attach(spark, sf):
    """Orders as requests to attach a hotel by its booking URL; hotels in debt have one engine already."""
    o = derive.load(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    s = derive.load(spark, sf, "supplier")
    k, d = F.col("o_custkey").cast("string"), F.col("d")
    n = F.col("o_orderkey") % 4
    url = (
        F.when(n == 0, F.concat(F.lit("https://live.ipms247.com/booking/?hotelCode="), k, F.lit("&check_in="), d, F.lit("&checkOut="), d))
        .when(n == 1, F.concat(F.lit("https://www.aiosell.com/book/"), k, F.lit("-x")))
        .when(n == 2, F.concat(F.lit("https://www.treebo.com/stays/"), d, F.lit("/inn-"), k))
        .otherwise(F.concat(F.lit("https://hotel.test/rooms?id="), k))
    )
    had = s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("hotel_id"), F.lit("aiosell").alias("engine"))
    return accounts.attached(o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("hotel_id"), url.alias("url")), s.select(F.col("s_suppkey").alias("hotel_id")), had)


Q35_SQL = """
WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS hotel_id, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 4 AS n FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hotel_id, n ORDER BY request_id) AS place FROM r),
told AS (SELECT p.*, CASE WHEN s.s_suppkey IS NULL THEN 'no_hotel' WHEN n = 3 THEN 'unrecognised' WHEN place > 1 OR n = 1 AND s.s_acctbal < 0 THEN 'already_attached' ELSE 'attached' END AS outcome FROM ranked p LEFT JOIN supplier s ON s.s_suppkey = p.hotel_id)
SELECT request_id, hotel_id, outcome, CASE n WHEN 0 THEN 'ezee-letsbook' WHEN 1 THEN 'aiosell' WHEN 2 THEN 'treebo' END AS engine,
  CASE WHEN outcome = 'attached' THEN CASE n WHEN 0 THEN 'https://live.ipms247.com/booking/?hotelCode=' || hotel_id || '&check_in={check_in}&checkOut={check_out}' WHEN 1 THEN 'https://www.aiosell.com/book/' || hotel_id || '-x' ELSE 'https://www.treebo.com/stays/{check_in}/inn-' || hotel_id END END AS url,
  CASE WHEN outcome = 'attached' THEN CASE n WHEN 1 THEN hotel_id || '-x' ELSE CAST(hotel_id AS VARCHAR) END END AS external_id, CASE WHEN outcome = 'attached' THEN n = 1 END AS standing_rate
FROM told"""


def s24_audit_snapshots(spark, sf):
    """Orders and their lines as audit snapshots: nested rows with decimals, dates and times as JSON that keeps them exactly."""
    o, li = derive.load(spark, sf, "orders"), derive.load(spark, sf, "lineitem")
    line = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.to_date("l_shipdate").alias("day"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    met = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 3 * 500_000)
    snapshot = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("total"), at.alias("at"), F.create_map(F.col("o_orderkey") % 7, F.col("o_orderstatus")).alias("status"), F.col("lines"))
    rows = met.select("o_orderkey", snapshot.alias("after"))
    return rows.select("o_orderkey", accounts.audit_json(rows, "after").alias("after"))


S24_SQL = """
WITH li AS (SELECT l_orderkey, '[' || string_agg('{"n":' || l_linenumber || ',"price":"' || CAST(l_extendedprice AS DECIMAL(12,2)) || '","day":"' || strftime(l_shipdate, '%Y-%m-%d') || '"}', ',' ORDER BY l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)), l_shipdate) || ']' AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, '{"id":' || o_orderkey || ',"total":' || CASE WHEN o_orderkey % 5 > 0 THEN '"' || CAST(o_totalprice AS DECIMAL(12,2)) || '"' ELSE 'null' END
  || ',"at":"' || strftime(o_orderdate + to_seconds(o_orderkey % 3 // 2), '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 1 THEN '.500000' ELSE '' END || '+00:00","status":{"' || o_orderkey % 7 || '":"' || o_orderstatus || '"},"lines":' || coalesce(lines, 'null') || '}' AS after
FROM orders LEFT JOIN li ON l_orderkey = o_orderkey"""

QUERIES = {f.__name__: f for f in (n10_delivery, q35_attach, q36_login_throttle, s24_audit_snapshots)}
ORACLE_SQL = {"n10_delivery": N10_SQL, "q35_attach": Q35_SQL, "q36_login_throttle": Q36_SQL, "s24_audit_snapshots": S24_SQL}
