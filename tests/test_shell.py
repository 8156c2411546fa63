"""Delivery with retries, throttled log-ins, attaching by URL, audit snapshots: their cases."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from lumenfare.operators import accounts
from lumenfare.streaming import delivery
from tests.test_streams import moment, run

SECONDS = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)


def answers(message_id, attempt):
    """1 sent at once, 2 at the third attempt, 3 never, 4 refused for good."""
    ok = message_id == 1 or message_id == 2 and attempt == 3
    return ok, message_id != 4, None if ok else "down" if message_id != 4 else "refused"


def test_retries_by_timers_and_no_second_copy(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "message_id long, at timestamp, is_active boolean"
    send = lambda s: delivery.delivered(s, answers, "1 second")
    start = int(SECONDS(0).timestamp())
    told = lambda got: sorted((r.message_id, r.attempt, r.at_us // 1_000_000 - start, r.status, r.error_code) for r in got)
    got = run(spark, base, [(1, SECONDS(0), True), (2, SECONDS(0), True), (3, SECONDS(0), True), (4, SECONDS(0), True), (5, SECONDS(0), False), (6, SECONDS(0), None), (None, SECONDS(0), True)], schema, send)
    assert told(got) == [(1, 1, 0, "sent", None), (2, 1, 0, "queued", "down"), (3, 1, 0, "queued", "down"), (4, 1, 0, "failed", "refused"), (5, 0, 0, "failed", "recipient_inactive"), (6, 0, 0, "failed", "recipient_inactive")]
    # The first message comes again; the watermark passes one minute, and then six.
    got = run(spark, base, [(1, SECONDS(70), True), (7, SECONDS(70), False)], schema, send)
    assert [r for r in told(got) if r[1] == 2] == [(2, 2, 60, "queued", "down"), (3, 2, 60, "queued", "down")] and sum(r.message_id == 1 for r in got) == 1
    got = run(spark, base, [(8, SECONDS(400), False)], schema, send)
    assert [r for r in told(got) if r[1] == 3] == [(2, 3, 360, "sent", None), (3, 3, 360, "failed", "down")]
    # Two retries are passed at one go, each at its own time; a repeat of what was sent still sends nothing.
    run(spark, base, [(2, SECONDS(500), True), (33, SECONDS(500), True)], schema, send)
    got = run(spark, base, [(9, moment(60), False)], schema, send)
    assert [r[:4] for r in told(got) if r[0] in (2, 33)] == [(2, 1, 0, "queued"), (2, 2, 60, "queued"), (2, 3, 360, "sent"), (33, 1, 500, "queued"), (33, 2, 560, "queued"), (33, 3, 860, "failed")]


def test_throttled_logins(spark):
    wrong = [(1, SECONDS(k), k, False) for k in range(5)]
    after = [(1, SECONDS(10), 10, True), (1, SECONDS(904), 11, False), (1, SECONDS(905), 12, True), (1, SECONDS(3000), 13, True), (1, SECONDS(3001), 14, None), (None, SECONDS(1), 20, True), (2, SECONDS(1), 22, False), (2, SECONDS(1), 21, True)]
    rows = spark.createDataFrame(wrong + after, "account long, at timestamp, attempt_id long, ok boolean")
    got = {r.attempt_id: (r.outcome, r.failed) for r in accounts.throttled(rows).collect()}
    assert [got[k] for k in range(5)] == [("failed", k + 1) for k in range(5)]
    # Locked until 904 s, which is free again; the count stays, so one failure locks anew.
    assert got[10] == ("locked", 5) and got[11] == ("failed", 6) and got[12] == ("locked", 6) and got[13] == ("ok", 0) and got[14] == ("failed", 1)
    assert got[20] == ("ok", 0) and got[21] == ("ok", 0) and got[22] == ("failed", 1)
    assert accounts.throttled(rows.limit(0)).count() == 0


def test_attached_once(spark):
    ask = [(1, 7, "https://www.aiosell.com/book/a_b?checkin=2026-01-02"), (2, 7, "https://aiosell.com/book/zz"), (3, 7, "https://x.test/1"), (4, 8, "https://aiosell.com/book/q"), (5, 99, "https://aiosell.com/book/q"), (6, None, None), (7, 7, None), (8, 7, "https://www.treebo.com/h-12")]
    requests = spark.createDataFrame(ask, "request_id long, hotel_id long, url string").withColumn("engine", F.lit("clash"))
    hotels = spark.createDataFrame([(7,), (7,), (8,), (None,)], "hotel_id long")
    out = accounts.attached(requests, hotels, spark.createDataFrame([(8, "aiosell"), (8, "aiosell")], "hotel_id long, engine string"))
    got = {r.request_id: (r.outcome, r.url, r.external_id, r.standing_rate) for r in out.collect()}
    assert got[1] == ("attached", "https://www.aiosell.com/book/a_b?checkin={check_in}", "a_b", False) and got[2][0] == "already_attached"
    assert got[3][0] == got[7][0] == "unrecognised" and got[4][0] == "already_attached" and got[5][0] == got[6][0] == "no_hotel"
    assert got[8] == ("attached", "https://www.treebo.com/h-12", "12", True) and len(got) == len(ask) == out.count()
    added = accounts.new_sources(out, spark.createDataFrame([("treebo",)], "code string")).collect()
    assert [(r.code, r.is_enabled) for r in added] == [("aiosell", False)]


def test_audit_json(spark):
    schema = "v struct<a: decimal(5,2), b: timestamp, c: array<struct<d: date, e: decimal(3,1)>>, m: map<int, decimal(3,1)>, s: string, t: timestamp_ntz, x: double>"
    rows = spark.createDataFrame([((Decimal("1.50"), SECONDS(0), [(dt.date(2024, 1, 2), None), None], {3: Decimal("2.0")}, 'q"', dt.datetime(2024, 1, 1, 0, 0, 0, 7), 1.5),), (None,)], schema)
    got = [r[0] for r in rows.select(accounts.audit_json(rows, "v")).collect()]
    assert got == ['{"a":"1.50","b":"2024-01-01T00:00:00+00:00","c":[{"d":"2024-01-02","e":null},null],"m":{"3":"2.0"},"s":"q\\"","t":"2024-01-01T00:00:00.000007","x":1.5}', None]
