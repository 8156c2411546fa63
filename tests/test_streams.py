"""Timers, the ledger, the cursor and monthly tables: restarts, replays, late rows and empty inputs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lumenfare.plans import streams
from lumenfare.sources import cursor, sinks
from lumenfare.streaming import ledger, timers

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def moment(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def run(spark, base, rows, schema, make):
    """One start of a stream: rows come, all that is there is taken, the query stops."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    with timers.stateful(spark):
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        q = make(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").collect()


def test_silence_is_told_once_and_late_successes_change_nothing(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "target_id long, ran_at timestamp, interval_minutes long"
    alarms = lambda s: timers.silence_alarms(s, "1 minute")
    # Three intervals of ten minutes are thirty minutes; exactly thirty is not stale.
    assert run(spark, base, [(1, moment(0), 10), (2, moment(0), 10), (1, moment(30), 10), (3, moment(20), 10)], schema, alarms) == []
    got = run(spark, base, [(1, moment(50), 10), (1, moment(40), 10)], schema, alarms)
    assert sorted((r.target_id, r.stale_us) for r in got) == [(2, int(moment(30).timestamp() * 1e6))]
    # A success after the alarm starts the target anew; another target's row moves the watermark past it again.
    got = run(spark, base, [(2, moment(60), 10), (9, moment(200), 600)], schema, alarms)
    assert sorted((r.target_id, (r.stale_us - int(DAY.timestamp() * 1e6)) // 60_000_000) for r in got) == [(1, 80), (2, 30), (2, 90), (3, 50)]


def test_held_messages_go_in_order_after_a_restart(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "recipient_id long, message_id long, at timestamp, release_at timestamp"
    free = lambda s: timers.released(s, "1 minute")
    got = run(spark, base, [(1, 12, moment(5), moment(60)), (1, 11, moment(5), moment(60)), (1, 10, moment(7), moment(60)), (2, 1, moment(3), None)], schema, free)
    assert [(r.message_id, r.place) for r in got] == [(1, 0)]
    got = run(spark, base, [(1, 9, moment(20), moment(60)), (1, 20, moment(61), moment(1500)), (2, 2, moment(70), None)], schema, free)
    assert [r.message_id for r in sorted((r for r in got if r.place), key=lambda r: r.place)] == [11, 12, 10, 9]
    assert {r.released_us for r in got if r.place} == {int(moment(60).timestamp() * 1e6)} and sorted(r.message_id for r in got if not r.place) == [1, 2]


def test_a_runs_changes_are_handed_over_together(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "hotel_id long, run_at timestamp, change_id long, changed_at timestamp"
    hand = lambda s: timers.handed_over(s, late="1 minute")
    # The newest of run 0 is at minute 5: due at 6, and the watermark stands at 5.
    assert run(spark, base, [(1, moment(0), 7, moment(2)), (1, moment(0), 5, moment(5)), (2, moment(0), 6, moment(6))], schema, hand) == []
    # A change and a repeat of it put off run 0 of hotel 1 until minute 7; hotel 2's is due at 7 too, the watermark at 8.
    got = run(spark, base, [(1, moment(0), 3, moment(6)), (1, moment(0), 3, moment(6)), (1, moment(8), 9, moment(9))], schema, hand)
    due = lambda r: (r.handed_us - int(DAY.timestamp() * 1e6)) // 60_000_000
    assert sorted((r.hotel_id, due(r), r.change_ids) for r in got) == [(1, 7, [3, 5, 7]), (2, 7, [6])]
    # What comes after its run's hand-over goes by itself.
    got = run(spark, base, [(1, moment(0), 11, moment(10)), (3, moment(60), 12, moment(60))], schema, hand)
    assert sorted((r.hotel_id, due(r), r.change_ids) for r in got)[:3] == [(1, 7, [3, 5, 7]), (1, 10, [9]), (1, 11, [11])] and len(got) == 4


def test_forgotten_offers_start_anew(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "offer_key string, checked_at timestamp, event_id long, price double, is_available boolean"
    forget = lambda s: timers.detect_with_retention(s, 3600, late="1 minute")
    run(spark, base, [("a", moment(0), 1, 1000.0, True), ("b", moment(0), 2, 1000.0, True), ("a", moment(59), 3, 2000.0, True)], schema, forget)
    got = run(spark, base, [("a", moment(100), 4, 2000.0, True), ("b", moment(61), 5, 500.0, True), ("a", moment(161), 6, None, False), ("a", moment(161), 7, 1.0, True)], schema, forget)
    assert {r.event_id: r.outcome for r in got} == {1: "first_sight", 2: "first_sight", 3: "pending", 4: "changed", 5: "first_sight", 6: "first_sight", 7: "late"}


def stream_once(spark, base, schema, **how):
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    stream.writeStream.foreachBatch(ledger.sink(f"{base}/table", "at", "id", **how)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def test_ledger_survives_a_stop_between_data_and_line(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "id long, at timestamp, v string"
    read = lambda: sorted((r.id, r.v) for r in ledger.read(spark, f"{base}/table", schema).collect())
    rows = [(k, moment(k * 700), "x") for k in range(8)]
    spark.createDataFrame(rows[:4], schema).write.parquet(f"{base}/in")
    assert read() == []

    def stop(batch):
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        stream_once(spark, base, schema, between=stop)
    assert read() == []
    stream_once(spark, base, schema)
    assert read() == [(k, "x") for k in range(4)]
    # The same rows again, with new ones and an old key of another text: what is stored stays.
    spark.createDataFrame([*rows[2:6], rows[4], (0, moment(0), "other")], schema).write.mode("append").parquet(f"{base}/in")
    stream_once(spark, base, schema)
    assert read() == [(k, "x") for k in range(6)]
    # The same micro-batch by the same number changes nothing, by another neither.
    again = spark.createDataFrame(rows[:4], schema)
    for batch in (0, 1, 17):
        ledger.sink(f"{base}/table", "at", "id")(again, batch)
    ledger.sink(f"{base}/table", "at", "id")(again.limit(0), 18)
    assert read() == [(k, "x") for k in range(6)]


def test_cursor_reads_each_change_once_across_restarts(spark, tmp_path):
    cursor.register(spark)
    base, schema = f"file://{tmp_path}", "change_id long, v string"
    seen = []

    def start(stop_at=None):
        def keep(rows, batch):
            ids = [r.change_id for r in rows.collect()]
            if stop_at is not None and len(seen) == stop_at:
                raise RuntimeError("stopped")
            seen.append(ids)

        q = spark.readStream.format("changes_by_cursor").schema(schema).option("path", f"{base}/in").option("cursor", f"{base}/cursor").option("step", 10).load().writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    some = [3 * k + 1 for k in range(20)]
    spark.createDataFrame([(k, "x") for k in some], schema).repartitionByRange(3, "change_id").sortWithinPartitions("change_id").write.parquet(f"{base}/in")
    with pytest.raises(Exception, match="stopped"):
        start(stop_at=2)
    start()
    start()
    more = [100, 101, 105]
    spark.createDataFrame([(k, "y") for k in more], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    start()
    flat = [i for ids in seen for i in ids]
    assert flat == sorted(some + more) and all(max(ids) - min(ids) < 10 for ids in seen if ids)


def test_a_batch_holds_several_reads(spark, tmp_path):
    """Reads of ten ids at most, told by the id they begin after, four of them in a micro-batch."""
    cursor.register(spark)
    base, seen = f"file://{tmp_path}", []
    ids = [3 * k + 1 for k in range(60)]
    spark.createDataFrame([(k,) for k in ids], "change_id long").repartitionByRange(3, "change_id").sortWithinPartitions("change_id").write.parquet(f"{base}/in")
    source = spark.readStream.format("changes_by_cursor").schema("read long, change_id long").option("path", f"{base}/in").option("cursor", f"{base}/cursor").option("step", 10).option("reads", 4).option("read", "read").load()
    q = source.writeStream.foreachBatch(lambda rows, batch: seen.append(sorted(rows.collect()))).option("checkpointLocation", f"{base}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    full = [b for b in seen if b]
    assert [r.change_id for b in full for r in b] == ids and all(r.read == (r.change_id - 1) // 10 * 10 for b in full for r in b)
    assert len(full) == 5 and len({r.read for r in full[0]}) == 4


def test_upsert_copies_only_touched_months(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id long, day date, v string, version int"
    day = lambda m, d=1: dt.date(2024, m, d)
    put = lambda rows: sinks.upsert_months(spark, path, spark.createDataFrame(rows, schema), "day", "id", "day", newest="version")
    files = lambda m: sorted(f for f in os.listdir(f"{tmp_path}/t/month=2024-{m:02}") if f.endswith(".parquet"))
    assert sinks.months_of(spark, path) == []
    put([(k, day(1 + k % 4, 2), "old", 1) for k in range(12)])
    before = {m: files(m) for m in range(1, 5)}
    put([(1, day(2, 2), "new", 2), (1, day(2, 2), "older", 0), (50, day(2, 3), "more", 1), (5, day(2, 2), "stale", 0)])
    assert [m for m in before if files(m) != before[m]] == [2]
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {**dict.fromkeys(range(12), "old"), 1: "new", 50: "more"}
    assert sinks.expire_months(spark, path, "2024-05-15", months=2) == ["2024-01", "2024-02"] and sinks.months_of(spark, path) == ["2024-03", "2024-04"]
    # Readers prune by the month's directory.
    plan = spark.read.parquet(path).where("month = '2024-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


@pytest.mark.parametrize("name", ["w3_ledger_sink", "w4_quiet_release", "w5_silence_alarms", "w11_state_retention", "w12_cursor_reads", "s16_monthly_table", "c9_target_thresholds", "c9_target_thresholds_expression"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    from tests.oracle import SF

    for table in ("events", "orders", "customer", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{table}.parquet")
    assert streams.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("form", ["fold", "fold_stream"])
def test_settings_hold_from_their_time_on(spark, form):
    """A target's own floors and confirmations, by the time of the observation; the default before them and where they are null."""
    from lumenfare.operators import detector

    obs = spark.createDataFrame([("a", moment(k), k, p, True, h) for h, k, p in [(1, 0, 1000.0), (1, 1, 1100.0), (1, 2, 1100.0), (1, 3, 1110.0), (1, 4, 1200.0), (1, 5, 1210.0)]], "offer_key string, checked_at timestamp, event_id long, price double, is_available boolean, hotel_id long")
    rows = [(1, moment(3), 5.0, None, 1), (1, moment(3), 1.0, None, 1), (1, moment(5), None, 50.0, None), (2, moment(0), 0.0, 0.0, 1)]
    settings = spark.createDataFrame(rows, "hotel_id long, since timestamp, min_abs double, min_pct double, confirm int")
    own = detector.as_of(obs.union(obs.withColumn("offer_key", F.lit("b")).withColumn("hotel_id", F.lit(3).cast("long"))), settings, "hotel_id")
    got = {(r.offer_key, r.event_id): r.outcome for r in getattr(detector, form)(own, own_thresholds=True).collect()}
    assert [got["a", k] for k in range(6)] == ["first_sight", "pending", "changed", "insignificant", "changed", "insignificant"]
    assert [got["b", k] for k in range(6)] == ["first_sight", "pending", "changed", "insignificant", "pending", "pending"]


@pytest.mark.parametrize("kind", ["silence", "held", "delivery"])
def test_state_is_kept_by_group(spark, tmp_path, kind):
    """State values and timers, each of which costs a call, don't grow with the number of keys."""
    from lumenfare.streaming import delivery

    base = f"file://{tmp_path}"
    rows = spark.range(4000).select(F.col("id").alias("target_id"), F.lit(moment(0)).alias("ran_at"), F.lit(10).cast("long").alias("interval_minutes"), F.col("id").alias("recipient_id"), F.col("id").alias("message_id"), F.lit(moment(0)).alias("at"), F.lit(moment(60)).alias("release_at"), F.lit(True).alias("is_active"))
    rows.write.parquet(f"{base}/in")
    make = {"silence": timers.silence_alarms, "held": timers.released, "delivery": lambda s: delivery.delivered(s, lambda m, k: (True, False, None))}[kind]
    with timers.stateful(spark):
        q = make(spark.readStream.schema(rows.schema).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert 0 < most <= 4 * timers.GROUPS


def test_cursor_ends_where_the_writer_tells(spark, tmp_path):
    """The published id bounds a read, whether it is a row or a gap, and the next read begins behind it."""
    base, seen = f"file://{tmp_path}", []
    reader = lambda: cursor.ChangeReader(spark.createDataFrame([], "change_id long").schema, {"path": f"{base}/in", "cursor": f"{base}/cursor", "head": f"{base}/head", "step": "10"})
    for ids, head in (([1, 4, 12], 15), ([16, 25, 26], 30)):
        spark.createDataFrame([(k,) for k in ids], "change_id long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        cursor.publish(f"{base}/head", head)
        r, start = reader(), {"id": cursor._kept_id(f"{base}/cursor")}
        while (end := r.latestOffset()) != start:
            seen.append([i for p in r.partitions(start, end) for b in r.read(p) for i in b.column(0).to_pylist()])
            start = end
    assert seen == [[1, 4], [12], [16, 25], [26]]


def test_expression_keeps_short_blocks(spark):
    """The fold of a long key equals the walk, and none of its steps copies more than a block and the list of blocks."""
    from lumenfare.operators import detector

    rows = [(key, moment(k), k, 1000.0 + k * k % 7 * 60, k % 11 > 0) for key, n in (("a", 4 * detector.BLOCK), ("b", detector.BLOCK - 1), ("c", 4 * detector.BLOCK + 1)) for k in range(n)]
    obs = spark.createDataFrame(rows, "offer_key string, checked_at timestamp, event_id long, price double, is_available boolean")
    one, other = (sorted(tuple(r[c] for c in ("offer_key", "event_id", "outcome", "last_price", "first_seen_at")) for r in f(obs).collect()) for f in (detector.fold, detector.fold_stream))
    assert one == other and len(one) == len(rows)
