"""The ingest chain's defined cases."""

from pyspark.sql import functions as F

from lumenfare.operators import discovery, ingest

OFFER = "hotel_id long, run_at long, checked_at timestamp, event_id long, raw_name string, meal_plan string, price decimal(12,2), is_available boolean"
ROOM = "hotel_id long, room_type_id long, canonical_name string"
ALIAS = "hotel_id long, normalized string, room_type_id long"


def offers(spark, rows):
    made = spark.createDataFrame(rows, OFFER)
    stay = {"source_id": F.lit(1), "check_in": F.lit("2024-01-01").cast("date"), "check_out": F.lit("2024-01-02").cast("date"), "adults": F.lit(2), "children": F.lit(0), "refundable": F.lit(True), "currency": F.lit("INR")}
    return made.withColumns(stay)


def row(hotel, run, event, name, price="100.00", open_=True):
    from datetime import datetime, timedelta
    from decimal import Decimal

    return hotel, run, datetime(2024, 1, 1) + timedelta(hours=run, minutes=event), event, name, None, Decimal(price), open_


def test_names_rooms_and_vanished_offers(spark):
    rows = [row(1, 0, 0, "Deluxe Room"), row(1, 0, 1, "The Dlx Room"), row(1, 0, 2, None), row(1, 0, 3, "Room"), row(1, 0, 4, "Igloo"), row(1, 1, 5, "Igloo"), row(2, 0, 6, "Room"), row(2, 0, 7, "Suite "), row(2, 1, 8, "Attic")]
    rooms = spark.createDataFrame([(1, 5, "Deluxe Room")], ROOM)
    told = ingest.judged(offers(spark, rows), spark.createDataFrame([], ALIAS), rooms, F.lit(None).cast("string")).cache()
    got = {r.event_id: (r.verdict, r.room_type_id) for r in told.collect()}
    assert {e: v for e, (v, _) in got.items()} == {0: "kept", 1: "collapsed", 2: "unmatched", 3: "unmatched", 4: "kept", 5: "kept", 6: "unmatched", 7: "kept", 8: "kept"}
    assert got[0][1] == got[1][1] == 5 and got[4][1] == got[5][1] and len({got[i][1] for i in (0, 4, 7, 8)}) == 4
    seeded = ingest.seeded_rooms(offers(spark, rows), rooms).collect()
    assert [(r.hotel_id, r.name, r.canonical_name, r.sort_order, r.room_type_id) for r in seeded] == [(2, "Suite", "suite", 1, got[7][1])]
    counts = {(r.hotel_id, r.run_at): r for r in ingest.run_counters(told, ingest.completed(told)).collect()}
    # The deluxe room of the first fetch is missing from the second; so is hotel 2's suite.
    assert counts[1, 1].vanished == 1 and counts[1, 1].changed == 1 and counts[2, 1].vanished == 1
    assert (counts[1, 0].seen, counts[1, 0].unmatched, counts[1, 0].collapsed, counts[1, 0].kept, counts[1, 0].first_sights) == (5, 2, 1, 2, 2)


def test_no_offers(spark):
    told = ingest.judged(offers(spark, []), spark.createDataFrame([], ALIAS), spark.createDataFrame([], ROOM), F.lit("x"))
    assert ingest.run_counters(told, ingest.completed(told)).collect() == []


def test_repairs(spark):
    s = spark.range(1).select(F.struct(F.lit(None).cast("int").alias("attempts")).alias("s"), F.timestamp_seconds(F.lit(9)).alias("now"))
    for reset, refund, left in ((False, False, 1), (True, False, 0), (True, True, 0), (False, True, 0)):
        claimed = s.select(discovery.claim_repair(F.col("s"), F.col("now")).alias("s"), "now")
        got = claimed.select(discovery.settle_repair(F.col("s"), F.col("now"), F.lit("x"), F.lit(reset), F.lit(refund)).alias("s")).first()[0]
        assert claimed.first().s.attempts == 1 and got.attempts == left and got.last_outcome == "x"
