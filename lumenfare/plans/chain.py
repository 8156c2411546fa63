"""Registered queries of the ingest chain, of name resolution with its queue, of repairs and stays, and read queries as
DataFrame plans beside the SQL that they are held against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import session
from ..functions import dates, keys, matching, parsing
from ..operators import detector, discovery, ingest, schedule
from . import derive, ops
from .domain import Domain, oracle
from .reads import READS


def _offers(spark, sf):
    """Observations as a site shows them: fetches of six hours, rooms by raw names of five kinds."""
    k = F.col("room_type_id")
    raw = F.when(k == 0, "Std Room").when(k == 1, "Dlx Rooms").when(k == 2, "Prem. Room").when(k == 3, "The Suite").when(F.col("event_id") % 2 == 0, "Room").otherwise("Family  ROOM")
    run = F.floor(F.unix_micros("checked_at") / 21_600_000_000).cast("long")
    return derive.observations(spark, sf).withColumn("raw_name", raw).withColumn("run_at", run).drop("offer_key", "room_type_id")


def _rooms(spark, sf):
    """Every hotel's rooms, but for hotels 4 and 7, which have none; and the aliases, one at hotel 3."""
    own = F.array(*[F.struct(F.lit(k).cast("long").alias("room_type_id"), F.lit(n).alias("canonical_name")) for k, n in derive.ROOMS])
    hotels = derive.observations(spark, sf).select("hotel_id").distinct()
    return hotels.where("hotel_id not in (4, 7)").select("hotel_id", F.inline(own)), hotels.where("hotel_id = 3").select("hotel_id", F.lit("prem").alias("normalized"), F.lit(2).cast("long").alias("room_type_id"))


def _written(df, name):
    path = f"{session.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def i1_ingest(spark, sf):
    """Each fetch through the whole chain, its judged offers and its observations written once. Hotel 5 takes offers with breakfast only."""
    rooms, aliases = _rooms(spark, sf)
    offers = _written(ingest.judged(_offers(spark, sf), aliases, rooms, F.when(F.col("hotel_id") == 5, "BREAK")), "offers")
    return ingest.run_counters(offers, _written(ingest.completed(offers), "observations"))


I1_SQL = "WITH RECURSIVE " + derive.OBS_SQL.replace("\nobs AS (", "\nplain AS (") + """,
offers AS (
  SELECT *, CAST(floor(epoch_us(checked_at) / 21600000000) AS BIGINT) AS run_at, hotel_id || '/' || room_type_id || '/' || check_in AS own_key,
    CASE WHEN hotel_id = 5 AND room_type_id < 2 THEN 'filtered' WHEN room_type_id = 4 AND event_id % 2 = 0 THEN 'unmatched' ELSE 'named' END AS verdict FROM plain),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own_key, run_at ORDER BY checked_at, event_id) AS turn FROM offers WHERE verdict = 'named'),
kept AS (SELECT * FROM ranked WHERE turn = 1),
misses AS (
  SELECT k.own_key, k.hotel_id, r.run_at, r.run_end FROM (SELECT own_key, hotel_id, check_in, min(run_at) AS since FROM kept GROUP BY ALL) k
  JOIN (SELECT hotel_id, check_in, run_at, max(checked_at) AS run_end FROM kept GROUP BY ALL) r ON r.hotel_id = k.hotel_id AND r.check_in = k.check_in AND r.run_at > k.since
  WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.own_key = k.own_key AND o.run_at = r.run_at)),
line AS (
  SELECT *, lag(is_available) OVER (PARTITION BY own_key ORDER BY checked_at, event_id NULLS LAST) AS before FROM (
    SELECT own_key, hotel_id, run_at, checked_at, event_id, price, is_available FROM kept UNION ALL SELECT own_key, hotel_id, run_at, run_end, NULL, NULL, FALSE FROM misses) u),
obs AS (SELECT own_key AS offer_key, * EXCLUDE (own_key, before) FROM line WHERE event_id IS NOT NULL OR before),
""" + detector.STEPS_SQL + """
SELECT a.*, coalesce(vanished, 0) AS vanished, coalesce(first_sights, 0) AS first_sights, coalesce(pending, 0) AS pending, coalesce(changed, 0) AS changed
FROM (SELECT o.hotel_id, o.run_at, count(*) AS seen, count(*) FILTER (WHERE o.verdict = 'filtered') AS filtered, count(*) FILTER (WHERE o.verdict = 'unmatched') AS unmatched,
        count(*) FILTER (WHERE o.verdict = 'named' AND k.event_id IS NULL) AS collapsed, count(k.event_id) AS kept
      FROM offers o LEFT JOIN kept k ON k.event_id = o.event_id GROUP BY o.hotel_id, o.run_at) a
LEFT JOIN (SELECT o.hotel_id, o.run_at, count(*) FILTER (WHERE o.event_id IS NULL) AS vanished, count(*) FILTER (WHERE s.outcome = 'first_sight') AS first_sights, count(*) FILTER (WHERE s.outcome = 'pending') AS pending,
        count(*) FILTER (WHERE s.direction IS NOT NULL) AS changed
      FROM obs o JOIN steps s ON s.offer_key = o.offer_key AND s.checked_at = o.checked_at GROUP BY o.hotel_id, o.run_at) b ON b.hotel_id = a.hotel_id AND b.run_at = a.run_at"""


def r6_seeded_rooms(spark, sf):
    """The rooms that hotels without any get from their first fetch."""
    rooms, _ = _rooms(spark, sf)
    return ingest.seeded_rooms(_offers(spark, sf), rooms).select("hotel_id", "name", "canonical_name", "sort_order")


R6_SQL = """
SELECT hotel_id, arg_min(name, place) AS name, canonical_name, min(place) AS sort_order FROM (
  SELECT hotel_id, row_number() OVER (PARTITION BY hotel_id ORDER BY checked_at, event_id) - 1 AS place,
    CASE room_type_id WHEN 0 THEN 'Std Room' WHEN 1 THEN 'Dlx Rooms' WHEN 2 THEN 'Prem. Room' WHEN 3 THEN 'The Suite' ELSE CASE WHEN event_id % 2 = 0 THEN 'Room' ELSE 'Family  ROOM' END END AS name,
    CASE room_type_id WHEN 0 THEN 'standard' WHEN 1 THEN 'deluxe' WHEN 2 THEN 'prem' WHEN 3 THEN 'suite' ELSE CASE WHEN event_id % 2 = 1 THEN 'family' END END AS canonical_name
  FROM {obs} o WHERE hotel_id IN (4, 7) AND floor(US(checked_at) / 21600000000) = (SELECT min(floor(US(f.checked_at) / 21600000000)) FROM {obs} f WHERE f.hotel_id = o.hotel_id)) t
WHERE canonical_name IS NOT NULL GROUP BY hotel_id, canonical_name"""


def r8_unmatched_queue(spark, sf):
    """Parts as names met at ten hotels: the queue counts what stays unmatched and closes rows whose name resolves now."""
    p = derive.load(spark, sf, "part")
    hotel = F.col("p_partkey") % 10
    raw = F.when(F.col("p_size") % 3 == 0, "ROOM").when(F.col("p_size") % 3 == 1, "Dlx Room").otherwise("Igloo")
    met = p.select(hotel.alias("hotel_id"), raw.alias("raw_name"), F.col("p_partkey").alias("at"))
    rooms = met.select("hotel_id").distinct().select("hotel_id", F.lit(1).cast("long").alias("room_type_id"), F.lit("Deluxe Room").alias("canonical_name"))
    aliases = rooms.where("hotel_id < 3").select("hotel_id", F.lit("igloo").alias("normalized"), F.lit(1).cast("long").alias("room_type_id"))
    queue = rooms.select("hotel_id", F.explode(F.array(F.lit("igloo"), F.lit("attic"))).alias("normalized"), F.lit(5).cast("long").alias("occurrence_count"), F.lit(0).cast("long").alias("first_seen_at"), F.lit(0).cast("long").alias("last_seen_at"))
    return matching.unmatched_queue(matching.resolve(met, aliases, rooms), met, queue)


R8_SQL = """
SELECT hotel_id, normalized, CAST(sum(n) AS BIGINT) AS occurrence_count, min(a) AS first_seen_at, max(z) AS last_seen_at,
  CASE WHEN normalized = 'igloo' AND hotel_id < 3 AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 10 = hotel_id AND p_size % 3 = 2) THEN 1::BIGINT END AS resolved_to
FROM (
  SELECT DISTINCT p_partkey % 10 AS hotel_id, name AS normalized, 5 AS n, 0 AS a, 0 AS z FROM part, (VALUES ('igloo'), ('attic')) v(name)
  UNION ALL
  SELECT p_partkey % 10, CASE p_size % 3 WHEN 0 THEN 'room' ELSE 'igloo' END, count(*), min(p_partkey), max(p_partkey) FROM part WHERE p_size % 3 = 0 OR p_size % 3 = 2 AND p_partkey % 10 >= 3 GROUP BY 1, 2) t
GROUP BY hotel_id, normalized"""


def d13_repair_state(spark, sf):
    """Customers as sources under repair: an attempt claimed, and settled after a minute by success, refund or neither."""
    c = derive.load(spark, sf, "customer")
    now = F.timestamp_seconds(F.col("c_custkey"))
    before = F.struct(F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 5 - 1).cast("int")).alias("attempts"))
    t = c.withColumn("claimed", discovery.claim_repair(before, now))
    how = F.when(F.col("c_acctbal") < 0, "sold_out").when(F.col("c_mktsegment") == "MACHINERY", "repaired").otherwise("failed")
    settled = discovery.settle_repair(F.col("claimed"), F.timestamp_seconds(F.col("c_custkey") + 60), how, how == "repaired", how == "sold_out")
    t = t.withColumn("s", settled)
    return t.select("c_custkey", F.col("claimed.attempts").cast("long").alias("claimed"), F.col("claimed.last_outcome").alias("begun"), F.col("s.attempts").cast("long").alias("left_with"), F.unix_seconds("s.last_attempt_at").alias("at"), F.col("s.last_outcome").alias("outcome"))


D13_SQL = """
SELECT c_custkey, spent + 1 AS claimed, 'started' AS begun, CASE outcome WHEN 'sold_out' THEN spent WHEN 'repaired' THEN 0 ELSE spent + 1 END AS left_with, c_custkey + 60 AS at, outcome
FROM (SELECT *, greatest(c_custkey % 5 - 1, 0) AS spent, CASE WHEN c_acctbal < 0 THEN 'sold_out' WHEN c_mktsegment = 'MACHINERY' THEN 'repaired' ELSE 'failed' END AS outcome FROM customer) t"""


def t4_default_windows(spark, sf):
    """The default stays as seen at each event, by the hotel's own date, with their nights."""
    e = derive.load(spark, sf, "events").select("event_id", dates.local_today(F.col("ts").cast("timestamp")).alias("today"))
    w = e.select("event_id", "today", F.posexplode(dates.default_windows(F.col("today"))).alias("place", "w"))
    return w.select("event_id", F.col("today").cast("string").alias("today"), F.col("place").cast("long").alias("place"), F.col("w.check_in").cast("string").alias("check_in"), F.col("w.check_out").cast("string").alias("check_out"), keys.nights(F.col("w.check_in"), F.col("w.check_out")).cast("long").alias("nights"))


T4_SQL = """
SELECT event_id, CAST(today AS VARCHAR) AS today, place, CAST(today + ahead AS VARCHAR) AS check_in, CAST(today + ahead + 1 AS VARCHAR) AS check_out, 1::BIGINT AS nights
FROM (SELECT event_id, today, place::BIGINT AS place, CASE place WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 1 + (11 - CAST(isodow(today) AS INTEGER)) % 7 END AS ahead
      FROM (SELECT event_id, CAST(ts + INTERVAL 330 MINUTES AS DATE) AS today FROM events) e, (VALUES (0), (1), (2)) v(place)) t"""


def c7_rebased_fold(spark, sf):
    """The fold where two observations in five show prices without tax: each turn of basis starts the offer anew."""
    obs = derive.observations(spark, sf).withColumn("offer_key", F.concat_ws("/", "hotel_id", "room_type_id")).withColumn("basis", F.when(F.col("event_id") % 5 < 3, "inclusive").otherwise("exclusive"))
    return detector.fold_rebased(obs, "basis").groupBy("offer_key", "outcome").agg(F.count("*").alias("n"))


C7_SQL = "WITH RECURSIVE " + derive.OBS_SQL.replace("\nobs AS (", "\nplain AS (") + """,
turns AS (SELECT * REPLACE (hotel_id || '/' || room_type_id AS offer_key), event_id % 5 < 3 AS basis FROM plain),
turned AS (SELECT *, basis IS DISTINCT FROM lag(basis) OVER (PARTITION BY offer_key ORDER BY checked_at, event_id) AS turned FROM turns),
obs AS (SELECT event_id, checked_at, is_available, price, offer_key || '#' || sum(CAST(turned AS INTEGER)) OVER (PARTITION BY offer_key ORDER BY checked_at, event_id) AS offer_key FROM turned),
""" + detector.STEPS_SQL + """
SELECT split_part(offer_key, '#', 1) AS offer_key, outcome, count(*) AS n FROM steps GROUP BY 1, 2"""


def p4_floor_prices(spark, sf):
    """Order texts as prices without a floor, and blank query parameters as null."""
    o = derive.load(spark, sf, "orders")
    text = F.concat(F.lit("Rs. "), F.floor(F.col("o_totalprice") / 10_000).cast("long").cast("string"))
    return o.select("o_orderkey", parsing.price_or_null(F.when(F.col("o_orderkey") % 3 > 0, text).otherwise("ask us")).cast("double").alias("price"), parsing.blank_as_null(F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(F.col("o_orderpriority"))).alias("parameter"))


P4_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice / 10000) AS DOUBLE) END AS price, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS parameter FROM orders"""


def q23_tonight_prices(spark, sf):
    """Each hotel's page: tonight's offers by room, a hundred of a hotel at the most, and whether it had other nights."""
    d = Domain(spark, sf)
    tonight = d["obs"].agg(F.max("check_in")).scalar()
    s = d["series"].join(d["rooms"], "room_type_id")
    past = d["series"].groupBy("hotel_id").agg((F.count_if(F.col("check_in") != tonight) > 0).alias("had_past"))
    turn = F.row_number().over(Window.partitionBy("hotel_id").orderBy("room_type_id", "offer_key"))
    page = s.where(F.col("check_in") == tonight).withColumn("place", turn.cast("long")).where("place <= 100")
    return page.join(past, "hotel_id").select("hotel_id", "place", "offer_key", "room", "current_price", "is_available", "had_past")


Q23_SQL = """
SELECT s.hotel_id, s.place, s.offer_key, r.room, s.current_price, s.is_available, EXISTS (SELECT 1 FROM {series} p WHERE p.hotel_id = s.hotel_id AND p.check_in <> s.check_in) AS had_past
FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY room_type_id, offer_key) AS place FROM {series} WHERE check_in = (SELECT max(check_in) FROM {obs})) s JOIN {rooms} r ON r.room_type_id = s.room_type_id WHERE s.place <= 100"""


def q24_changes_page(spark, sf):
    """The changes page of three local days, the newest 300."""
    d = Domain(spark, sf)
    zone = "Asia/Kolkata"
    newest = d["obs"].agg(F.max(dates.local_today(F.col("checked_at"), zone))).scalar()
    start, end = F.to_utc_timestamp(F.date_sub(newest, 3).cast("timestamp"), zone), F.to_utc_timestamp(newest.cast("timestamp"), zone)
    c = d["changes"].where((F.col("changed_at") >= start) & (F.col("changed_at") < end)).join(d["hotels"].select("hotel_id", F.col("name").alias("hotel")), "hotel_id")
    s = d["series"].select("offer_key", F.col("check_in").alias("night")).withColumn("night", F.col("night").cast("string"))
    return c.join(s, "offer_key", "left").orderBy(F.desc("changed_at"), F.desc("change_id")).limit(300).select("change_id", "hotel", "night", "direction", "old_price", "new_price", F.unix_micros("changed_at").alias("changed_at"))


Q24_SQL = """
SELECT c.change_id, h.name AS hotel, CAST(c.check_in AS STRING) AS night, c.direction, c.old_price, c.new_price, US(c.changed_at) AS changed_at
FROM (SELECT *, floor((US(changed_at) + 19800000000) / 86400000000) AS day FROM {changes}) c JOIN {hotels} h ON h.hotel_id = c.hotel_id,
  (SELECT floor((max(US(checked_at)) + 19800000000) / 86400000000) AS day FROM {obs}) n
WHERE c.day BETWEEN n.day - 3 AND n.day - 1 ORDER BY c.changed_at DESC, c.change_id DESC LIMIT 300"""


def _live(d):
    """Live targets with whether they are stale and whether their circuit is not closed."""
    now = d["target_runs"].agg(F.max("ran_at")).scalar()
    states = schedule.circuits(d["target_runs"]).select("target_id", "state")
    return d["targets"].where("is_enabled").join(states, "target_id", "left").select("target_id", "strategy", (F.col("last_success_at") < now - F.expr("interval 90 days")).alias("stale"), (F.col("state") != "closed").alias("paused"))


def q28_attention_page(spark, sf):
    """What wants a person: stale and paused targets, the hundred names that were met last without a room, the newest hundred errors, and the errors' classes."""
    d = Domain(spark, sf)
    t = _live(d)
    part = lambda df, kind, id_, note: df.select(F.lit(kind).alias("section"), id_.cast("string").alias("item"), note.cast("string").alias("note"))
    names = r8_unmatched_queue(spark, sf).where("resolved_to is null").orderBy(F.desc("last_seen_at"), "hotel_id", "normalized").limit(100)
    errors = d["errors"].orderBy(F.desc("occurred_at"), F.desc("error_id")).limit(100)
    classes = d["errors"].groupBy("error_class").agg(F.count("*").alias("n"))
    sections = [part(t.where(kind), kind, F.col("target_id"), F.col("strategy")) for kind in ("stale", "paused")] + [part(names, "unmatched", F.concat("hotel_id", F.lit("/"), "normalized"), F.col("occurrence_count")), part(errors, "error", F.col("error_id"), F.col("error_class")), part(classes, "class", F.col("error_class"), F.col("n"))]
    return reduce(lambda x, y: x.unionByName(y), sections)


def q29_attention_badge(spark, sf):
    """How much of it there is: errors, names without a room, stale and paused targets, and all together."""
    d = Domain(spark, sf)
    t = _live(d).agg(F.count_if("stale").alias("stale"), F.count_if("paused").alias("paused"))
    many = lambda df: df.agg(F.count("*")).scalar()
    out = t.select(many(d["errors"]).alias("errors"), many(r8_unmatched_queue(spark, sf).where("resolved_to is null")).alias("unmatched"), "stale", "paused")
    return out.withColumn("total", F.col("errors") + F.col("unmatched") + F.col("stale") + F.col("paused"))


_STALE = oracle("SELECT target_id, strategy FROM {targets} WHERE is_enabled AND last_success_at < (SELECT max(ran_at) FROM {target_runs}) - INTERVAL 90 DAYS")
_PAUSED = f"SELECT t.target_id, t.strategy FROM ({oracle('SELECT * FROM {targets}')}) t JOIN ({ops.ORACLE_SQL['t9_circuits']}) c ON c.target_id = t.target_id WHERE t.is_enabled AND c.state <> 'closed'"
_ERRORS = oracle("SELECT * FROM {errors}")
_UNMATCHED = f"SELECT * FROM ({R8_SQL}) q WHERE resolved_to IS NULL"
Q28_SQL = f"""
SELECT 'stale' AS section, CAST(target_id AS VARCHAR) AS item, strategy AS note FROM ({_STALE}) s
UNION ALL SELECT 'paused', CAST(target_id AS VARCHAR), strategy FROM ({_PAUSED}) p
UNION ALL SELECT 'unmatched', hotel_id || '/' || normalized, CAST(occurrence_count AS VARCHAR) FROM (SELECT * FROM ({_UNMATCHED}) u ORDER BY last_seen_at DESC, hotel_id, normalized LIMIT 100) n
UNION ALL SELECT 'error', CAST(error_id AS VARCHAR), error_class FROM (SELECT * FROM ({_ERRORS}) e ORDER BY occurred_at DESC, error_id DESC LIMIT 100) e
UNION ALL SELECT 'class', error_class, CAST(count(*) AS VARCHAR) FROM ({_ERRORS}) c GROUP BY error_class"""
Q29_SQL = f"""
SELECT errors, unmatched, stale, paused, errors + unmatched + stale + paused AS total FROM (
  SELECT (SELECT count(*) FROM ({_ERRORS}) a) AS errors, (SELECT count(*) FROM ({_UNMATCHED}) b) AS unmatched, (SELECT count(*) FROM ({_STALE}) c) AS stale, (SELECT count(*) FROM ({_PAUSED}) d) AS paused) t"""


def _series(spark, sf):
    """Each offer's present state: the fold's newest step, with its first sight and last change."""
    obs = derive.observations(spark, sf)
    steps = detector.fold_stream(obs)
    told = F.when(F.col("direction").isNotNull(), F.col("checked_at"))
    now = steps.groupBy("offer_key").agg(F.max(F.struct("checked_at", "event_id", "current_price", "is_available")).alias("s"), F.max(told).alias("last_changed_at"))
    about = obs.groupBy("offer_key").agg(*[F.any_value(c).alias(c) for c in ("hotel_id", "room_type_id", "check_in")])
    return obs, now.join(about, "offer_key").select("offer_key", "hotel_id", "room_type_id", "check_in", F.col("s.checked_at").alias("last_checked_at"), F.col("s.current_price").cast("double").alias("current_price"), F.col("s.is_available").alias("is_available"), "last_changed_at")


def _hours_before(obs, hours):
    return obs.agg(F.max(F.unix_micros("checked_at")) - hours * 3_600_000_000).scalar()


def confirmed_changes(spark, sf):
    """Every confirmed change, with its offer's place."""
    obs = derive.observations(spark, sf)
    c = detector.changes(obs).join(obs.select("event_id", "hotel_id", "room_type_id", "check_in"), "event_id")
    priced = [F.col(n).cast("double").alias(n) for n in ("old_price", "new_price", "delta", "delta_pct")]
    return c.select(F.col("event_id").alias("change_id"), "offer_key", "hotel_id", "room_type_id", F.col("check_in").cast("string").alias("check_in"), F.unix_micros("checked_at").alias("changed_at"), F.unix_micros("first_seen_at").alias("first_seen_at"), *priced, "direction")


def q1_current_prices(spark, sf):
    obs, s = _series(spark, sf)
    named = s.join(derive.hotels(spark, sf).select("hotel_id", F.col("name").alias("hotel")), "hotel_id").join(derive.rooms(spark), "room_type_id")
    return named.select("offer_key", "hotel", "room", F.col("check_in").cast("string").alias("check_in"), "current_price", "is_available", (F.unix_micros("last_checked_at") < _hours_before(obs, 3)).alias("is_stale"))


def q5_price_matrix(spark, sf):
    obs, s = _series(spark, sf)
    recent = F.coalesce(F.unix_micros("last_changed_at") >= _hours_before(obs, 24), F.lit(False))
    g = s.withColumn("recent", recent).groupBy("hotel_id", "check_in").agg(F.min(F.when(F.col("is_available"), F.col("current_price"))).alias("best_price"), F.count("*").alias("n_offers"), F.count_if("is_available").alias("n_open"), F.bool_or("recent").alias("has_recent"))
    return g.join(derive.hotels(spark, sf).select("hotel_id", F.col("name").alias("hotel")), "hotel_id").withColumn("check_in", F.col("check_in").cast("string"))


def q18_tonight(spark, sf):
    obs, s = _series(spark, sf)
    tonight = s.where(F.col("check_in") == obs.agg(F.max("check_in")).scalar())
    g = tonight.groupBy("hotel_id").agg(F.count("*").alias("n_offers"), F.count_if("is_available").alias("n_open"), F.min("current_price").alias("low"), F.max("current_price").alias("high"))
    all_ = derive.hotels(spark, sf).select("hotel_id", "name").join(g, "hotel_id", "left").na.fill(0, ["n_offers", "n_open"])
    return all_.withColumn("status", F.when(F.col("n_offers") == 0, "no_data").when(F.col("n_open") == 0, "sold_out").when(F.col("n_open") < F.col("n_offers"), "partly_open").otherwise("open"))


_ALL = {
    i1_ingest: I1_SQL, r6_seeded_rooms: oracle(R6_SQL), r8_unmatched_queue: R8_SQL, d13_repair_state: D13_SQL, t4_default_windows: T4_SQL, c7_rebased_fold: C7_SQL, p4_floor_prices: P4_SQL,
    q23_tonight_prices: oracle(Q23_SQL), q24_changes_page: oracle(Q24_SQL), q28_attention_page: Q28_SQL, q29_attention_badge: Q29_SQL, **{f: oracle(READS[f.__name__]) for f in (confirmed_changes, q1_current_prices, q5_price_matrix, q18_tonight)},
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()}
