"""Registered queries of the operators that are more than a read: each with the SQL it is held against, where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import session
from ..functions import dates, keys, mapping, matching, parsing, render
from ..operators import carryover, detector, discovery, presence, routing, schedule
from ..sources import payloads, sinks
from ..streaming import detector as streaming
from . import derive, domain
from .domain import Domain, oracle

domain.TABLES["line"] = carryover.LINE_SQL


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


def _double(df):
    return df.select(*[F.col(c).cast("double").alias(c) if k.startswith("decimal") else F.col(c) for c, k in df.dtypes])


def k4_offer_keys(spark, sf):
    return derive.observations(spark, sf).select("event_id", "offer_key")


def k9_slugs(spark, sf):
    return derive.load(spark, sf, "part").select("p_partkey", keys.slugify(F.concat("p_name", F.lit("  & "), "p_brand")).alias("slug"))


def k6_dedupe_keys(spark, sf):
    o = derive.load(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("ids"))
    return o.select("o_custkey", keys.dedupe_key(F.col("o_custkey"), F.lit("email"), F.col("ids")).alias("dedupe_key"))


def _price_text(spark, sf):
    """Retail prices in five notations."""
    p = derive.load(spark, sf, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole, part = (cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    n = F.col("p_partkey") % 5
    text = F.when(n == 0, F.concat(F.lit("₹"), grouped, F.lit("."), part)).when(n == 1, F.concat(F.lit("From Rs. "), whole.cast("string"), F.lit(","), part)).when(n == 2, F.concat(F.lit("INR "), grouped)).when(n == 3, F.concat(F.lit("€ "), F.regexp_replace(grouped, ",", "."), F.lit(","), part)).otherwise(F.concat(whole.cast("string"), F.lit(" per night")))
    return p.select("p_partkey", text.alias("text"))


def p3_parse_prices(spark, sf):
    t = _price_text(spark, sf).withColumn("p", parsing.parse_price(F.col("text")))
    return t.select("p_partkey", F.col("p.value").cast("double").alias("price"), F.col("p.error").alias("error"), parsing.detect_currency(F.col("text")).alias("currency"))


P3_SQL = """
SELECT p_partkey, CASE WHEN v >= 100 AND v <= 500000 THEN v END AS price, CASE WHEN v < 100 OR v > 500000 THEN 'out_of_range' END AS error, CASE p_partkey % 5 WHEN 3 THEN 'EUR' ELSE 'INR' END AS currency
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN cents / 100.0 ELSE floor(cents / 100) END AS v FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT)::DOUBLE AS cents FROM part) c) t"""


def p5_text_signals(spark, sf):
    """Currency, availability, urgency and tax basis read off order texts."""
    o = derive.load(spark, sf, "orders")
    n = F.col("o_orderkey") % 6
    text = F.when(n == 0, F.concat(F.lit("Only "), (F.col("o_orderkey") % 150).cast("string"), F.lit(" rooms left!"))).when(n == 1, "Sorry, we are  SOLD OUT tonight").when(n == 2, "Rs 3,200 exclusive of tax").when(n == 3, "USD 120 inclusive of all taxes").when(n == 4, "£80 plus tax, all inclusive").otherwise("No rooms selected yet")
    t = o.select("o_orderkey", text.alias("t"))
    return t.select("o_orderkey", parsing.detect_currency(F.col("t")).alias("currency"), parsing.looks_sold_out(F.col("t")).alias("sold_out"), parsing.card_looks_sold_out(F.col("t")).alias("card_sold_out"), parsing.rooms_left(F.col("t")).cast("long").alias("rooms_left"), parsing.tax_basis(F.col("t")).alias("tax_basis"))


P5_SQL = """
SELECT o_orderkey, CASE n WHEN 3 THEN 'USD' WHEN 4 THEN 'GBP' ELSE 'INR' END AS currency, n = 1 AS sold_out, n = 1 OR n = 5 AS card_sold_out,
  CASE WHEN n = 0 AND o_orderkey % 150 BETWEEN 1 AND 100 THEN o_orderkey % 150 END AS rooms_left, CASE n WHEN 2 THEN 'exclusive' WHEN 3 THEN 'inclusive' END AS tax_basis
FROM (SELECT o_orderkey, o_orderkey % 6 AS n FROM orders) t"""


def m2_offers_from_json(spark, sf):
    """Offers by mapping from nested payloads built of lineitems."""
    li = derive.load(spark, sf, "lineitem")
    node = F.to_json(F.struct(F.concat(F.lit("Room "), F.col("l_partkey").cast("string")).alias("name"), F.struct(F.array(F.struct(F.col("l_extendedprice").cast("decimal(12,2)").alias("total"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(100)).alias("taxes"))).alias("list")).alias("rates"), F.when(F.col("l_returnflag") == "R", "SOLD_OUT").otherwise("true").alias("open")))
    plan = {"room_name": "name", "price_inclusive": "rates.list.0.total", "taxes_fees": "rates.list.0.taxes", "available": "open"}
    o = mapping.offers(li.select("l_orderkey", "l_linenumber", node.alias("node")), "node", plan)
    return o.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "_o.raw_room_name", F.col("_o.price_inclusive").cast("double").alias("price_inclusive"), F.col("_o.price_exclusive").cast("double").alias("price_exclusive"), "_o.is_available", "_o.error")


M2_SQL = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'Room ' || l_partkey AS raw_room_name, CASE WHEN l_extendedprice <= 500000 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS price_inclusive,
  CASE WHEN l_linenumber % 2 = 0 AND l_extendedprice <= 500000 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) - 100 AS DOUBLE) END AS price_exclusive, l_returnflag <> 'R' AS is_available,
  CASE WHEN l_returnflag <> 'R' AND l_extendedprice > 500000 THEN 'no_price' END AS error FROM lineitem"""


def m11_redaction(spark, sf):
    """Customer notes with secrets, masked."""
    c = derive.load(spark, sf, "customer")
    note = F.concat("c_name", F.lit(" Authorization: Bearer abc."), F.col("c_custkey").cast("string"), F.lit(" api_key=K"), F.col("c_custkey").cast("string"), F.lit(", "), F.repeat(F.lit("ab1_"), F.when(F.col("c_custkey") % 2 == 0, 10).otherwise(9)), F.lit("."))
    return c.select("c_custkey", mapping.scrub(note).alias("note"))


M11_SQL = """
SELECT c_custkey, c_name || ' Authorization: [redacted] [redacted] api_key=[redacted], ' || CASE WHEN c_custkey % 2 = 0 THEN '[redacted]' ELSE repeat('ab1_', 9) END || '.' AS note FROM customer"""


def m11_nested_redaction(spark, sf):
    """Customers' payloads with secrets under telling keys, deep in lists, and in texts."""
    k = F.col("c_custkey").cast("string")
    payload = F.concat(F.lit('{"name":"'), "c_name", F.lit('","auth":{"user":"u'), k, F.lit('","more":[1,{"x":2}]},"rooms":[{"note":"é Bearer abcdefghijkl'), k, F.lit('","Access-Key":5,"price":'), k, F.lit('},[{"PIN":null,"run":"'), F.repeat(F.lit("ab_-"), F.when(F.col("c_custkey") % 2 == 0, 11).otherwise(9)), F.lit('"}]]}'))
    return derive.load(spark, sf, "customer").select("c_custkey", mapping.scrub_json(F.when(F.col("c_custkey") % 7 > 0, payload).when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("no json, bearer  abcdefghijklmno"), k))).alias("payload"))


M11N_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN '{"name":"' || c_name || '","auth":"***REDACTED***","rooms":[{"note":"é Bearer ***REDACTED***","Access-Key":"***REDACTED***","price":' || c_custkey || '},[{"PIN":"***REDACTED***","run":"' || CASE WHEN c_custkey % 2 = 0 THEN '***REDACTED***-' ELSE repeat('ab_-', 9) END || '"}]]}'
  WHEN c_custkey % 2 = 0 THEN 'no json, bearer  ***REDACTED***' END AS payload FROM customer"""


def t2_stay_windows(spark, sf):
    o = derive.load(spark, sf, "orders")
    day, today = F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")
    w = dates.stay_window(F.when(F.col("o_orderkey") % 2 == 0, "fixed").otherwise("rolling"), today, day, F.date_add(day, 2), (F.col("o_orderkey") % 10).cast("int"), (1 + F.col("o_orderkey") % 3).cast("int"))
    return o.select("o_orderkey", w["check_in"].cast("string").alias("check_in"), w["check_out"].cast("string").alias("check_out"), dates.next_weekend(day)["check_in"].cast("string").alias("friday"), dates.is_weekend(day).alias("is_weekend"))


T2_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN CAST(DATE '1998-01-01' + CAST(o_orderkey % 10 AS INT) AS VARCHAR) WHEN d >= DATE '1998-01-01' THEN CAST(d AS VARCHAR) END AS check_in,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(DATE '1998-01-01' + CAST(o_orderkey % 10 + 1 + o_orderkey % 3 AS INT) AS VARCHAR) WHEN d >= DATE '1998-01-01' THEN CAST(d + 2 AS VARCHAR) END AS check_out,
  CAST(d + CAST((CASE WHEN isodow(d) < 5 THEN 5 - isodow(d) ELSE 12 - isodow(d) END) AS INT) AS VARCHAR) AS friday, isodow(d) IN (5, 6) AS is_weekend
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) t"""

def n1_quiet_hours(spark, sf):
    """Orders as messages of a moment: quiet or not, and when they are released."""
    o = derive.load(spark, sf, "orders")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 977 % 86400)
    local = F.from_utc_timestamp(at, "Asia/Kolkata")
    quiet = dates.in_quiet_hours(dates.second_of_day(local), F.lit(22 * 3600), F.lit(7 * 3600))
    return o.select("o_orderkey", quiet.alias("quiet"), F.when(quiet, F.unix_seconds(dates.release_time(at, F.lit(7 * 3600), "Asia/Kolkata"))).alias("release_at"))


N1_SQL = """
SELECT o_orderkey, s >= 79200 OR s < 25200 AS quiet, CASE WHEN s >= 79200 OR s < 25200 THEN CAST(moment - s + 25200 + CASE WHEN s >= 25200 THEN 86400 ELSE 0 END AS BIGINT) END AS release_at
FROM (SELECT o_orderkey, moment, (moment + 19800) % 86400 AS s FROM (SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + o_orderkey * 977 % 86400 AS moment FROM orders) a) t"""


def n13_money(spark, sf):
    c = derive.load(spark, sf, "customer")
    return c.select("c_custkey", render.money(F.col("c_acctbal") * 1000, F.lit("INR")).alias("money"), render.money(F.col("c_acctbal") * 1000, F.when(F.col("c_custkey") % 2 == 0, "usd").otherwise("CHF")).alias("other"), render.percent(F.col("c_acctbal") / 100).alias("share"), render.escape(F.concat(F.lit("<b>\""), "c_name", F.lit("\" & 'co'</b>"))).alias("escaped"))


def c11_carry_over(spark, sf):
    d = Domain(spark, sf)
    return _double(carryover.carry_over(d["obs"], d["steps"]))


def c13_carry_over_backfill(spark, sf):
    d = Domain(spark, sf)
    return _double(carryover.carry_over(d["obs"], d["steps"], final_state=True))


def c14_disappearances(spark, sf):
    out = presence.disappearances(derive.observations(spark, sf))
    return out.select("offer_key", "hotel_id", F.col("check_in").cast("string").alias("check_in"), _us("run_at"), _us("seen_at"))


def t9_circuits(spark, sf):
    return schedule.circuits(Domain(spark, sf)["target_runs"])


def t6_due_groups(spark, sf):
    d = Domain(spark, sf)
    today = d["obs"].agg(F.max("check_in")).scalar()
    out = schedule.due_groups(d["targets"], d["hotels"], today)
    return out.withColumn("check_in", F.col("check_in").cast("string")).withColumn("check_out", F.col("check_out").cast("string"))


def t10_stale_targets(spark, sf):
    d = Domain(spark, sf)
    now = d["target_runs"].agg(F.max("ran_at").cast("timestamp")).scalar()
    return d["targets"].where(F.col("is_enabled") & schedule.is_stale(F.col("last_success_at").cast("timestamp"), F.lit(None).cast("timestamp"), F.col("interval_minutes"), now)).select("target_id", "hotel_id")


T10_SQL = """
SELECT target_id, hotel_id FROM {targets} WHERE is_enabled AND epoch(last_success_at) < (SELECT max(epoch(ran_at)) FROM {target_runs}) - 180 * interval_minutes"""


def t8_next_runs(spark, sf):
    """Each target's next run after its latest dispatch."""
    d = Domain(spark, sf)
    latest = d["target_runs"].groupBy("target_id").agg(F.max("ran_at").alias("at"))
    at = schedule.next_run(F.col("at").cast("timestamp"), F.col("interval_minutes"))
    return d["targets"].join(latest, "target_id").select("target_id", F.unix_micros(at).alias("next_run_us"))


T8_SQL = """
SELECT t.target_id, CAST(max(epoch_us(CAST(r.ran_at AS TIMESTAMP))) + any_value(t.interval_minutes) * 60000000 AS BIGINT) AS next_run_us
FROM {targets} t JOIN {target_runs} r ON r.target_id = t.target_id GROUP BY t.target_id"""


def t11_expired_targets(spark, sf):
    """Targets after expired fixed windows are switched off; a fixed window begins 1,000 days and its lead after the target's first run."""
    d = Domain(spark, sf)
    runs = d["target_runs"]
    first = runs.groupBy("target_id").agg(F.min("ran_at").cast("date").alias("at"))
    today = runs.agg(F.max("ran_at").cast("date")).scalar()
    told = d["targets"].join(first, "target_id", "left")
    check_in = F.date_add("at", (F.lit(1000) + F.col("lead_days")).cast("int"))
    return told.select("target_id", "strategy", schedule.still_enabled(F.col("is_enabled"), F.col("strategy"), check_in, today).alias("is_enabled"))


T11_SQL = """
SELECT t.target_id, t.strategy, t.is_enabled AND NOT (t.strategy = 'fixed' AND coalesce(CAST(f.at AS DATE) + CAST(1000 + t.lead_days AS INTEGER) < (SELECT CAST(max(ran_at) AS DATE) FROM {target_runs}), FALSE)) AS is_enabled
FROM {targets} t LEFT JOIN (SELECT target_id, min(ran_at) AS at FROM {target_runs} GROUP BY target_id) f ON f.target_id = t.target_id"""


def n4_digests(spark, sf):
    d = Domain(spark, sf)
    return routing.digests(d["changes"], d["assignments"], d["recipients"])


def n6_suppression(spark, sf):
    d = Domain(spark, sf)
    return routing.suppression(d["changes"], d["assignments"], d["recipients"])


def n9_hourly_quota(spark, sf):
    e = derive.load(spark, sf, "events").select(F.col("user_id").alias("recipient_id"), F.col("ts").alias("at"), F.col("event_id").alias("message_id"))
    return routing.hourly_quota(e, 2).select("message_id", "recipient_id", "deferred")


N9_SQL = "SELECT event_id AS message_id, user_id AS recipient_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 2 AS deferred FROM events"


def n8_ops_alerts(spark, sf):
    return routing.ops_alerts(Domain(spark, sf)["recipients"], F.lit("silence"))


N8_SQL = "SELECT recipient_id, channel, sha256('v1|ops|' || recipient_id || '|' || channel || '|silence') AS dedupe_key FROM {recipients} WHERE is_active AND receives_ops"


def q25_delivery_state(spark, sf):
    """Orders as messages of several changes: the best state of each change."""
    o = derive.load(spark, sf, "orders")
    m = o.select(F.array("o_custkey", F.col("o_custkey") + 1).alias("change_ids"), F.element_at(F.create_map(F.lit("F"), F.lit("failed"), F.lit("O"), F.lit("sent"), F.lit("P"), F.lit("read")), F.col("o_orderstatus")).alias("status"))
    return routing.delivery_state(m)


Q25_SQL = """
SELECT change_id, CASE max(rank) WHEN 1 THEN 'failed' WHEN 3 THEN 'sent' ELSE 'read' END AS state FROM (
  SELECT unnest([o_custkey, o_custkey + 1]) AS change_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 5 END AS rank FROM orders) t GROUP BY change_id"""


def r3_room_resolution(spark, sf):
    """Part names as raw room names, resolved against aliases and each hotel's rooms."""
    p = derive.load(spark, sf, "part")
    raw = p.select((F.col("p_partkey") % 10).alias("hotel_id"), F.concat(F.element_at(F.array(*map(F.lit, ("Dlx ", "The Standard ", "Prem. ", "Suité ", "Family "))), (F.col("p_partkey") % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Room", "Dbl Room", "Room!", "rooms"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("raw_name"))
    hotels = raw.select("hotel_id").distinct()
    own = F.array(*[F.struct(F.lit(k).cast("long").alias("room_type_id"), F.lit(n).alias("canonical_name")) for k, n in derive.ROOMS])
    candidates = hotels.select("hotel_id", F.inline(own))
    aliases = hotels.select("hotel_id", F.lit("family").alias("normalized"), F.lit(4).cast("long").alias("room_type_id"))
    out = matching.resolve(raw, aliases, candidates)
    return out.select("hotel_id", "raw_name", "normalized", "room_type_id", F.round("score", 6).alias("score"), "is_exact", "suggestion_id")


def c4_fold_stream(spark, sf):
    """The fold by sorted partitions: the outcome counts of each offer."""
    return detector.fold_stream(derive.observations(spark, sf)).groupBy("offer_key", "outcome").agg(F.count("*").alias("n"))


def c4_fold_expression(spark, sf):
    """The fold as a higher-order expression: the same counts."""
    return detector.fold(derive.observations(spark, sf)).groupBy("offer_key", "outcome").agg(F.count("*").alias("n"))


def s4_keyed_rates(spark, sf):
    """Two-level keyed payloads built of lineitems: rooms by slug, in each one plan."""
    li = derive.load(spark, sf, "lineitem")
    cents = F.col("l_extendedprice")
    rate = F.struct(cents.alias("rate"), F.when(F.col("l_linenumber") % 2 == 0, cents).otherwise(cents + 100).alias("inclusive"), F.lit(50.0).alias("tax"))
    slug = F.concat(F.lit("room_"), F.col("l_partkey").cast("string"))
    room = F.struct(F.when(F.col("l_returnflag") == "A", F.lit("Named Room")).alias("displayName"), (F.col("l_linestatus") == "O").alias("available"), F.create_map(F.when(F.col("l_linenumber") % 3 == 0, "EP").otherwise("XX"), rate).alias("rates"))
    payload = F.to_json(F.create_map(slug, room))
    o = payloads.keyed_rates(li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), payload.alias("payload")))
    return _double(o)


S4_SQL = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'Named Room' ELSE 'Room ' || l_partkey END AS raw_room_name, round(r + CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE 100 END, 2) AS price_inclusive, r AS price_exclusive, 50.0::DOUBLE AS taxes_fees,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Room Only' ELSE 'XX' END AS meal_plan, l_linestatus = 'O' AS is_available FROM (SELECT *, l_extendedprice AS r FROM lineitem) t"""


def s13_idempotent_append(spark, sf):
    """Observations of which some were stored before: what an append would add."""
    o = derive.observations(spark, sf)
    return sinks.new_rows(o.union(o), o.where(F.col("is_available")), "offer_key", "checked_at").groupBy("hotel_id").agg(F.count("*").alias("n"))


S13_SQL = "SELECT hotel_id, count(*) AS n FROM (SELECT DISTINCT offer_key, checked_at, hotel_id FROM {obs} o WHERE NOT EXISTS (SELECT 1 FROM {obs} p WHERE p.offer_key = o.offer_key AND p.checked_at = o.checked_at AND p.is_available)) t GROUP BY hotel_id"


def s16_retention(spark, sf):
    """Rows by month that a retention of 48 months keeps."""
    o = derive.load(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return sinks.within_retention(o, "2001-08-01", 48).groupBy("month").agg(F.count("*").alias("n"))


S16_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-08-01' GROUP BY 1"


def s20_probe_pages(spark, sf):
    return payloads.probe_report(derive.load(spark, sf, "pages"))


def d7_discover_arrays(spark, sf):
    """Payloads built of orders and their lineitems, with blocked prices, prices under a date and lists that hold no offers; pages print prices with a currency, without, or not at all."""
    price = F.round(F.col("l_extendedprice") + 100, 2)
    room = F.struct("l_linenumber", F.concat(F.lit("Room "), F.col("l_partkey").cast("string")).alias("room_name"), (price + 500).alias("originalPrice"), F.when(F.col("l_orderkey") % 5 > 0, price).alias("price"), F.struct(F.struct(price.alias("price")).alias("2024-01-05")).alias("rates"))
    li = derive.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", room.alias("r"), price.cast("string").alias("text")))).alias("rooms"))
    k = F.col("l_orderkey") % 3
    text = F.when(k < 2, F.concat_ws(" ", F.transform("rooms", lambda r: F.concat(F.when(k == 0, "₹ ").otherwise(""), r["text"])))).otherwise("Room Size 134 m2")
    p = li.select(F.col("l_orderkey").alias("page_id"), F.to_json(F.struct(F.struct(F.transform("rooms", lambda r: r["r"]).alias("rooms"), F.array(F.struct(F.lit("Visa").alias("name"))).alias("cards")).alias("data"))).alias("payload"), text.alias("page_text"))
    return discovery.candidates(p).select("page_id", "path", "name_field", "price_field", F.col("n_rows").cast("long").alias("n_rows"), "n_names", "n_matched", "n_marked", "score", "verified", "strong", F.col("place").cast("long").alias("place"))


D7_SQL = """
SELECT l_orderkey AS page_id, 'data.rooms' AS path, 'room_name' AS name_field, 'price' AS price_field, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_names, CASE WHEN l_orderkey % 3 < 2 THEN least(count(*), 8) ELSE 0 END AS n_matched, CASE WHEN l_orderkey % 3 = 0 THEN least(count(*), 8) ELSE 0 END AS n_marked,
  CAST(round(least(count(*), 12) * 3.4 + 5 + CASE WHEN l_orderkey % 3 < 2 THEN 25 ELSE 0 END, 2) AS DOUBLE) AS score, l_orderkey % 3 < 2 AS verified, l_orderkey % 3 = 0 AS strong, 1::BIGINT AS place
FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY l_orderkey HAVING count(*) <= 2 OR count(DISTINCT l_partkey) >= greatest(2, count(*) // 2)"""


def w2_stream_outcomes(spark, sf):
    """The detector as a stream over the stored observations, one micro-batch for all that is there."""
    base = f"{session.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    derive.observations(spark, sf).select("offer_key", "checked_at", "event_id", "price", "is_available").write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    stream = streaming.detect(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("offer_key", "outcome").agg(F.count("*").alias("n"))


def w8_token_bucket(spark, sf):
    e = derive.load(spark, sf, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("request_id"), (F.col("event_type") == "error").alias("failed"))
    return schedule.token_bucket(e, per_minute=0.002, capacity=3.0)


FOLD_SQL = "SELECT offer_key, outcome, count(*) AS n FROM {steps} GROUP BY offer_key, outcome"

KEY_SQL = "SELECT event_id, offer_key FROM {obs}"
SLUG_SQL = "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || '  & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 200) AS slug FROM part"
DEDUPE_SQL = "SELECT o_custkey, sha256('v1|' || o_custkey || '|email|' || string_agg(CAST(o_orderkey AS STRING), ',' ORDER BY o_orderkey)) AS dedupe_key FROM orders GROUP BY o_custkey"
MONEY_SQL = """
SELECT c_custkey, CASE WHEN cents < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN w >= 10000000 THEN CAST(w // 10000000 AS VARCHAR) || ',' || lpad(CAST(w // 100000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(w // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0')
    WHEN w >= 100000 THEN CAST(w // 100000 AS VARCHAR) || ',' || lpad(CAST(w // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') WHEN w >= 1000 THEN CAST(w // 1000 AS VARCHAR) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END
  || CASE WHEN abs(cents) % 100 > 0 THEN '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') ELSE '' END AS money,
  CASE WHEN cents < 0 THEN '-' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '$' ELSE 'CHF ' END || CASE WHEN w >= 1000000 THEN CAST(w // 1000000 AS VARCHAR) || ',' || lpad(CAST(w // 1000 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') WHEN w >= 1000 THEN CAST(w // 1000 AS VARCHAR) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END
  || CASE WHEN abs(cents) % 100 > 0 THEN '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') ELSE '' END AS other,
  CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%' AS share, '&lt;b&gt;&quot;' || c_name || '&quot; &amp; ''co''&lt;/b&gt;' AS escaped
FROM (SELECT *, i // 1000 + CASE WHEN i % 1000 > 500 OR i % 1000 = 500 AND i // 1000 % 2 = 1 THEN 1 ELSE 0 END AS t FROM (SELECT c_custkey, c_name, CAST(round(c_acctbal * 100000) AS BIGINT) AS cents, abs(CAST(round(c_acctbal * 100000) AS BIGINT)) // 100 AS w, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS i FROM customer) u) t"""

QUERIES = {f.__name__: f for f in (k4_offer_keys, k6_dedupe_keys, k9_slugs, p3_parse_prices, p5_text_signals, m2_offers_from_json, m11_redaction, m11_nested_redaction, t2_stay_windows, t6_due_groups, t8_next_runs, t9_circuits, t10_stale_targets, t11_expired_targets, n1_quiet_hours, n4_digests, n6_suppression, n8_ops_alerts, n9_hourly_quota, n13_money, q25_delivery_state, c4_fold_stream, c4_fold_expression, c11_carry_over, c13_carry_over_backfill, c14_disappearances, r3_room_resolution, s4_keyed_rates, s13_idempotent_append, s16_retention, s20_probe_pages, d7_discover_arrays, w2_stream_outcomes, w8_token_bucket)}


def _circuit_oracle() -> str:
    made = oracle("SELECT 1 FROM {target_runs}").removesuffix("SELECT 1 FROM target_runs").rstrip()
    return made + ",\n" + schedule.CIRCUIT_CTE + schedule.CIRCUIT_SQL


ORACLE_SQL = {
    "k4_offer_keys": oracle(KEY_SQL), "k6_dedupe_keys": DEDUPE_SQL, "k9_slugs": SLUG_SQL, "p3_parse_prices": P3_SQL, "p5_text_signals": P5_SQL, "m2_offers_from_json": M2_SQL, "m11_redaction": M11_SQL, "m11_nested_redaction": M11N_SQL, "t2_stay_windows": T2_SQL,
    "t6_due_groups": oracle(schedule.DUE_SQL), "t9_circuits": _circuit_oracle(), "t8_next_runs": oracle(T8_SQL), "t10_stale_targets": oracle(T10_SQL), "t11_expired_targets": oracle(T11_SQL), "n1_quiet_hours": N1_SQL, "n4_digests": oracle(routing.DIGEST_SQL), "n6_suppression": oracle(routing.SUPPRESSION_SQL), "n8_ops_alerts": oracle(N8_SQL), "n9_hourly_quota": N9_SQL, "n13_money": MONEY_SQL,
    "q25_delivery_state": Q25_SQL, "s4_keyed_rates": S4_SQL, "s13_idempotent_append": oracle(S13_SQL), "s16_retention": S16_SQL, "d7_discover_arrays": D7_SQL, "w2_stream_outcomes": oracle(FOLD_SQL), "c4_fold_stream": oracle(FOLD_SQL), "c4_fold_expression": oracle(FOLD_SQL), "c14_disappearances": oracle(presence.SQL), **{n: oracle(s) for n, s in carryover.ORACLES.items()},
}
