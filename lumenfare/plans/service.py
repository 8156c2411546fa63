"""Registered queries of configuration, failure handling, sources and rendering: each over rows built of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, mapping, matching, parsing, render
from ..operators import detector, discovery, presence, routing, schedule
from ..sources import cards, payloads, sinks  # noqa: F401  (cards registers the rendered-page source)
from . import chain, derive, ops
from .domain import Domain, oracle


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def m7_url_templates(spark, sf):
    """Booking URLs of orders made templates, what was replaced, and the templates filled in again."""
    o = derive.load(spark, sf, "orders").withColumn("d", _day("o_orderdate"))
    url = F.when(F.col("o_orderkey") % 2 == 0, _text("https://stay.test/h/", "$o_custkey", "/rates?CheckIn=", "$d", "&check-out=", "$d", "&adults=2&room_config=2-1&children=&view=all")).otherwise(_text("https://stay.test/", "$d", "/", "$d", "/rooms"))
    t = o.select("o_orderkey", "d", mapping.parameterise_url(url).alias("template"), mapping.substitutions(url).alias("told"))
    again = mapping.render_template(F.col("template"), {"check_in": F.col("d"), "check_out": F.col("d"), "adults": F.lit(3), "children": F.lit(1)})
    told = F.array_join(F.transform(F.array_sort(F.map_entries("told")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return t.select("o_orderkey", "template", told.alias("replaced"), again.alias("url"), mapping.is_complete(F.col("template")).alias("complete"))


M7_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'https://stay.test/h/' || o_custkey || '/rates?CheckIn={{check_in}}&check-out={{check_out}}&adults={{adults}}&room_config={{adults}}-{{children}}&children=&view=all' ELSE 'https://stay.test/{{check_in}}/{{check_out}}/rooms' END AS template,
  CASE WHEN o_orderkey % 2 = 0 THEN 'CheckIn: ' || d || ' -> {{check_in}}; adults: 2 -> {{adults}}; check-out: ' || d || ' -> {{check_out}}; room_config: 2-1 -> {{adults}}-{{children}}' ELSE 'path date 1: ' || d || ' -> {{check_in}}; path date 2: ' || d || ' -> {{check_out}}' END AS replaced,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://stay.test/h/' || o_custkey || '/rates?CheckIn=' || d || '&check-out=' || d || '&adults=3&room_config=3-1&children=&view=all' ELSE 'https://stay.test/' || d || '/' || d || '/rooms' END AS url, TRUE AS complete
FROM (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) t""".replace("{{", "{").replace("}}", "}")


def m8_engines(spark, sf):
    """Booking engine, property id and stable endpoint of customers' URLs."""
    c = derive.load(spark, sf, "customer")
    n = F.col("c_custkey") % 6
    url = F.when(n == 0, _text("https://www.AIOSELL.com/book/", "$c_custkey", "_x?y=1")).when(n == 1, _text("https://live.ipms247.com/booking/?hotelCode=", "$c_custkey")).when(n == 2, _text("https://www.treebo.com/hotels-in-x/inn-", "$c_custkey", "/?q=1")).when(n == 3, _text("https://gotoyelagiri.com/resort/", "$c_custkey")).when(n == 4, _text("https://hotel.test/a/b/", "$c_custkey"))
    found = mapping.detect_engine(url)
    return c.select("c_custkey", found["engine"].alias("engine"), found["external_id"].alias("external_id"), mapping.json_fragment(url).alias("fragment"))


M8_SQL = """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'aiosell' WHEN 1 THEN 'ezee-letsbook' WHEN 2 THEN 'treebo' WHEN 3 THEN 'gotoyelagiri' END AS engine, CASE WHEN c_custkey % 6 = 0 THEN c_custkey || '_x' WHEN c_custkey % 6 < 4 THEN CAST(c_custkey AS VARCHAR) END AS external_id,
  CASE c_custkey % 6 WHEN 0 THEN 'book/' || c_custkey || '_x' WHEN 1 THEN 'booking' WHEN 2 THEN 'hotels-in-x/inn-' || c_custkey WHEN 3 THEN 'resort/' || c_custkey WHEN 4 THEN 'b/' || c_custkey ELSE '' END AS fragment FROM customer"""


def m4_basis_prices(spark, sf):
    li = derive.load(spark, sf, "lineitem")
    basis = F.when(F.col("l_linestatus") == "O", "exclusive").otherwise("inclusive")
    price = mapping.price_on(basis, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice") - 10))
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), price.alias("price"))


M4_SQL = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linestatus = 'O' THEN coalesce(exc, inc) ELSE coalesce(inc, exc) END AS price
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS inc, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice - 10 END AS exc FROM lineitem) t"""


def m5_room_cards(spark, sf):
    """Rendered pages built of orders' lineitems: the offers of their repeated cards."""
    li = derive.load(spark, sf, "lineitem")
    card = _text('<li class="room"><h3>Room ', "$l_linenumber", '</h3><p class="cost">Rs. ')
    whole = F.concat(card, F.lpad((1000 + F.col("l_partkey") % 9000).cast("string"), 4, "0"), F.lit("</p><p>inclusive of taxes</p></li>"))
    html = F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", whole.alias("h")))), lambda x: x["h"]), ""), F.lit("</ul></body></html>"))
    pages = li.groupBy(F.col("l_orderkey").alias("page_id")).agg(html.alias("html"), F.count("*").alias("n")).where("n > 1").select("page_id", "html")
    out = payloads.adapter("rendered_page")(pages)
    return out.select("page_id", "raw_room_name", F.col("price_inclusive").cast("double").alias("price"), "is_available", "error")


M5_SQL = """
SELECT l_orderkey AS page_id, 'Room ' || l_linenumber AS raw_room_name, CAST(1000 + l_partkey % 9000 AS DOUBLE) AS price, TRUE AS is_available, CAST(NULL AS VARCHAR) AS error
FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"""


def p10_scalars(spark, sf):
    """Truth, refunds, slugs, dates and positive decimals read off part texts."""
    p = derive.load(spark, sf, "part")
    n = (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), n)
    return p.select(
        "p_partkey", parsing.truthy(pick("true", "0", "SOLD_OUT", "perhaps", "", None)).alias("truth"), parsing.refundable(pick("Free Cancellation", "NON-REFUNDABLE", "Refundable", "no refund", "breakfast", None)).alias("refund"),
        parsing.prettify(pick("deluxe_room", "suite--sea-view", "a", "family_room_2", "x_y", None)).alias("pretty"), parsing.iso_date(pick("2024-02-29", "2023-02-29", "soon", " 2024-01-01 ", "", None)).cast("string").alias("day"), parsing.positive(pick("12.50", "0", "-3", "abc", "7", None)).cast("double").alias("positive"),
    )


P10_SQL = """
SELECT p_partkey, [TRUE, FALSE, FALSE, TRUE, FALSE, NULL][n] AS truth, [TRUE, FALSE, TRUE, FALSE, NULL, NULL][n] AS refund, ['Deluxe Room', 'Suite Sea View', 'A', 'Family Room 2', 'X Y', NULL][n] AS pretty,
  ['2024-02-29', NULL, NULL, '2024-01-01', NULL, NULL][n] AS day, CAST([12.5, NULL, NULL, NULL, 7.0, NULL][n] AS DOUBLE) AS positive FROM (SELECT p_partkey, p_partkey % 6 + 1 AS n FROM part) t"""


def d14_config_repair(spark, sf):
    """Customers as sources that want their configuration learnt anew: the gate, the merge, and what retires."""
    c = derive.load(spark, sf, "customer")
    own, found = F.create_map(F.lit("kind"), F.lit("json"), F.lit("city"), F.col("c_mktsegment")), F.create_map(F.lit("kind"), F.when(F.col("c_custkey") % 2 == 0, "dom").otherwise("json"), F.lit("discovery_note"), F.lit("n"), F.lit("city"), F.lit("lost"))
    merged = discovery.merge_config(own, found)
    gate = discovery.may_repair(F.col("c_acctbal") >= 0, (F.col("c_custkey") % 5).cast("int"), F.timestamp_seconds(F.lit(1_000_000) - F.col("c_custkey") % 3 * 86_400), F.timestamp_seconds(F.lit(1_000_000)))
    retired = discovery.names_to_retire(F.array(F.lit("Suite"), F.col("c_mktsegment")), F.array(F.lit("Suite")))
    return c.select("c_custkey", gate["allowed"].alias("allowed"), gate["reason"].alias("reason"), F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("config"), discovery.really_changed(own, merged).alias("changed"), F.array_join(retired, ",").alias("retired"))


D14_SQL = """
SELECT c_custkey, reason IS NULL AS allowed, reason, 'city=' || c_mktsegment || ';discovery_note=n;kind=' || CASE WHEN c_custkey % 2 = 0 THEN 'dom' ELSE 'json' END AS config, c_custkey % 2 = 0 AS changed, c_mktsegment AS retired
FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN 'disabled' WHEN c_custkey % 5 >= 3 THEN 'attempts_used' WHEN c_custkey % 3 = 0 THEN 'cooling_down' END AS reason FROM customer) t"""


def t13_failures(spark, sf):
    """Orders as failed calls: class, whether it may be tried again, and when."""
    o = derive.load(spark, sf, "orders")
    n = F.col("o_orderkey") % 6
    name = F.when(n == 0, "ReadTimeout").when(n == 1, "RateLimitError").when(n == 2, "PageBlocked").when(n == 3, "KeyError").when(n == 4, "ConnectError").otherwise("Odd")
    kind = F.coalesce(dates.status_class(F.when(F.col("o_custkey") % 4 == 0, 503)), dates.classify(name, F.lit("")))
    known = F.create_map(*[F.lit(x) for k, (again, most) in dates.TAXONOMY.items() for x in (k, most)])
    attempt = (F.col("o_orderkey") % 4).cast("int")
    left = F.try_element_at(known, kind) > attempt
    return o.select("o_orderkey", kind.alias("error_class"), left.alias("retries"), F.when(left, dates.retry_delay(attempt)).cast("long").alias("delay"))


T13_SQL = """
SELECT o_orderkey, kind AS error_class, most > k AS retries, CASE WHEN most > k THEN CAST(CASE k WHEN 0 THEN 30 WHEN 1 THEN 120 ELSE 480 END AS BIGINT) END AS delay
FROM (SELECT *, CASE WHEN kind IN ('timeout', 'network', 'rate_limited') THEN 3 WHEN kind = 'unknown' THEN 1 ELSE 0 END AS most, o_orderkey % 4 AS k FROM (
  SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'network' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'blocked' WHEN 3 THEN 'schema_drift' WHEN 4 THEN 'network' ELSE 'unknown' END END AS kind FROM orders) a) t"""


def t7_circuit_gate(spark, sf):
    """What each target's circuit lets through, an hour after its last run opened it or half of one."""
    c = schedule.circuits(Domain(spark, sf)["target_runs"])
    opened = F.timestamp_seconds(F.lit(1_000_000) - F.when(F.col("target_id") % 2 == 0, 3600).otherwise(1800))
    return c.select("target_id", schedule.circuit_allows(F.col("state"), opened, F.timestamp_seconds(F.lit(1_000_000))).alias("decision"))


def s18_robots(spark, sf):
    """Robots rules by status and by text, for customers' URLs."""
    c = derive.load(spark, sf, "customer")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 503, 429))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rules = c.select("c_custkey", F.lit("User-agent: *\nDisallow: /private\n").alias("robots_txt"), status.alias("status"), F.concat(F.lit("https://stay.test/"), F.when(F.col("c_custkey") % 3 == 0, "private").otherwise("rooms")).alias("url"))
    return payloads.robots_allows(spark, rules).select("c_custkey", "allowed")


S18_SQL = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 3 <> 0 WHEN 2 THEN FALSE ELSE TRUE END AS allowed FROM customer"


def s19_bot_walls(spark, sf):
    """Signs of a guarded page in pages' beginnings, with a sign put far down into some."""
    p = derive.load(spark, sf, "part")
    body = F.concat(F.repeat(F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, 100).otherwise(3000)), F.lit(" Verify you are HUMAN"))
    return p.select("p_partkey", payloads.bot_wall(F.when(F.col("p_partkey") % 5 == 0, "Just a moment..."), body).alias("sign"))


#: The title goes first and shares the window of the text behind it.
S19_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'verify you are human' WHEN p_partkey % 5 = 0 THEN 'just a moment' END AS sign FROM part"""


def s7_shared_payload(spark, sf):
    """One payload for each order of all its lineitems, of which the watched parts' are taken: those of more than size 25."""
    li = derive.load(spark, sf, "lineitem")
    node = F.struct(F.col("l_partkey").cast("string").alias("id"), F.concat(F.lit("Room "), F.col("l_linenumber").cast("string")).alias("name"), F.round("l_extendedprice", 2).cast("decimal(12,2)").alias("total"))
    p = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(node)).alias("resorts"))).alias("payload"))
    watched = derive.load(spark, sf, "part").where(F.col("p_size") > 25).select(F.col("p_partkey").cast("string").alias("external_id"), F.col("p_partkey").alias("hotel_id"))
    out = payloads.shared_payload(p, watched, "resorts", "id", {"room_name": "name", "price_inclusive": "total"})
    return out.select("l_orderkey", "hotel_id", "raw_room_name", F.col("price_inclusive").cast("double").alias("price"))


S7_SQL = """
SELECT l_orderkey, l_partkey AS hotel_id, 'Room ' || l_linenumber AS raw_room_name, CASE WHEN l_extendedprice <= 500000 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25"""


def s11_last_responses(spark, sf):
    e = derive.load(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.concat(F.lit("https://x.test/"), "event_type").alias("url"), F.col("event_id").cast("string").alias("payload"))
    return payloads.last_response(e, "purchase")


S11_SQL = "SELECT user_id AS page, CAST(max(event_id) AS VARCHAR) AS payload FROM events WHERE contains('https://x.test/' || event_type, 'purchase') GROUP BY user_id"


def s15_merged_counts(spark, sf):
    """Counters of two batches of events, merged."""
    e = derive.load(spark, sf, "events").select("user_id", F.lit(1).cast("long").alias("n"), F.col("event_id").alias("first_at"), F.col("event_id").alias("last_at"), "event_type")
    count = lambda d: d.groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return sinks.merge_counts(count(e.where("event_type = 'click'")), count(e.where("event_type <> 'click'")), "user_id")


S15_SQL = "SELECT user_id, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY user_id"


def s10_manual_offers(spark, sf):
    """Offers typed in, of which those without a price are put aside."""
    o = derive.load(spark, sf, "orders").select(F.col("o_custkey").alias("hotel_id"), (F.col("o_orderstatus") != "F").alias("is_available"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price_inclusive"), F.lit(None).cast("double").alias("price_exclusive"))
    good, bad = sinks.quarantine(payloads.manual(o))
    tell = lambda d, kind: d.groupBy("hotel_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return tell(good, "good").unionByName(tell(bad, "bad"))


S10_SQL = "SELECT o_custkey AS hotel_id, count(*) AS n, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 THEN 'bad' ELSE 'good' END AS kind FROM orders GROUP BY 1, 3"


def i2_plan_filter(spark, sf):
    obs = derive.observations(spark, sf)
    wanted = F.when(F.col("hotel_id") % 2 == 0, "BREAK")
    return obs.where(presence.plan_filter(F.col("meal_plan"), wanted)).groupBy("hotel_id").agg(F.count("*").alias("n"))


I2_SQL = "SELECT hotel_id, count(*) AS n FROM {obs} WHERE hotel_id % 2 = 1 OR room_type_id > 1 GROUP BY hotel_id"


def n15_digest_text(spark, sf):
    """Each hotel and night's changes as one message: subject, text, table and a template's values."""
    d = Domain(spark, sf)
    c = d["changes"].join(d["rooms"], "room_type_id")
    cents = lambda c: F.col(c).cast("decimal(12,2)").alias(c)
    plan = F.when(F.col("room_type_id") > 0, "Breakfast").alias("meal_plan")
    line = F.struct("change_id", "room", "direction", cents("old_price"), cents("new_price"), cents("delta"), F.col("delta_pct").cast("decimal(9,2)").alias("delta_pct"), F.lit("INR").alias("currency"), (F.col("room_type_id") == 2).alias("overnight"), F.to_date("check_in").alias("check_in"), F.date_add("check_in", 1).alias("check_out"), plan)
    # What is gathered is one message's content.
    g = c.groupBy("hotel_id", "check_in").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    hotel, lines, stamp = F.concat(F.lit("Hotel <"), F.col("hotel_id").cast("string"), F.lit(">")), F.col("lines"), F.lit("5:30 PM IST")
    return g.select("hotel_id", F.col("check_in").cast("string").alias("check_in"), render.digest_subject(hotel, lines).alias("subject"), render.digest_body(hotel, lines, stamp).alias("body"), render.digest_rows(lines).alias("html"), F.array_join(render.template_values(hotel, lines, stamp), "|").alias("params"))


def _inr(x: str) -> str:
    w = f"CAST({x} AS BIGINT)"
    return f"coalesce('₹' || CASE WHEN {w} >= 100000 THEN CAST({w} // 100000 AS VARCHAR) || ',' || lpad(CAST({w} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({w} % 1000 AS VARCHAR), 3, '0') WHEN {w} >= 1000 THEN CAST({w} // 1000 AS VARCHAR) || ',' || lpad(CAST({w} % 1000 AS VARCHAR), 3, '0') ELSE CAST({w} AS VARCHAR) END, '—')"


N15_SQL = f"""
SELECT hotel_id, CAST(check_in AS STRING) AS check_in,
  CASE WHEN count(*) = 1 THEN 'Price change: Hotel <' || hotel_id || '> — ' || min(CASE WHEN direction = 'became_unavailable' THEN room || ' sold out' ELSE room || ' ' || new END) ELSE count(*) || ' price changes: Hotel <' || hotel_id || '>' END AS subject,
  CASE WHEN count(*) = 1 THEN '🔔 Room Price Changed' ELSE '🔔 ' || count(*) || ' Room Price Changes' END || chr(10) || 'Hotel: Hotel <' || hotel_id || '>' || chr(10) || chr(10)
    || string_agg(head || chr(10) || '   Stay: ' || stay || CASE WHEN room_type_id > 0 THEN '   Plan: Breakfast' ELSE '' END || chr(10) || chr(10), '' ORDER BY change_id) || 'Checked: 5:30 PM IST' AS body,
  '<table><tr><th>Room</th><th>Was</th><th>Now</th><th>Change</th><th>Stay</th></tr>' || string_agg('<tr><td>' || room || '</td><td>' || old || '</td><td>' || CASE WHEN direction = 'became_unavailable' THEN '—' ELSE new END || '</td><td>'
    || CASE direction WHEN 'became_unavailable' THEN '<b>Sold out</b>' WHEN 'became_available' THEN '<b>Available again</b>' ELSE CASE direction WHEN 'increase' THEN '+' ELSE '−' END || moved END || '</td><td>' || stay || '</td></tr>', '' ORDER BY change_id) || '</table>' AS html,
  'Hotel <' || hotel_id || '>|' || arg_min(room, change_id) || CASE WHEN count(*) = 1 THEN '' ELSE ' +' || (count(*) - 1) || ' more' END || '|' || arg_min(old, change_id) || '|' || arg_min(new, change_id) || '|'
    || arg_min(CASE WHEN direction = 'became_unavailable' THEN 'sold out' WHEN delta IS NOT NULL THEN CASE direction WHEN 'increase' THEN '+' ELSE '-' END || moved ELSE 'now available' END, change_id) || '|' || min(stay) || '|5:30 PM IST' AS params
FROM (
  SELECT *, amount || ' (' || share || ')' AS moved, CASE direction WHEN 'became_unavailable' THEN '🚫 ' || room || ' — sold out' WHEN 'became_available' THEN '✅ ' || room || ' — available again at ' || new
    ELSE CASE direction WHEN 'increase' THEN '▲ ' ELSE '▼ ' END || room || ': ' || old || ' → ' || new || CASE WHEN room_type_id = 2 THEN ' vs last night' ELSE '' END || '  (' || CASE direction WHEN 'increase' THEN 'Increase ' ELSE 'Decrease ' END || amount || ', ' || share || ')' END AS head
  FROM (
    SELECT c.*, r.room, {_inr("old_price")} AS old, {_inr("new_price")} AS new, {_inr("abs(delta)")} AS amount, strftime(check_in, '%d %b %Y') || ' → ' || strftime(CAST(check_in AS DATE) + 1, '%d %b %Y') AS stay,
      CASE WHEN delta_pct IS NULL THEN '' ELSE CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%' END AS share
    FROM (SELECT *, i // 10 + CASE WHEN i % 10 > 5 OR i % 10 = 5 AND i // 10 % 2 = 1 THEN 1 ELSE 0 END AS t FROM (SELECT *, CAST(round(abs(delta_pct) * 100) AS BIGINT) AS i FROM {{changes}}) k) c JOIN {{rooms}} r ON r.room_type_id = c.room_type_id) a) t
GROUP BY hotel_id, check_in"""


def n17_delivery_updates(spark, sf):
    """Orders as messages whose provider tells of two states each; the newer one counts."""
    o = derive.load(spark, sf, "orders")
    one = lambda status, at: F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(status).alias("status"), at.alias("timestamp"))
    told = F.array(one("delivered", F.lit(10)), one("read", F.when(F.col("o_orderkey") % 2 == 0, 20).otherwise(5)))
    hook = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(told.alias("statuses")).alias("value"))).alias("changes"))).alias("entry")))
    messages = o.select(F.col("o_orderkey").cast("string").alias("provider_id"), F.lit("sent").alias("status"))
    return routing.status_updates(messages, o.where(F.col("o_orderkey") % 3 > 0).select(hook.alias("payload"))).select("provider_id", "status")


N17_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS provider_id, CASE WHEN o_orderkey % 3 = 0 THEN 'sent' WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'delivered' END AS status FROM orders"


def i7_error_rows(spark, sf):
    """Error rows: secrets masked, messages cut at 4000 characters as their column holds, the context kept as JSON."""
    o = derive.load(spark, sf, "orders")
    message = F.concat(F.lit("token=abc "), F.repeat(F.lit("word "), F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(2)))
    rows = o.select("*", mapping.scrub(message).alias("masked"))
    return rows.select("o_orderkey", F.length(F.substring("masked", 1, 4000)).cast("long").alias("n_chars"), F.substring("masked", 1, 16).alias("head"), F.to_json(F.struct(F.col("o_custkey").alias("target_id"), F.col("o_orderstatus").alias("status"))).alias("context"))


I7_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 4000 ELSE 27 END::BIGINT AS n_chars, 'token=[redacted]' AS head, '{"target_id":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS context FROM orders"""


def r7_new_rooms(spark, sf):
    """Rooms made for names no room resembles: one for each hotel and normal form."""
    p = derive.load(spark, sf, "part").select((F.col("p_partkey") % 10).alias("hotel_id"), F.concat(F.lit("Cabin "), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " ROOM").otherwise("")).alias("raw_name"))
    rooms = p.select("hotel_id").distinct().select("hotel_id", F.lit(0).cast("long").alias("room_type_id"), F.lit("Presidential Suite").alias("canonical_name"), F.lit(4).alias("sort_order"))
    none = p.where("false").select("hotel_id", F.col("raw_name").alias("normalized"), F.lit(0).cast("long").alias("room_type_id"))
    made = matching.new_rooms(matching.resolve(p, none, rooms.drop("sort_order")), rooms)
    return made.select("hotel_id", "canonical_name", F.col("sort_order").cast("long").alias("sort_order"))


R7_SQL = """
SELECT hotel_id, min(raw_name) AS canonical_name, 4 + row_number() OVER (PARTITION BY hotel_id ORDER BY k) AS sort_order
FROM (SELECT p_partkey % 10 AS hotel_id, p_partkey % 7 AS k, 'Cabin ' || p_partkey % 7 || CASE WHEN p_partkey % 2 = 0 THEN ' ROOM' ELSE '' END AS raw_name FROM part) t GROUP BY hotel_id, k"""


def s17_partition_months(spark, sf):
    o = derive.load(spark, sf, "orders").select(F.date_format("o_orderdate", "'price_observations_y'yyyy'm'MM").alias("name")).distinct()
    month = dates.month_of_partition(F.col("name"))
    return o.select("name", month.cast("string").alias("month"), dates.add_months(month, 13).cast("string").alias("later"))


S17_SQL = """
SELECT DISTINCT strftime(o_orderdate, 'price_observations_y%Ym%m') AS name, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(CAST(date_trunc('month', o_orderdate) + INTERVAL 13 MONTHS AS DATE) AS VARCHAR) AS later FROM orders"""


def d8_unlearnable(spark, sf):
    """Page texts made of parts: which can teach nothing, and why."""
    p = derive.load(spark, sf, "part")
    n, price = F.col("p_partkey") % 6, F.floor("p_retailprice").cast("string")
    text = F.when(n == 0, "  \n").when(n == 1, F.concat(F.lit("We are Sold Out; it was Rs. "), price)).when(n == 2, F.concat(F.lit("sold out, "), "p_name", F.lit(" "), price)).when(n == 3, F.concat("p_name", F.lit(" from € "), price)).when(n == 4, F.concat(F.lit("Room Size 134 m2 $ 99 "), "p_name"))
    return p.select("p_partkey", discovery.unlearnable(text).alias("reason"))


D8_SQL = "SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'sold_out' WHEN 2 THEN 'no_marked_price' WHEN 4 THEN 'no_marked_price' WHEN 3 THEN NULL ELSE 'no_text' END AS reason FROM part"


def n7_notifications(spark, sf):
    """Digests as notifications at 17:30 UTC (23:00 there): some were sent before, one in three recipients has quiet hours."""
    d = Domain(spark, sf)
    # Written once, without the lists of ids: the fold and each digest's hash are read three times below.
    made = chain._written(routing.digests(d["changes"], d["assignments"], d["recipients"]).select("recipient_id", "hotel_id", "dedupe_key"), "digests")
    sent = made.where(F.col("recipient_id") % 5 == 0).select("dedupe_key")
    start = F.when(F.col("recipient_id") % 3 == 0, 22 * 3600)
    out = routing.notifications(made.unionByName(made), sent, F.timestamp_seconds(F.lit(17 * 3600 + 1800)), start, F.lit(7 * 3600), "Asia/Kolkata")
    return out.select("recipient_id", "hotel_id", "dedupe_key", "held", F.unix_seconds("release_at").alias("release_at"))


N7_SQL = "SELECT recipient_id, hotel_id, dedupe_key, recipient_id % 3 = 0 AS held, CASE WHEN recipient_id % 3 = 0 THEN 86400 + 5400 END::BIGINT AS release_at FROM (" + routing.DIGEST_SQL + ") d WHERE recipient_id % 5 <> 0"


def q34_replace_url(spark, sf):
    """Hotel 3 became another property at the middle of its history: its offers' fold starts anew there."""
    obs = derive.observations(spark, sf)
    turn = obs.agg(((F.min(F.unix_micros("checked_at")) + F.max(F.unix_micros("checked_at"))) / 2).cast("long")).scalar()
    steps = detector.fold_stream(obs.where((F.col("hotel_id") != 3) | (F.unix_micros("checked_at") >= turn)))
    return steps.join(obs.select("event_id", "hotel_id"), "event_id").groupBy("hotel_id").agg(F.count_if(F.col("outcome") == "first_sight").alias("offers"), F.count("*").alias("steps"))


Q34_SQL = """
SELECT hotel_id, count(DISTINCT offer_key) AS offers, count(*) AS steps FROM (
  SELECT DISTINCT hotel_id, offer_key, checked_at FROM {obs} WHERE hotel_id <> 3 OR US(checked_at) >= (SELECT CAST(floor((min(US(checked_at)) + max(US(checked_at))) / 2) AS BIGINT) FROM {obs})) t GROUP BY hotel_id"""


def d18_disallowed(spark, sf):
    """Endpoints of each customer's site that its robots rules disallow: distinct paths, the first four of them as a report's note."""
    o = derive.load(spark, sf, "orders").select(F.col("o_custkey").alias("site"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/api/").otherwise("/web/"), F.lpad((F.col("o_orderkey") % 6).cast("string"), 2, "0")).alias("path")).distinct()
    rules = o.select("site", "path", F.lit("User-agent: *\nDisallow: /api/\n").alias("robots_txt"), F.lit(200).alias("status"), F.concat(F.lit("https://stay.test"), "path").alias("url"))
    bad = payloads.robots_allows(spark, rules).where("not allowed").groupBy("site").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return bad.select("site", F.array_join(F.slice("paths", 1, 4), ",").alias("note"))


D18_SQL = """
SELECT o_custkey AS site, string_agg(DISTINCT '/api/' || lpad(CAST(o_orderkey % 6 AS VARCHAR), 2, '0'), ',' ORDER BY '/api/' || lpad(CAST(o_orderkey % 6 AS VARCHAR), 2, '0')) AS note FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey"""


def s14_insert_or_ignore(spark, sf):
    """Aliases seen in parts' names, of which the known ones and repeats are left out."""
    p = derive.load(spark, sf, "part").select((F.col("p_partkey") % 10).alias("hotel_id"), F.lower("p_brand").alias("normalized"))
    return sinks.new_rows(p, p.where("hotel_id < 3"), "hotel_id", "normalized").select("hotel_id", "normalized")


S14_SQL = "SELECT DISTINCT p_partkey % 10 AS hotel_id, lower(p_brand) AS normalized FROM part WHERE p_partkey % 10 >= 3"


def q2_history_raw(spark, sf, limit=None):
    """Every offer's observations in order; limit: the first so many of each, a reader's page."""
    o = Domain(spark, sf)["obs"]
    if limit is not None:
        o = o.withColumn("k", F.row_number().over(Window.partitionBy("offer_key").orderBy("checked_at", "event_id"))).where(F.col("k") <= limit)
    return o.orderBy("offer_key", "checked_at", "event_id").select("offer_key", F.unix_micros("checked_at").alias("checked_at"), "event_id", F.col("price").cast("double").alias("price"), "is_available")


_ALL = {
    d18_disallowed: D18_SQL, n7_notifications: oracle(N7_SQL), q34_replace_url: oracle(Q34_SQL), s14_insert_or_ignore: S14_SQL,
    m4_basis_prices: M4_SQL, m5_room_cards: M5_SQL, m7_url_templates: M7_SQL, m8_engines: M8_SQL, p10_scalars: P10_SQL, d8_unlearnable: D8_SQL, d14_config_repair: D14_SQL, t13_failures: T13_SQL, s7_shared_payload: S7_SQL,
    s10_manual_offers: S10_SQL, s11_last_responses: S11_SQL, s15_merged_counts: S15_SQL, s17_partition_months: S17_SQL, s18_robots: S18_SQL, s19_bot_walls: S19_SQL, i2_plan_filter: oracle(I2_SQL), i7_error_rows: I7_SQL, n15_digest_text: oracle(N15_SQL), n17_delivery_updates: N17_SQL, r7_new_rooms: R7_SQL,
}
T7_SQL = ops.ORACLE_SQL["t9_circuits"].removesuffix(schedule.CIRCUIT_SQL) + """
SELECT target_id, CASE WHEN state = 'closed' THEN 'run' WHEN target_id % 2 = 0 THEN 'probe' ELSE 'skip' END AS decision FROM (""" + schedule.CIRCUIT_SQL + ") c"

QUERIES = {f.__name__: f for f in (*_ALL, t7_circuit_gate, q2_history_raw)}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL.items()} | {"t7_circuit_gate": T7_SQL}
