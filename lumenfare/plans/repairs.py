"""Registered queries of learning: configurations found on recorded pages, applied to all pages of a site, and repaired in place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mapping
from ..operators import discovery, repair
from . import derive


def _rooms(spark, sf, only=None):
    """Each order's lineitems as rooms, in order; of all orders or of those whose l_orderkey is in `only`."""
    li = derive.load(spark, sf, "lineitem")
    li = li if only is None else li.join(only, "l_orderkey", "left_semi")
    room = F.struct("l_linenumber", F.concat(F.lit("Room "), F.col("l_partkey").cast("string")).alias("name"), F.round(F.col("l_extendedprice") + 100, 2).alias("price"), (1000 + F.col("l_partkey") % 9000).cast("string").alias("whole"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(room)).alias("rooms"))


def d11_offers_by_config(spark, sf):
    """Sites whose payloads have two shapes: what discovery learns on each site's first page reads the offers of all its pages."""
    site = F.col("l_orderkey") % 10
    one = F.to_json(F.struct(F.struct(F.transform("rooms", lambda r: F.struct(r["name"].alias("room_name"), r["price"].alias("price"))).alias("rooms")).alias("data")))
    other = F.to_json(F.struct(F.transform("rooms", lambda r: F.struct(r["name"].alias("title"), F.struct(F.struct(r["price"].alias("sell rate")).alias("today")).alias("rates"))).alias("list")))
    text = F.array_join(F.transform("rooms", lambda r: F.concat(F.lit("₹ "), r["price"].cast("string"))), " ")
    pages = lambda rooms: rooms.select(site.alias("site"), F.col("l_orderkey").alias("page_id"), F.when(site % 2 == 0, one).otherwise(other).alias("payload"), text.alias("page_text"))
    # A site's first page is told by the keys, so that only its own is made for learning.
    firsts = derive.load(spark, sf, "lineitem").groupBy(site.alias("site")).agg(F.min("l_orderkey").alias("l_orderkey")).select("l_orderkey")
    first = pages(_rooms(spark, sf, firsts)).select(F.col("site").alias("page_id"), "payload", "page_text")
    learnt = discovery.candidates(first, keep=1).where("strong").select(F.col("page_id").alias("site"), F.col("path").alias("rooms_path"), F.create_map(F.lit("room_name"), F.col("name_field"), F.lit("price_inclusive"), F.col("price_field")).alias("fields"))
    return mapping.offers_by_config(pages(_rooms(spark, sf)), learnt, "site").select("site", "page_id", F.col("place").cast("long").alias("place"), "_o.raw_room_name", F.col("_o.price_inclusive").cast("double").alias("price"), "_o.error")


D11_SQL = """
SELECT l_orderkey % 10 AS site, l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Room ' || l_partkey, l_extendedprice) - 1 AS place, 'Room ' || l_partkey AS raw_room_name, CAST(round(l_extendedprice + 100, 2) AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS error FROM lineitem"""


def d17_repaired_sources(spark, sf):
    """Orders as sources whose recorded payloads, cards or texts are inspected: outcome, configuration and attempts after."""
    k = F.col("l_orderkey")
    rooms = _rooms(spark, sf)
    payload = F.to_json(F.struct(F.struct(F.transform("rooms", lambda r: F.struct(r["name"].alias("room_name"), r["price"].alias("price"))).alias("rooms")).alias("data")))
    card = lambda r: F.concat(F.lit('<li class="room"><h3>Room '), r["l_linenumber"].cast("string"), F.lit('</h3><p class="cost">Rs. '), r["whole"], F.lit("</p><p>inclusive of taxes</p></li>"))
    html = F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform("rooms", card), ""), F.lit("</ul></body></html>"))
    text = lambda mark, field: F.array_join(F.transform("rooms", lambda r: F.concat(F.lit(mark), r[field].cast("string"))), " ")
    evidence = rooms.select(
        k.alias("source_id"), F.concat(F.lit("https://x.test/v1/api/"), k.cast("string")).alias("source_url"), F.when(k % 4 < 2, payload).alias("payload"), F.when(k % 4 == 2, html).alias("html"),
        F.when(k % 4 == 0, text("₹ ", "price")).when(k % 4 == 1, text("", "price")).when(k % 4 == 2, text("Rs. ", "whole")).otherwise("No rooms, all sold out").alias("page_text"),
    )
    had = F.when(k % 12 == 0, F.create_map(F.lit("kind"), F.lit("json"), F.lit("rooms_path"), F.lit("data.rooms"), F.lit("field_map"), F.lit('{"room_name":"room_name","price_inclusive":"price"}'), F.lit("json_fragment"), F.concat(F.lit("api/"), k.cast("string")), F.lit("discovery_note"), F.lit("by hand"), F.lit("timeout"), F.lit("5"))).otherwise(F.create_map(F.lit("kind"), F.lit("old"), F.lit("timeout"), F.lit("5")))
    state = F.struct(F.when(k % 5 > 0, (k % 5 - 1).cast("int")).alias("attempts"), F.lit(None).cast("timestamp").alias("last_attempt_at"), F.lit(None).cast("string").alias("last_outcome"))
    sources = rooms.select(k.alias("source_id"), (k % 7 > 0).alias("enabled"), had.alias("config"), state.alias("state"))
    out = repair.rediscover(sources, evidence, F.timestamp_seconds(F.lit(1_700_000_000)))
    entries = F.array_sort(F.map_entries(F.map_filter("config", lambda key, _: key != "discovery_note")))
    return out.select("source_id", "outcome", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("config"), F.coalesce("state.attempts", F.lit(0)).cast("long").alias("attempts"))


D17_SQL = """
SELECT source_id, outcome, CASE WHEN outcome = 'repaired' AND k = 0 OR had THEN 'field_map={"room_name":"room_name","price_inclusive":"price"};json_fragment=api/' || source_id || ';kind=json;rooms_path=data.rooms;timeout=5'
    WHEN outcome = 'repaired' THEN 'kind=dom;rooms_path=li.room;selectors={"room_name":"h3","price":"p.cost"};timeout=5' ELSE 'kind=old;timeout=5' END AS config,
  CAST(CASE WHEN outcome = 'repaired' THEN 0 WHEN outcome IN ('no_change', 'unverified') THEN attempts + 1 ELSE attempts END AS BIGINT) AS attempts
FROM (
  SELECT *, CASE WHEN source_id % 7 = 0 THEN 'disabled' WHEN attempts >= 3 THEN 'attempts_used' WHEN k = 3 THEN 'unlearnable' WHEN k = 1 OR k = 0 AND NOT named OR k = 2 AND n = 1 THEN 'unverified' WHEN had THEN 'no_change' ELSE 'repaired' END AS outcome
  FROM (SELECT l_orderkey AS source_id, l_orderkey % 4 AS k, l_orderkey % 12 = 0 AS had, CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey % 5 - 1 ELSE 0 END AS attempts, count(*) AS n, count(*) <= 2 OR count(DISTINCT l_partkey) >= greatest(2, count(*) // 2) AS named FROM lineitem GROUP BY l_orderkey) a) t"""

QUERIES = {f.__name__: f for f in (d11_offers_by_config, d17_repaired_sources)}
ORACLE_SQL = {"d11_offers_by_config": D11_SQL, "d17_repaired_sources": D17_SQL}
