"""Learning a source's configuration anew: recorded evidence is inspected, judged, and written back as set operations.

`inspect` looks at a source's recorded payloads first, then at its rendered page's cards; the first finding whose prices the
page's own numbers confirm wins. `rediscover` claims an attempt for each source that may have one, inspects, and settles it:
repaired, no_change, unverified or unlearnable (whose attempt is given back). A repair needs a price that stands beside a
currency. What it owns of the configuration is replaced, everything else stays, and the source's open errors of the kinds
that a configuration causes are resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..sources import cards
from . import discovery

#: Error classes that a new configuration can mend.
REPAIRABLE = ("parse_schema_drift", "adapter_config")


def as_config(kind: Column, path: Column, fields: Column, fragment: Column, note: Column) -> Column:
    """The parts of a configuration that discovery owns, as a map; a JSON finding has paths, a rendered one selectors."""
    text = F.to_json(fields)
    json_ = F.create_map(F.lit("kind"), F.lit("json"), F.lit("rooms_path"), path, F.lit("field_map"), text, F.lit("json_fragment"), fragment, F.lit("discovery_note"), note)
    dom = F.create_map(F.lit("kind"), F.lit("dom"), F.lit("rooms_path"), path, F.lit("selectors"), text, F.lit("discovery_note"), note)
    return F.when(kind == "json", json_).otherwise(dom)


def inspect(evidence: DataFrame) -> DataFrame:
    """(source_id, kind, path, fields, fragment, n_rooms, n_prices, n_matched, n_marked, verified, unlearnable): the best finding of each source; null kind where there is none.

    evidence: source_id, source_url, payload, html, page_text; rows of a source share its page's html and text.
    """
    pages = evidence.groupBy("source_id").agg(F.max("page_text").alias("page_text"), F.max("html").alias("html"))
    url = evidence.where("payload is not null").groupBy("source_id").agg(F.min("source_url").alias("source_url"))
    found = discovery.candidates(evidence.select(F.col("source_id").alias("page_id"), "payload", "page_text"), keep=1)
    some = lambda *pairs: F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs))), lambda _, v: v.isNotNull())
    fields = some(("room_name", F.col("name_field")), ("price_inclusive", F.col("price_field")), ("available", F.col("available_field")), ("rooms_left", F.col("left_field")))
    kinds = ["source_id", "kind", "path", "fields", "fragment", "n_rooms", "n_prices", "n_matched", "n_marked", "verified"]
    by_json = found.join(url, found["page_id"] == url["source_id"]).select(F.col("page_id").alias("source_id"), F.lit("json").alias("kind"), "path", fields.alias("fields"), mapping.json_fragment(F.col("source_url")).alias("fragment"), F.col("n_rows").cast("long").alias("n_rooms"), "n_prices", "n_matched", "n_marked", "verified").where("verified")
    # Pages that payloads told are not looked at again.
    left = pages.join(by_json.select("source_id"), "source_id", "left_anti").where("html is not null")
    card = left.select("source_id", cards.room_cards(F.col("html")).alias("c")).where("c.card_selector is not null and c.name_selector <> c.price_selector")
    card = card.select("source_id", "c.card_selector", "c.name_selector", "c.price_selector", F.col("c.n_cards").cast("long").alias("n_cards"), F.posexplode(F.slice("c.cards", 1, discovery.VALUES)).alias("k", "card"))
    priced = card.withColumn("o", cards.offer_from_card(F.col("card"))).withColumn("amount", F.coalesce("o.price_inclusive", "o.price_exclusive")).where("amount is not null")
    numbers = discovery.page_numbers(pages.select(F.col("source_id").alias("page_id"), "page_text")).select(F.col("page_id").alias("source_id"), "number", "marked")
    forms = priced.select("*", F.explode(F.array_distinct(F.array(discovery.price_digits(F.col("amount").cast("string")), F.floor("amount").cast("string")))).alias("number"))
    hit = forms.join(numbers, ["source_id", "number"], "left").groupBy("source_id", "card_selector", "name_selector", "price_selector", "n_cards", "k").agg(F.count("marked").alias("hits"), F.coalesce(F.bool_or("marked"), F.lit(False)).alias("marked"))
    summed = hit.groupBy("source_id", "card_selector", "name_selector", "price_selector", "n_cards").agg(F.count("*").alias("n_prices"), F.count_if(F.col("hits") > 0).alias("n_matched"), F.count_if("marked").alias("n_marked"))
    by_card = summed.select("source_id", F.lit("dom").alias("kind"), F.col("card_selector").alias("path"), F.create_map(F.lit("room_name"), F.col("name_selector"), F.lit("price"), F.col("price_selector")).alias("fields"), F.lit(None).cast("string").alias("fragment"), F.col("n_cards").alias("n_rooms"), "n_prices", "n_matched", "n_marked", (F.col("n_matched") * 2 >= F.col("n_prices")).alias("verified"))
    best = by_json.select(*kinds).unionByName(by_card.select(*kinds))
    return pages.join(best, "source_id", "left").select(*kinds, F.when(F.col("kind").isNull() | (F.col("kind") != "json"), discovery.unlearnable(F.col("page_text"))).alias("unlearnable"))


def rediscover(sources: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """Per source: source_id, outcome (skipped with its reason, unlearnable, unverified, no_change, repaired), config and state after.

    sources: source_id, enabled, config (map), state (attempts, last_attempt_at, last_outcome). A source without evidence is
    unlearnable: nothing of its page was read.
    """
    gate = discovery.may_repair(F.col("enabled"), F.coalesce("state.attempts", F.lit(0)), F.col("state.last_attempt_at"), now)
    asked = sources.withColumn("gate", gate).withColumn("now", now)
    seen = inspect(evidence.join(asked.where("gate.allowed").select("source_id"), "source_id", "left_semi"))
    note = F.concat(F.lit("Auto-repaired "), F.date_format("now", "yyyy-MM-dd"), F.lit(": "), F.col("n_rooms").cast("string"), F.lit(" rooms, "), F.col("n_matched").cast("string"), F.lit("/"), F.col("n_prices").cast("string"), F.lit(" prices confirmed, "), F.col("n_marked").cast("string"), F.lit(" with a currency."))
    both = asked.join(seen.withColumn("read", F.lit(True)), "source_id", "left").withColumn("unread", F.col("read").isNull()).withColumn("merged", discovery.merge_config(F.col("config"), as_config(F.col("kind"), F.col("path"), F.col("fields"), F.col("fragment"), note)))
    outcome = F.when(~F.col("gate.allowed"), F.col("gate.reason")).when(F.col("unlearnable").isNotNull() | F.col("unread"), "unlearnable").when(~F.coalesce(F.col("verified") & (F.col("n_marked") > 0), F.lit(False)), "unverified").when(~discovery.really_changed(F.col("config"), F.col("merged")), "no_change").otherwise("repaired")
    told = both.withColumn("outcome", outcome)
    claimed = discovery.claim_repair(F.col("state"), F.col("now"))
    told = told.withColumn("claimed", claimed)
    settled = discovery.settle_repair(F.col("claimed"), F.col("now"), F.col("outcome"), F.col("outcome") == "repaired", F.col("outcome") == "unlearnable")
    return told.select("source_id", "outcome", F.when(F.col("outcome") == "repaired", F.col("merged")).otherwise(F.col("config")).alias("config"), F.when(F.col("gate.allowed"), settled).otherwise(F.col("state")).alias("state"))


def resolve_errors(errors: DataFrame, repaired: DataFrame, now: Column) -> DataFrame:
    """errors (error_id, source_id, error_class, resolved_at) with those open ones resolved that a repaired source's configuration caused."""
    mended = repaired.where("outcome = 'repaired'").select("source_id", F.lit(True).alias("_mended"))
    fits = F.col("resolved_at").isNull() & F.col("error_class").isin(*REPAIRABLE) & F.coalesce("_mended", F.lit(False))
    return errors.join(mended, "source_id", "left").withColumn("resolved_at", F.when(fits, now).otherwise(F.col("resolved_at"))).drop("_mended")
