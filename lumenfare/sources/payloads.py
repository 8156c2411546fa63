"""Sources: recorded payloads and tables to offers. The network is not part of the engine; its recorded answers are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mapping, parsing

OFFER = "raw_room_name string, price_inclusive decimal(12,2), price_exclusive decimal(12,2), taxes_fees decimal(12,2), currency string, meal_plan string, refundable boolean, is_available boolean, rooms_left int, error string"

_adapters: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Make a source known under a name: a function from payloads (context columns and `payload` text) to offers."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _adapters[name] = f
        return f

    return keep


def adapter(name: str) -> Callable[..., DataFrame]:
    if name not in _adapters:
        raise KeyError(f"no source named {name}; known: {', '.join(sorted(_adapters))}")
    return _adapters[name]


@register("http_json")
def json_endpoint(payloads: DataFrame, rooms_path: str, fields: dict[str, str], currency: str = "INR") -> DataFrame:
    """A list of rooms at a path, each mapped to an offer; a bad node is a row with an error, not a lost fetch."""
    rooms = F.from_json(F.get_json_object("payload", mapping.json_path(rooms_path)), "array<string>")
    nodes = payloads.select("*", F.posexplode(rooms).alias("ordinal", "_node"))
    return mapping.offers(nodes, "_node", fields, currency).select(*payloads.columns, "ordinal", "_o.*").drop("payload")


RATE = "struct<rate: double, inclusive: double, tax: double, prices: array<struct<price: double>>>"


@register("keyed_rates")
def keyed_rates(payloads: DataFrame, plan_labels: dict[str, str] | None = None) -> DataFrame:
    """Rooms by slug, in each the meal plans by code: one offer for each room and plan.

    The first price that is present and not zero counts. A published inclusive price that equals the rate has its tax on
    top; otherwise it is trusted.
    """
    schema = f"map<string, struct<displayName: string, available: boolean, rates: map<string, {RATE}>>>"
    rooms = payloads.select("*", F.explode(F.from_json("payload", schema)).alias("slug", "room"))
    plans = rooms.select(*payloads.columns, "slug", "room", F.explode("room.rates").alias("code", "r"))
    money = lambda c: c.cast("decimal(12,3)")
    rate = F.coalesce(F.nullif(F.col("r.rate"), F.lit(0.0)), F.nullif(F.get(F.col("r.prices"), 0)["price"], F.lit(0.0)))
    inclusive, tax = F.nullif(F.col("r.inclusive"), F.lit(0.0)), F.coalesce("r.tax", F.lit(0.0))
    total = F.when(inclusive.isNull() | (money(inclusive) == money(rate)), rate + tax).otherwise(inclusive)
    labels = F.create_map(*[F.lit(x) for pair in (plan_labels or {"EP": "Room Only", "CP": "Breakfast", "MAP": "Half Board", "AP": "Full Board"}).items() for x in pair])
    name = F.coalesce(parsing.blank_as_null(F.col("room.displayName")), parsing.prettify(F.col("slug")))
    return plans.select(
        *[c for c in payloads.columns if c != "payload"], name.alias("raw_room_name"), total.cast("decimal(12,3)").alias("price_inclusive"), rate.cast("decimal(12,3)").alias("price_exclusive"), tax.cast("decimal(12,3)").alias("taxes_fees"),
        F.coalesce(labels[F.col("code")], F.col("code")).alias("meal_plan"), (F.coalesce(F.col("room.available"), F.lit(True)) & rate.isNotNull()).alias("is_available"),
    )


@register("shared_payload")
def shared_payload(payloads: DataFrame, properties: DataFrame, list_path: str, id_field: str, fields: dict[str, str]) -> DataFrame:
    """One payload of many properties, read once: its nodes meet the watched properties (external_id, hotel_id) by their id."""
    nodes = payloads.select("*", F.explode(F.from_json(F.get_json_object("payload", mapping.json_path(list_path)), "array<string>")).alias("_node"))
    own = nodes.withColumn("external_id", F.get_json_object("_node", mapping.json_path(id_field))).join(properties, "external_id")
    return mapping.offers(own.select(*[c for c in payloads.columns if c != "payload"], "hotel_id", "_node"), "_node", fields).drop("_node").select("*", "_o.*").drop("_o")


@register("manual")
def manual(rows: DataFrame) -> DataFrame:
    """Offers typed in by people: available ones need a price. All rows of a stay are one fetch."""
    bad = F.coalesce(F.col("is_available"), F.lit(True)) & F.col("price_inclusive").isNull() & F.col("price_exclusive").isNull()
    return rows.withColumn("error", F.when(bad, "no_price"))


def last_response(captures: DataFrame, fragment: str) -> DataFrame:
    """The last captured response (page, seq, url, payload) of each page whose URL contains a fragment."""
    return captures.where(F.contains("url", F.lit(fragment))).groupBy("page").agg(F.max_by("payload", "seq").alias("payload"))


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sold_out(offers: DataFrame, *fetch: str) -> DataFrame:
    """Whether each fetch had offers and none of them available."""
    return offers.groupBy(*fetch).agg((~F.bool_or("is_available")).alias("sold_out"), F.count("*").alias("n_offers"))


# Signs of a page that guards against machines.
BOT_MARKS = ("captcha", "are you a robot", "access denied", "unusual traffic", "verify you are human", "cloudflare", "just a moment", "bot detection", "request blocked", "security check", "enable javascript and cookies", "attention required")


def bot_wall(title: Column, body: Column) -> Column:
    """The first sign in the title or in the first 3000 characters of the body, or null."""
    text = F.lower(F.concat_ws(" ", title, F.substring(body, 1, 3000)))
    # A list of one, so that the text is made once for all signs.
    return F.get(F.transform(F.array(text), lambda t: F.coalesce(*(F.when(F.contains(t, F.lit(m)), m) for m in BOT_MARKS))), 0)


def robots_status(status: Column) -> Column:
    """What a robots.txt answer's status alone decides: 4xx allows (429 too), 5xx denies, none known allows; 2xx asks the rules."""
    return F.when(status.isNull() | status.between(400, 499), "allow").when(status >= 500, "deny").otherwise("rules")


def robots_allows(spark: SparkSession, rules: DataFrame, agent: str = "*") -> DataFrame:
    """rules (robots_txt, status, url) with `allowed`, by the usual parser on Arrow batches."""
    import urllib.robotparser

    import pandas as pd

    def one(t: str | None, u: str) -> bool:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse((t or "").splitlines())
        return parser.can_fetch(agent, u)

    judged = F.pandas_udf(lambda text, url: pd.Series([one(t, u) for t, u in zip(text, url)], dtype="bool"), "boolean")
    by = robots_status(F.col("status"))
    return rules.withColumn("allowed", F.when(by == "allow", True).when(by == "deny", False).otherwise(judged("robots_txt", "url")))


def probe_report(pages: DataFrame) -> DataFrame:
    """(page_id, n_prices, price_samples, json_hint, verdict): what a page offers to a source, from its html."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    prices = F.array_distinct(F.regexp_extract_all(F.col("t"), F.lit(r"(?:₹|Rs\.?|INR|\$|€|£)\s?\d[\d,.]*\d"), F.lit(0)))
    p = pages.select("page_id", "html", text.alias("t")).select("page_id", prices.alias("prices"), bot_wall(F.lit(""), F.col("t")).alias("wall"), F.col("html").rlike(r"(?i)application/json|__NEXT_DATA__|/api/").alias("hint"), (F.length(F.trim("t")) > 0).alias("some"))
    verdict = F.when(F.col("wall").isNotNull(), "blocked").when(~F.col("some"), "empty").when(F.col("hint"), "json").when(F.size("prices") > 0, "dom").otherwise("no_prices")
    return p.select("page_id", F.size("prices").cast("long").alias("n_prices"), F.array_join(F.slice("prices", 1, 12), "|").alias("price_samples"), F.col("hint").alias("json_hint"), verdict.alias("verdict"))
