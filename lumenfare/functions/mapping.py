"""Semi-structured payloads: dotted paths, offers by mapping, URL templates and engines, redaction."""

from __future__ import annotations

import json
import re
import string
from functools import reduce
from operator import or_
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsing


def json_path(path: str) -> str:
    """data.rooms.0.name to $.data.rooms[0].name; the empty path is the payload itself."""
    out = "$"
    for part in path.split(".") if path else []:
        out += f"[{part}]" if part.isdigit() else f".{part}"
    return out


def dig(payload: Column, path: str, default: str | None = None, required: bool = False) -> Column:
    """struct(value, error): the value as text; a missing required path is an error, a JSON null is a null value."""
    if not path:
        return F.struct(payload.alias("value"), F.lit(None).cast("string").alias("error"))
    value = F.get_json_object(payload, json_path(path))
    parent, _, leaf = path.rpartition(".")
    holder = F.get_json_object(payload, json_path(parent)) if parent else payload
    there = F.coalesce(F.array_contains(F.json_object_keys(holder), leaf), F.lit(False)) if not leaf.isdigit() else value.isNotNull()
    missing = value.isNull() & ~there
    return F.struct(F.when(missing, F.lit(default)).otherwise(value).alias("value"), F.when(missing & F.lit(required), F.lit(f"missing {path}")).alias("error"))


#: What a mapping may name.
FIELDS = ("room_name", "price_inclusive", "price_exclusive", "taxes_fees", "currency", "meal_plan", "refundable", "available", "rooms_left")


PRICES = ("price_inclusive", "price_exclusive", "taxes_fees")


def offers(nodes: DataFrame, node: str, mapping: dict[str, str], currency: str = "INR") -> DataFrame:
    """nodes with the struct `_o`, the offer of each JSON node: a name is required, and a price where it is available; tax fills in the missing side.

    In steps, so that a node is parsed once, each step's values are columns of their own and all of it stays in generated code.
    """
    nothing = F.lit(None).cast("string")
    own = nodes.columns
    parsed = nodes.select(*own, F.try_parse_json(node).alias("_v"))
    text = parsed.select(*own, *[(F.try_variant_get("_v", json_path(mapping[f]), "string") if f in mapping else nothing).alias(f"_{f}") for f in FIELDS])
    return _offer(text, own, currency)


def _offer(text: DataFrame, own: list[str], currency: str) -> DataFrame:
    """own columns and the struct `_o` of texts (`_` and the field's name)."""
    bare = text.select("*", *[parsing.bare_number(F.col(f"_{f}")).alias(f"_bare_{f}") for f in PRICES])
    priced = bare.select(*text.columns, *[parsing.price_of_bare(F.col(f"_bare_{f}")).alias(f"_read_{f}") for f in PRICES], F.coalesce(parsing.truthy(F.col("_available")), F.lit(True)).alias("_open"), parsing.blank_as_null(F.col("_room_name")).alias("_name"))
    inc, exc, tax = (F.col(f"_read_{f}") for f in PRICES)
    error = F.when(F.col("_name").isNull(), "no_name").when(F.col("_open") & inc.isNull() & exc.isNull(), "no_price")
    free = F.lower("_refundable")
    offer = F.struct(
        F.col("_name").alias("raw_room_name"), F.coalesce(inc, (exc + tax).cast("decimal(12,2)")).alias("price_inclusive"), F.coalesce(exc, (inc - tax).cast("decimal(12,2)")).alias("price_exclusive"), tax.alias("taxes_fees"),
        F.coalesce(parsing.blank_as_null(F.col("_currency")), F.lit(currency)).alias("currency"), F.col("_meal_plan").alias("meal_plan"), F.when(free.isin("true", "1", "yes"), True).when(free.isin("false", "0", "no"), False).otherwise(parsing.refundable(F.col("_refundable"))).alias("refundable"),
        F.col("_open").alias("is_available"), F.col("_rooms_left").try_cast("int").alias("rooms_left"), error.alias("error"),
    )
    return priced.select(*own, offer.alias("_o"))


def price_on(basis: Column, inclusive: Column, exclusive: Column) -> Column:
    """The basis's price, or the other where it is missing."""
    return F.when(basis == "exclusive", F.coalesce(exclusive, inclusive)).otherwise(F.coalesce(inclusive, exclusive))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders replaced literally; unknown ones survive."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


# Query names (lower case, without - and _) of dates and guests, and those that pack guests as adults-children.
QUERY_NAMES = {
    "check_in": ("checkin", "check_in", "checkindate", "arrival", "arrivaldate", "startdate", "fromdate", "from"),
    "check_out": ("checkout", "check_out", "checkoutdate", "departure", "departuredate", "enddate", "todate", "to"),
    "adults": ("adults", "adult", "noofadults", "noofadult", "noofguests", "guests", "numadults", "pax"),
    "children": ("children", "child", "noofkids", "kids", "noofchildren", "numchildren"),
    "rooms": ("rooms", "room", "noofrooms", "numrooms"),
}
PACKED_GUESTS = ("roomconfig", "roomconfigs", "occupancy", "paxconfig")
_PLACE = {alias: name for name, aliases in QUERY_NAMES.items() for alias in aliases}


def templated(url: str | None) -> tuple[str | None, dict[str, str]]:
    """A booking URL with its dates and guests as placeholders, and what was replaced by what.

    Up to two ISO dates in the path; in the query, values of known names (empty ones stay) and packed guests.
    """
    if not url:
        return url, {}
    parts, told = urlsplit(url), {}
    names, found = iter(("{check_in}", "{check_out}")), re.findall(r"\d{4}-\d{2}-\d{2}", parts.path)[:2]
    path = re.sub(r"\d{4}-\d{2}-\d{2}", lambda m: next(names, m.group()), parts.path)
    for k, (date, place) in enumerate(zip(found, ("{check_in}", "{check_out}")), 1):
        told["path date" if len(found) == 1 else f"path date {k}"] = f"{date} -> {place}"
    query = []
    for name, value in parse_qsl(parts.query, keep_blank_values=True):
        bare = name.lower().replace("-", "").replace("_", "")
        place = "{" + _PLACE[bare] + "}" if bare in _PLACE else "{adults}-{children}" if bare in PACKED_GUESTS and re.match(r"\d+-\d+$", value) else None
        if place and value:
            told[name] = f"{value} -> {place}"
        query.append((name, place if place and value else value))
    return urlunsplit((parts.scheme, parts.netloc, path, urlencode(query, safe="{}"), parts.fragment)), told


def parameterised(url: str | None) -> str | None:
    return templated(url)[0]


def parameterise_url(url: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([parameterised(u) for u in s], dtype="object"), "string")(url)


def substitutions(url: Column) -> Column:
    """What parameterise_url replaces: a map of name to `old -> placeholder`."""
    return F.pandas_udf(lambda s: pd.Series([templated(u)[1] for u in s], dtype="object"), "map<string,string>")(url)


def is_complete(template: Column) -> Column:
    return F.contains(template, F.lit("{check_in}"))


def json_fragment(url: Column) -> Column:
    """The last two path segments: what stays equal when dates and hosts change."""
    parts = F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


#: Characters one by one are looked up in a table by Java's patterns, ranges are tried one after the other.
_RUN = "[" + string.ascii_letters + string.digits + r"_\-]{40,}"


def scrub(text: Column) -> Column:
    """Secrets in a text masked: bearer tokens, values of telling keys, runs of 40 or more token characters.

    Most places are passed by one look at a table of characters: a telling key's first ones, a run's.
    """
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r'(?=["pPaAsStT])(?i)("?(?:password|passwd|secret|token|api[_-]?key|authorization)"?\s*[:=]\s*)"?[^\s",}]+"?', "$1[redacted]")
    return F.regexp_replace(out, _RUN, "[redacted]")


# Key names that hold secrets, and what masked values and values nested too deep become.
SENSITIVE_KEY = re.compile(r"(password|passwd|pwd|secret|token|authorization|auth|cookie|session|api[_-]?key|access[_-]?key|private[_-]?key|credential|kek|dek|otp|pin)", re.I)
REDACTED, TRUNCATED, MAX_DEPTH = "***REDACTED***", "***TRUNCATED***", 12
_BEARER = re.compile(r"(Bearer\s+)[A-Za-z0-9._\-]{12,}", re.I)
_LONG_RUN = re.compile(r"\b[A-Za-z0-9_\-]{40,}\b")


def masked(value: object, depth: int = 0) -> object:
    """A tree with the whole value of every telling key masked, at any depth, and secrets in its texts; what lies deeper than MAX_DEPTH is cut."""
    if depth > MAX_DEPTH:
        return TRUNCATED
    if isinstance(value, dict):
        return {k: REDACTED if SENSITIVE_KEY.search(k) else masked(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [masked(v, depth + 1) for v in value]
    return _LONG_RUN.sub(REDACTED, _BEARER.sub(rf"\1{REDACTED}", value)) if isinstance(value, str) else value


def _masked_json(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(masked(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return masked(text)


def scrub_json(payload: Column) -> Column:
    """A JSON text with its secrets masked at any depth; text that is no JSON is masked as one text, null stays null."""
    return F.pandas_udf(lambda s: pd.Series([_masked_json(x) for x in s], dtype="object"), "string")(payload)


# Booking engines by parts of their host, first match wins, and where each keeps a property's id.
ENGINES = (
    ("aiosell", ("aiosell.com",), r"/book/([A-Za-z0-9_-]+)"),
    ("gotoyelagiri", ("gotoyelagiri.com",), r"resort[_/=-]?(\d+)"),
    ("ezee-letsbook", ("letsbook.me", "ipms247.com"), r"hotelCode=(\d+)"),
    ("treebo", ("treebo.com",), r"-(\d+)/?(?:[?#]|$)"),
)


def detect_engine(url: Column, engines: tuple[tuple[str, tuple[str, ...], str], ...] = ENGINES) -> Column:
    """struct(engine, external_id): the first engine whose mark the host contains; null fields where none does."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    name, external = F.lit(None).cast("string"), F.lit(None).cast("string")
    for engine, marks, pattern in reversed(engines):
        hit = F.coalesce(reduce(or_, (F.contains(host, F.lit(m)) for m in marks)), F.lit(False))
        name = F.when(hit, engine).otherwise(name)
        external = F.when(hit, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(external)
    return F.struct(name.alias("engine"), external.alias("external_id"))


def steps(path: Column) -> Column:
    """A dotted path held in a column as array of struct(name, place), one of them set: digits are list places; the empty path has no steps."""
    step = lambda x: F.struct(F.when(~x.rlike(r"^\d+$"), x).alias("name"), F.when(x.rlike(r"^\d+$"), x.try_cast("int")).alias("place"))
    return F.transform(F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, r"\.")), step)


def at(value: Column, path: Column, kind: str) -> Column:
    """What lies at `steps` of a variant; null where nothing of the kind does. A path held in a column, given as text, would be parsed anew for each value."""
    own = lambda v, k: F.try_variant_get(v, F.lit("$"), k)
    down = lambda v, s: F.when(s["name"].isNull(), F.get(own(v, "array<variant>"), s["place"])).otherwise(F.try_element_at(own(v, "map<string,variant>"), s["name"]))
    return own(F.aggregate(path, value, down), kind)


def offers_by_config(payloads: DataFrame, configs: DataFrame, key: str, currency: str = "INR") -> DataFrame:
    """Each payload's offers by the configuration of its `key`: paths are data, so one plan serves every site.

    payloads: key, page_id, payload. configs: one row for each key with rooms_path and fields (map of FIELDS to dotted
    paths). Gives key, page_id, place (in the payload's list) and the struct `_o` as offers() does. A payload without a
    configuration, without the list, or that is no JSON has none. Configurations are few beside payloads; which side moves
    is the optimizer's choice.
    """
    paths = F.struct(*(steps(F.try_element_at("fields", F.lit(f))).alias(f) for f in FIELDS))
    own = configs.select(key, steps(F.col("rooms_path")).alias("_rooms"), paths.alias("_paths"))
    met = payloads.select(key, "page_id", F.try_parse_json("payload").alias("_v")).join(own, key)
    rooms = met.select(key, "page_id", "_paths", F.posexplode(at(F.col("_v"), F.col("_rooms"), "array<variant>")).alias("place", "_room"))
    text = rooms.select(key, "page_id", "place", *(at(F.col("_room"), F.col(f"_paths.{f}"), "string").alias(f"_{f}") for f in FIELDS))
    return _offer(text, [key, "page_id", "place"], currency)
