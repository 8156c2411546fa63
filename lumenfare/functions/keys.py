"""Identity: text normalisation, offer keys, dedupe keys, slugs. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator, version and the mark of an absent value in a canonical string.
SEPARATOR, VERSION, ABSENT = "|", "v1", "~"


def norm_text(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null and blank give the absent mark."""
    return F.coalesce(F.nullif(F.trim(F.lower(F.regexp_replace(x, r"(?U)\s+", " "))), F.lit("")), F.lit(ABSENT))


def norm_bool(x: Column) -> Column:
    """Three states: absent, true, false."""
    return F.when(x.isNull(), ABSENT).when(x, "1").otherwise("0")


def canonical_offer(c: dict[str, Column]) -> Column:
    """The string an offer key hashes; concat gives null for a null part, where concat_ws would drop it silently."""
    text = lambda name: c[name].cast("string")
    parts = [F.lit(VERSION), text("hotel_id"), text("source_id"), text("room_type_id"), text("check_in"), text("check_out"), text("adults"), text("children"), norm_text(c["meal_plan"]), norm_bool(c["refundable"]), F.upper(F.trim(c["currency"]))]
    joined = [parts[0]]
    for p in parts[1:]:
        joined += [F.lit(SEPARATOR), p]
    return F.concat(*joined)


OFFER_COLUMNS = ("hotel_id", "source_id", "room_type_id", "check_in", "check_out", "adults", "children", "meal_plan", "refundable", "currency")


def offer_key(**columns: Column) -> Column:
    """SHA-256 of the booking conditions; columns by name, defaulting to columns of the same name."""
    return F.sha2(canonical_offer({n: columns.get(n, F.col(n)) for n in OFFER_COLUMNS}), 256)


def nights(check_in: Column, check_out: Column) -> Column:
    return F.datediff(check_out, check_in)


def dedupe_key(recipient: Column, channel: Column, ids: Column) -> Column:
    """One message for each recipient, channel and set of changes; ids are sorted as numbers."""
    listed = F.concat_ws(",", F.transform(F.array_sort(ids), lambda x: x.cast("string")))
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(VERSION), recipient.cast("string"), channel, listed), 256)


def ops_dedupe_key(recipient: Column, channel: Column, token: Column) -> Column:
    """As dedupe_key, in the name space of operations alerts."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(VERSION), F.lit("ops"), recipient.cast("string"), channel, token), 256)


def request_key(*columns: str) -> Column:
    """One request for all targets that load the same page."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(ABSENT)) for c in columns])


def slugify(name: Column, fallback: str = "hotel") -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 200), F.lit("")), F.lit(fallback))
