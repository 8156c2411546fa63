"""Accounts: throttling of log-ins, hotels attached by a pasted URL, and audit snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mapping
from .sequential import fold_sorted

# Failures in a row that lock an account, and for how many minutes.
MAX_FAILED, LOCKED_MINUTES = 5, 15


def throttled(attempts: DataFrame) -> DataFrame:
    """attempts (account, at, attempt_id, ok) with outcome and the account's failed count and locked_until after each.

    locked: the account was locked and nothing was looked at. failed: counted; from MAX_FAILED on the account is locked
    anew. ok: count and lock are reset. A lock's end leaves the count, so one more failure locks again. A null ok is a
    failure. Ties of time go by attempt_id. One account's attempts are walked in order by one task, a state at a time.
    """

    def step(state: tuple | None, at: int, attempt: int, ok: bool | None) -> tuple[tuple, tuple]:
        failed, until = state or (0, None)
        if until is not None and until > at:
            outcome = "locked"
        elif ok:
            outcome, failed, until = "ok", 0, None
        else:
            outcome, failed = "failed", failed + 1
            if failed >= MAX_FAILED:
                until = at + LOCKED_MINUTES * 60_000_000
        return (failed, until), (attempt, at, outcome, failed, until)

    rows = attempts.select("account", F.unix_micros("at").alias("at"), "attempt_id", "ok")
    return fold_sorted(rows, "account", ["at", "attempt_id"], step, "attempt_id long, at_us long, outcome string, failed long, locked_until_us long")


def attached(requests: DataFrame, hotels: DataFrame, existing: DataFrame) -> DataFrame:
    """(request_id, hotel_id, outcome, engine, url, external_id, standing_rate) of requests (request_id, hotel_id, url).

    outcome: no_hotel, unrecognised (no engine knows the host; left to discovery), already_attached (the hotel has that
    engine in `existing` (hotel_id, engine) or by an earlier request), attached. url is the template; a rate whose URL
    cannot name a night is a standing one. The first request of a hotel and engine is found by a minimum, not by a window,
    so a hotel that is asked for again and again is summed before it is shuffled.
    """
    engine = mapping.detect_engine(F.col("url"))
    seen = requests.select("request_id", "hotel_id", mapping.parameterise_url(F.col("url")).alias("template"), engine.alias("_e")).select("request_id", "hotel_id", "template", "_e.engine", "_e.external_id")
    known = hotels.where("hotel_id is not null").groupBy("hotel_id").agg(F.lit(True).alias("_known"))
    had = existing.groupBy("hotel_id", "engine").agg(F.lit(True).alias("_had"))
    first = seen.where("hotel_id is not null and engine is not null").groupBy("hotel_id", "engine").agg(F.min("request_id").alias("_first")).join(had, ["hotel_id", "engine"], "left")
    met = seen.join(known, "hotel_id", "left").join(first, ["hotel_id", "engine"], "left")
    outcome = F.when(F.col("_known").isNull(), "no_hotel").when(F.col("engine").isNull(), "unrecognised").when(F.col("_had").isNotNull() | (F.col("request_id") != F.col("_first")), "already_attached").otherwise("attached")
    took = outcome == "attached"
    return met.select("request_id", "hotel_id", outcome.alias("outcome"), "engine", F.when(took, F.col("template")).alias("url"), F.when(took, F.col("external_id")).alias("external_id"), F.when(took, ~mapping.is_complete(F.col("template"))).alias("standing_rate"))


def new_sources(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """(code, is_enabled): sources that the attached requests need and `sources` (code) hasn't got, each once and disabled until it is reviewed."""
    return outcomes.where("outcome = 'attached'").select(F.col("engine").alias("code")).distinct().join(sources.select("code"), "code", "left_anti").withColumn("is_enabled", F.lit(False))


def _plain(value: Column, kind: T.DataType) -> Column:
    """value in types that JSON has: decimals as text, times in ISO form, the rest of the tree alike."""
    if isinstance(kind, T.StructType):
        fields = [_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), _plain(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # Micros only where there are any, and a zone only where the type has one.
        form = F.when(F.date_format(value, "SSSSSS") == "000000", F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        return F.concat(form, F.date_format(value, "xxx")) if isinstance(kind, T.TimestampType) else form
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.StringType)):
        return value
    return value.cast("string")


def audit_json(rows: DataFrame, column: str) -> Column:
    """A struct, array or map column of rows as the JSON text of an audit entry: nulls kept, decimals exact as text, dates and times in ISO form; null stays null."""
    return F.to_json(_plain(F.col(column), rows.schema[column].dataType), {"ignoreNullFields": "false"})
