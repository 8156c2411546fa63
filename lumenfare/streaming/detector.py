"""The change detector as a stream: keyed state, the same step as the batch fold.

Each micro-batch's rows of a key are taken in order of time; rows not later than what the key has seen are late: they are
told as such and never enter the state, so that micro-batch bounds and replays do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detector import State, Thresholds, step
from ..session import ship

OUTPUT = "offer_key string, event_id long, checked_at timestamp, outcome string, old_price double, new_price double, last_price double"
STATE = "last string, avail boolean, pend string, n int, since timestamp, current string, at timestamp"


def _money(x: object) -> Decimal | None:
    return None if x is None or x != x else Decimal(str(x)).quantize(Decimal("0.01"))


def detect(stream: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """stream: offer_key, checked_at, event_id, price, is_available; a row for each observation, outcome `late` for late ones."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, newest = None, None
        if kept.exists:
            last, avail, pend, n, since, current, newest = kept.get
            state = State(_money(last), avail, _money(pend), n, since, _money(current))
        rows = pd.concat(list(frames)).sort_values(["checked_at", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            price = _money(r.price)
            if newest is not None and r.checked_at <= newest:
                out.append((key[0], r.event_id, r.checked_at, "late", None, price, None))
                continue
            before = state
            outcome, state = step(state, price, bool(r.is_available), r.checked_at, t)
            newest = r.checked_at
            out.append((key[0], r.event_id, r.checked_at, outcome, before.last if before else None, price, state.last))
        if state is not None:
            text = lambda d: None if d is None else str(d)
            kept.update((text(state.last), state.avail, text(state.pend), state.n, state.since, text(state.current), newest))
        frame = pd.DataFrame(out, columns=["offer_key", "event_id", "checked_at", "outcome", "old_price", "new_price", "last_price"])
        for c in ("old_price", "new_price", "last_price"):
            frame[c] = frame[c].astype("float64")
        yield frame

    ship(stream.sparkSession)
    rows = stream.select("offer_key", "checked_at", "event_id", F.col("price").cast("double").alias("price"), "is_available")
    return rows.groupBy("offer_key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling hours of each offer under a watermark: mean price, whether any was open."""
    return stream.withWatermark("checked_at", late).groupBy("offer_key", F.window("checked_at", "1 hour").alias("hour")).agg(F.avg(F.col("price").cast("double")).alias("avg_price"), F.bool_or("is_available").alias("any_open"), F.count("*").alias("n"))


def without_replays(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """At-least-once input made exactly-once by key and time."""
    return stream.withWatermark("checked_at", late).dropDuplicatesWithinWatermark(["offer_key", "checked_at"])
