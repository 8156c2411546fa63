"""Keyed state with event-time timers: silence alarms, messages held over quiet hours, changes handed over by run, and offers
that are forgotten.

Each processor sorts a micro-batch's rows of a key by time, so that how rows are cut into micro-batches changes nothing as
long as they come in order of time. What a late row does is said with each. Timers survive a restart from the checkpoint.
State lives in RocksDB (`stateful` sets the provider for the queries started within it), not in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.detector import State, Thresholds, step
from ..session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one frame that a processor yields, at most.
AT_ONCE = 10_000


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _only_timer(handle, at: int) -> None:
    """The key's one timer, set anew."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
    handle.registerTimer(at)


#: Groups that keys of a large population (targets, recipients, messages) are dealt into by hash. State is read and written once
#: for a group and micro-batch, as one array of its keys' rows, as a call for each key costs some milliseconds.
GROUPS = 512


def group_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group")


class Rows:
    """The rows of a group's keys in one state value: a structured array."""

    def __init__(self, handle, dtype: list[tuple[str, str]]):
        self.value, self.dtype = handle.getValueState("rows", "rows binary"), np.dtype(dtype)

    def get(self) -> np.ndarray:
        return np.frombuffer(bytes(self.value.get()[0]), self.dtype).copy() if self.value.exists() else np.zeros(0, self.dtype)

    def put(self, rows: np.ndarray) -> None:
        if len(rows):
            self.value.update((np.ascontiguousarray(rows).tobytes(),))
        elif self.value.exists():
            self.value.clear()


def frames(columns: dict[str, object]) -> Iterator[pd.DataFrame]:
    """Columns of one length as frames of AT_ONCE rows at most."""
    whole = pd.DataFrame(columns)
    for lo in range(0, len(whole), AT_ONCE):
        yield whole.iloc[lo : lo + AT_ONCE]


ALARMS = "target_id long, last_success_us long, stale_us long"


class Silence(StatefulProcessor):
    """A row for each target, which each success sets anew, and a timer for the earliest silence of a group."""

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = Rows(handle, [("target", "i8"), ("last", "i8"), ("allowed", "i8"), ("told", "?")])

    def _wait(self, kept: np.ndarray) -> None:
        open_ = kept[~kept["told"]]
        if len(open_):
            # Stale is past the last allowed microsecond; timers count milliseconds.
            self.handle.registerTimer(int((open_["last"] + open_["allowed"]).min()) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, came = self.rows.get(), pd.concat(list(rows))
        fresh = np.zeros(len(came), known.dtype)
        fresh["target"], fresh["last"], fresh["allowed"] = came["target_id"], came["at"], came["interval_minutes"] * 180_000_000
        line = np.concatenate([known, fresh])
        came_late = np.arange(len(line)) >= len(known)
        order = np.lexsort((came_late, line["last"], line["target"]))
        line, came_late = line[order], came_late[order]
        # What is not newer than what is known changes nothing.
        newest = dict(zip(known["target"].tolist(), known["last"].tolist()))
        least = np.fromiter((newest.get(t, _NEVER) for t in line["target"].tolist()), np.int64, len(line))
        line = line[~came_late | (line["last"] > least)]
        again = np.append(False, (line["target"][1:] == line["target"][:-1]) & (line["last"][1:] == line["last"][:-1]))
        line = line[~again]
        followed = np.append(line["target"][1:] == line["target"][:-1], False)
        stale = line["last"] + line["allowed"]
        ended = followed & ~line["told"] & (np.append(line["last"][1:], 0) > stale)
        kept = line[~followed]
        self.rows.put(kept)
        self._wait(kept)
        yield from frames({"target_id": line["target"][ended], "last_success_us": line["last"][ended], "stale_us": stale[ended]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.rows.get()
        stale = kept["last"] + kept["allowed"]
        due = ~kept["told"] & (stale // 1000 + 1 <= timerValues.getCurrentWatermarkInMs())
        kept["told"] |= due
        self.rows.put(kept)
        self._wait(kept)
        yield from frames({"target_id": kept["target"][due], "last_success_us": kept["last"][due], "stale_us": stale[due]})

    def close(self) -> None:
        pass


_NEVER = np.iinfo(np.int64).min


def silence_alarms(successes: DataFrame, late: str = "1 day") -> DataFrame:
    """successes: stream of target_id, ran_at, interval_minutes. An alarm for each silence of over three intervals, once the watermark has passed them.

    A success that is not newer than the target's newest changes nothing; one that ends an untold silence tells it. A task
    holds one of GROUPS groups of targets.
    """
    ship(successes.sparkSession)
    rows = successes.withWatermark("ran_at", late).select(group_of("target_id"), "target_id", F.unix_micros("ran_at").alias("at"), "interval_minutes", "ran_at")
    return rows.groupBy("group").transformWithStateInPandas(Silence(), ALARMS, "append", "eventTime")


RELEASED = "recipient_id long, message_id long, at_us long, released_us long, place long"


class Held(StatefulProcessor):
    """Messages of quiet hours: they wait with their recipient and release until a timer drains what is due, in order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = Rows(handle, [("recipient", "i8"), ("release", "i8"), ("message", "i8"), ("at", "i8")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        free = (came["release"] == _AT_ONCE).to_numpy()
        now, later = came[free], came[~free]
        if len(later):
            fresh = np.zeros(len(later), self.rows.dtype)
            fresh["recipient"], fresh["release"], fresh["message"], fresh["at"] = later["recipient_id"], later["release"], later["message_id"], later["at"]
            self.rows.put(np.concatenate([self.rows.get(), fresh]))
            # A release that the watermark has passed is due at once.
            self.handle.registerTimer(max(int(fresh["release"].min()) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield from frames({"recipient_id": now["recipient_id"].to_numpy(), "message_id": now["message_id"].to_numpy(), "at_us": now["at"].to_numpy(), "released_us": now["at"].to_numpy(), "place": np.zeros(len(now), np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.rows.get()
        is_due = held["release"] // 1000 <= timerValues.getCurrentWatermarkInMs()
        due, left = held[is_due], held[~is_due]
        self.rows.put(left)
        if len(left):
            self.handle.registerTimer(int(left["release"].min()) // 1000)
        due = due[np.lexsort((due["message"], due["at"], due["release"], due["recipient"]))]
        begins = np.flatnonzero(np.append(True, (due["recipient"][1:] != due["recipient"][:-1]) | (due["release"][1:] != due["release"][:-1]))[: len(due)])
        place = np.arange(len(due)) - np.repeat(begins, np.diff(np.append(begins, len(due)))) + 1
        yield from frames({"recipient_id": due["recipient"], "message_id": due["message"], "at_us": due["at"], "released_us": due["release"], "place": place})

    def close(self) -> None:
        pass


#: The release of messages that are not held.
_AT_ONCE = -1


def released(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """messages: stream of recipient_id, message_id, at, release_at (null: at once). Each message once, when it is free to go.

    place is 0 for what was never held, else the message's place in its recipient's release, in order of time and id. What a
    task holds is one of GROUPS groups of recipients. Messages that come after their release are released again, by
    themselves.
    """
    ship(messages.sparkSession)
    release = F.coalesce(F.unix_micros("release_at"), F.lit(_AT_ONCE)).alias("release")
    rows = messages.withWatermark("at", late).select(group_of("recipient_id"), "recipient_id", release, "message_id", F.unix_micros("at").alias("at"), F.col("at").alias("_at"))
    return rows.groupBy("group").transformWithStateInPandas(Held(), RELEASED, "append", "eventTime")


#: Fixed value: seconds between a run's newest change and its hand-over.
DELAY = 60
HANDED = "hotel_id long, run_us long, handed_us long, change_ids array<long>"


class Collecting(StatefulProcessor):
    """A run's changes, which one timer hands over together; each further change sets it anew."""

    def __init__(self, delay_us: int):
        self.delay = delay_us

    def init(self, handle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "change_id long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        for frame in rows:
            self.ids.appendList([(int(c),) for c in frame["change_id"]])
            newest = int(frame["at"].max()) + self.delay
            due = newest if due is None else max(due, newest)
        self.due.update((due,))
        # Timers count milliseconds; a run that the watermark has passed is due at once.
        _only_timer(self.handle, max(-(-due // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids = sorted({c for (c,) in self.ids.get()})
        due = self.due.get()[0]
        self.ids.clear()
        self.due.clear()
        yield pd.DataFrame({"hotel_id": [key[0]], "run_us": [key[1]], "handed_us": [due], "change_ids": [ids]})

    def close(self) -> None:
        pass


def handed_over(changes: DataFrame, delay_seconds: int = DELAY, late: str = "1 hour") -> DataFrame:
    """changes: stream of hotel_id, run_at, change_id, changed_at. Each run's changes in one row, once the delay after the newest of them is over.

    Repeats of a change count once in a hand-over, and change_ids are in ascending order. Changes that come after their run was handed over are handed over by
    themselves. A task holds one run's ids.
    """
    ship(changes.sparkSession)
    rows = changes.withWatermark("changed_at", late).select("hotel_id", F.unix_micros("run_at").alias("run_us"), "change_id", F.unix_micros("changed_at").alias("at"), "changed_at")
    return rows.groupBy("hotel_id", "run_us").transformWithStateInPandas(Collecting(delay_seconds * 1_000_000), HANDED, "append", "eventTime")


OUTCOMES = "offer_key string, event_id long, checked_at timestamp, outcome string, old_price double, new_price double, last_price double"


def _money(x: object) -> Decimal | None:
    return None if x is None or x != x else Decimal(str(x)).quantize(Decimal("0.01"))


class Forgetting(StatefulProcessor):
    """The detector's state of an offer, which a timer drops when the offer was silent for longer than the retention."""

    def __init__(self, retention_us: int, t: Thresholds):
        self.retention, self.t = retention_us, t

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("offer", "last string, avail boolean, pend string, n int, since long, current string, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, newest = None, None
        if self.kept.exists():
            last, avail, pend, n, since, current, newest = self.kept.get()
            state = State(_money(last), avail, _money(pend), n, since, _money(current))
        out = []
        for at, event, price, avail in pd.concat(list(rows)).sort_values(["at", "event_id"])[["at", "event_id", "price", "is_available"]].itertuples(index=False):
            price = _money(price)
            if newest is not None and at <= newest:
                out.append((key[0], event, at, "late", None, price, None))
                continue
            if newest is not None and at - newest > self.retention:
                state = None
            before = state
            outcome, state = step(state, price, bool(avail), int(at), self.t)
            newest = int(at)
            out.append((key[0], event, at, outcome, before.last if before else None, price, state.last))
        text = lambda d: None if d is None else str(d)
        self.kept.update((text(state.last), state.avail, text(state.pend), state.n, state.since, text(state.current), newest))
        _only_timer(self.handle, (newest + self.retention) // 1000 + 1)
        frame = pd.DataFrame(out, columns=["offer_key", "event_id", "checked_at", "outcome", "old_price", "new_price", "last_price"])
        frame["checked_at"] = pd.to_datetime(frame["checked_at"], unit="us")
        for c in ("old_price", "new_price", "last_price"):
            frame[c] = frame[c].astype("float64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def detect_with_retention(stream: DataFrame, retention_seconds: int, t: Thresholds = Thresholds(), late: str = "1 hour") -> DataFrame:
    """As detector.detect, but an offer that was silent for longer than the retention starts anew, and its state is dropped once the watermark tells so.

    A row that is not newer than its offer's newest is `late` and enters no state; one of an offer that is forgotten is a first sight.
    """
    ship(stream.sparkSession)
    rows = stream.withWatermark("checked_at", late).select("offer_key", "event_id", F.unix_micros("checked_at").alias("at"), F.col("price").cast("double").alias("price"), F.coalesce("is_available", F.lit(False)).alias("is_available"), "checked_at")
    return rows.groupBy("offer_key").transformWithStateInPandas(Forgetting(retention_seconds * 1_000_000, t), OUTCOMES, "append", "eventTime")


def watermark_of(query) -> datetime | None:
    """The event-time watermark that a query's last progress tells."""
    for progress in reversed(query.recentProgress):
        if at := (progress.get("eventTime") or {}).get("watermark"):
            return datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(timezone.utc)
    return None
