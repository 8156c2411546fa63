"""Delivery of messages: attempts, retries by event-time timers, and no second copy of what was sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship
from . import timers

# Attempts at most, and the seconds after each failed one.
MAX_ATTEMPTS, BACKOFF = 3, (60, 300, 900)
#: How long a message that came to its end is remembered, so that a repeat of it is not sent again.
REMEMBERED = 86_400
ATTEMPTS = "message_id long, attempt long, at_us long, status string, error_code string"


#: Where a message stands, by number.
STANDS = ("queued", "sent", "failed")


class Sending(StatefulProcessor):
    """A row for each message of a group: its attempts so far, where it stands, and when it is looked at again."""

    def __init__(self, send: Callable[[int, int], tuple[bool, bool, str | None]]):
        self.send = send

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = timers.Rows(handle, [("message", "i8"), ("attempts", "i4"), ("stand", "i1"), ("due", "i8")])

    def _attempt(self, message: int, done: int, at: int) -> tuple[tuple, tuple]:
        """The message's row after one more attempt at this time, and the attempt's."""
        ok, retryable, code = self.send(message, done + 1)
        again = not ok and retryable and done + 1 < MAX_ATTEMPTS
        stand = 1 if ok else 0 if again else 2
        wait = BACKOFF[min(done, len(BACKOFF) - 1)] if again else REMEMBERED
        return (message, done + 1, stand, at + wait * 1_000_000), (message, done + 1, at, STANDS[stand], None if ok else code)

    def _keep(self, rows: np.ndarray) -> None:
        self.rows.put(rows)
        if len(rows):
            self.handle.registerTimer(int(rows["due"].min()) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, came = self.rows.get(), pd.concat(list(rows))
        came = came[~came["message_id"].isin(known["message"])]
        first = came.assign(dead=~came["is_active"].astype(bool)).sort_values(["message_id", "at", "dead"]).drop_duplicates("message_id")
        made, out = [], []
        for message, at, dead in zip(first["message_id"].tolist(), first["at"].tolist(), first["dead"].tolist()):
            row, told = ((message, 0, 2, at + REMEMBERED * 1_000_000), (message, 0, at, "failed", "recipient_inactive")) if dead else self._attempt(message, 0, at)
            made.append(row)
            out.append(told)
        if made:
            self._keep(np.concatenate([known, np.array(made, self.rows.dtype)]))
        yield from _told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rows, out = timerValues.getCurrentWatermarkInMs(), self.rows.get(), []
        due = rows["due"] // 1000 <= now
        retried = []
        # Retries that the watermark has passed together are made together, each at its own time; what came to its end is forgotten.
        for row in rows[due & (rows["stand"] == 0)].tolist():
            while row[2] == 0 and row[3] // 1000 <= now:
                row, told = self._attempt(row[0], row[1], row[3])
                out.append(told)
            retried.append(row)
        self._keep(np.concatenate([rows[~due], np.array(retried, self.rows.dtype)]))
        yield from _told(out)

    def close(self) -> None:
        pass


def _told(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield from timers.frames(dict(zip(("message_id", "attempt", "at_us", "status", "error_code"), zip(*rows))))


def delivered(messages: DataFrame, send: Callable[[int, int], tuple[bool, bool, str | None]], late: str = "1 hour") -> DataFrame:
    """messages: stream of message_id, at, is_active (of the recipient; null counts as inactive). A row for each attempt: sent, queued (to be tried again) or failed.

    send(message_id, attempt) -> (ok, retryable, error code). A retryable failure is tried again by a timer after BACKOFF,
    MAX_ATTEMPTS times in all; an inactive recipient's message fails without an attempt (attempt 0). Of rows of one message
    the earliest counts, as long as the message is remembered (REMEMBERED after its end). Like every foreign call in a
    task, send is at-least-once: a batch that is run again sends again, so a provider needs message_id as its own key. A task
    holds one of timers.GROUPS groups of messages.
    """
    ship(messages.sparkSession)
    rows = messages.where("message_id is not null").withWatermark("at", late).select(timers.group_of("message_id"), "message_id", F.unix_micros("at").alias("at"), F.coalesce("is_active", F.lit(False)).alias("is_active"), F.col("at").alias("_at"))
    return rows.groupBy("group").transformWithStateInPandas(Sending(send), ATTEMPTS, "append", "eventTime")
