"""Platform counters on streams: a stateful processor for each slot, whose changes add up to the counters of the batch fold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators import counters

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "actor long, object long, slot string, state string, n long"
EMPTY = (0, -1)


class Slots(StatefulProcessor):
    """State of one slot: the last action that set it, and the last one that took each of two states back. All three are maxima, so
    the state, and the sum of the changes told, is the same whatever the order of arrival. A timer of event time clears a slot ``keep_ms`` after its last action."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "set_at long, set_id long, state string, like_at long, like_id long, dislike_at long, dislike_id long, timer long")

    @staticmethod
    def effective(last: tuple, state: str, back: dict) -> str | None:
        return state if last > EMPTY and back["dislike" if state == "dislike" else "like"] <= last else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last, state, back, timer = EMPTY, "", {"like": EMPTY, "dislike": EMPTY}, 0
        if self.held.exists():
            h = self.held.get()
            last, state, back, timer = (h[0], h[1]), h[2], {"like": (h[3], h[4]), "dislike": (h[5], h[6])}, h[7]
        before, due = self.effective(last, state, back), timer
        for r in rows:
            at = (int(r.micros), int(r.event_id))
            side = "dislike" if r.state == "dislike" else "like"
            if not r.sets:
                back[side] = max(back[side], at)
            elif at > last:
                last, state = at, r.state
            due = max(due, int(r.micros) // 1000 + self.keep_ms)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.held.update((*last, state, *back["like"], *back["dislike"], due))
        after = self.effective(last, state, back)
        if before != after:
            for held, n in ((before, -1), (after, 1)):
                if held is not None:
                    yield Row(actor=key[0], object=key[1], slot=key[2], state=held, n=n)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def counter_changes(actions: DataFrame, late: str = "1 day", keep: dt.timedelta = dt.timedelta(days=90)) -> DataFrame:
    """entity, id, counter, n: changes of the counters of ``counters.platform_counters`` for a stream of actions (actor, object, action, at, event_id, quantity).

    Their sums (``counters.totals``) are the counters of a batch over the same actions, in whatever order they come, as long as none is later than ``late``. State is kept
    for each actor, object and slot until ``keep`` of event time after its last action: then a like counts no more as given before, and can't be taken back.
    The session needs the RocksDB state store (``STORE``) as spark.sql.streaming.stateStore.providerClass.
    """
    marked = actions.withWatermark("at", late)
    switching = counters.switching(marked).withColumn("micros", F.unix_micros("at"))
    processed = switching.groupBy("actor", "object", "slot").transformWithState(Slots(int(keep.total_seconds() * 1000)), CHANGE, "append", "eventTime")
    return counters.raised(processed, F.col("n")).unionByName(counters.added(actions))
