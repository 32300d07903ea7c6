"""Structured Streaming jobs: step counters, reaction state, root roll-up, lifecycle checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What may follow a state of a case.
TRANSITIONS = {None: {"opened"}, "opened": {"reviewed", "closed"}, "reviewed": {"escalated", "closed"}, "escalated": {"closed"}, "closed": set()}


def step_counters(events: DataFrame, step: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, action, n per step of event time; rows later than the watermark are dropped by Spark. Needs ts and action."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", step).alias("w"), "action").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "action", "n")


def root_counters(events: DataFrame, roots: DataFrame) -> DataFrame:
    """post_id, action, n where each reaction counts for its post and for that post's root, once if they are one.
    ``roots`` (post_id, root) is a static table."""
    both = events.join(roots, "post_id").select("action", F.explode(F.array_distinct(F.array("post_id", "root"))).alias("post_id"))
    return both.groupBy("post_id", "action").agg(F.count("*").alias("n"))


def reaction_state(events: DataFrame) -> DataFrame:
    """user_id, post_id, state after each batch: like and dislike exclude one another, and repeats change nothing.

    The later event by (ts, event_id) decides, so late rows don't overturn newer ones.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, -1, "")
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = (int(pd.Timestamp(r.ts).value), int(r.event_id))
                if at > (now[0], now[1]):
                    now = (*at, r.action)
        state.update(now)
        yield pd.DataFrame({"user_id": [key[0]], "post_id": [key[1]], "state": [now[2]]})

    picked = events.where("action in ('like', 'dislike')").select("user_id", "post_id", "ts", "event_id", "action")
    return picked.groupBy("user_id", "post_id").applyInPandasWithState(run, "user_id long, post_id long, state string", "at long, event_id long, action string", "update", GroupStateTimeout.NoTimeout)


def lifecycle(events: DataFrame) -> DataFrame:
    """case_id, sequence, state, accepted for each event of a case: a sequence number at or below the last one, or a
    state that may not follow, is refused and leaves the case as it was. Needs case_id, sequence, state."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values("sequence")
        out = []
        for r in rows.itertuples(index=False):
            ok = r.sequence > last and r.state in TRANSITIONS.get(now, set())
            if ok:
                last, now = int(r.sequence), r.state
            out.append((key[0], r.sequence, r.state, ok))
        state.update((last, now))
        yield pd.DataFrame(out, columns=["case_id", "sequence", "state", "accepted"])

    return events.select("case_id", "sequence", "state").groupBy("case_id").applyInPandasWithState(run, "case_id long, sequence long, state string, accepted boolean", "sequence long, state string", "append", GroupStateTimeout.NoTimeout)
