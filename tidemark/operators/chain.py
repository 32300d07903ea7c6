"""Hash chains of events: sealing, verification row by row, and the fold of a state machine in blocks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import stored

#: Events of a key that one task folds at a time.
BLOCK = 4096

#: States of an explained case and what may follow each; "" is the start.
CASE_TRANSITIONS = {
    "": ("INGESTED",),
    "INGESTED": ("PREDICTED", "FAILED"),
    "PREDICTED": ("EXPLAINING", "FAILED"),
    "EXPLAINING": ("EVIDENCE_LINKED", "FAILED"),
    "EVIDENCE_LINKED": ("READY_FOR_REVIEW", "FAILED"),
    "READY_FOR_REVIEW": ("REVIEWED", "FAILED"),
    "REVIEWED": ("CONFIRMED", "CORRECTED"),
    "CONFIRMED": ("ARCHIVED",),
    "CORRECTED": ("ARCHIVED",),
    "FAILED": ("ARCHIVED",),
    "ARCHIVED": (),
}


def event_digest(key: Column, sequence: Column, previous_state: Column, state: Column, payload: Column, previous_hash: Column) -> Column:
    """SHA-256 of the event as JSON with its keys in order and nulls written."""
    parts = F.struct(key.cast("string").alias("key"), payload.alias("payload"), previous_hash.alias("previous_hash"), previous_state.alias("previous_state"), sequence.alias("sequence"), state.alias("state"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def seal(events: DataFrame) -> DataFrame:
    """Events (key, sequence, state, payload) with previous_state, previous_hash and event_hash. Each hash covers the one before, so a key's events are hashed
    in order, one after the other: a chain has no other way. Sequences are those of the rows; the first has no previous state and an empty hash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence")
        before, state, rows = "", None, []
        for r in pdf.itertuples(index=False):
            text = json.dumps({"key": str(r.key), "payload": r.payload, "previous_hash": before, "previous_state": state, "sequence": int(r.sequence), "state": r.state}, ensure_ascii=False, separators=(",", ":"))
            own = hashlib.sha256(text.encode()).hexdigest()
            rows.append((r.key, r.sequence, state, r.state, r.payload, before, own))
            before, state = own, r.state
        return pd.DataFrame(rows, columns=["key", "sequence", "previous_state", "state", "payload", "previous_hash", "event_hash"])

    return events.select(F.col("key").cast("long"), F.col("sequence").cast("long"), "state", "payload").groupBy("key").applyInPandas(run, "key long, sequence long, previous_state string, state string, payload string, previous_hash string, event_hash string")


def allowed(before: Column, after: Column, transitions: Mapping[str, tuple[str, ...]]) -> Column:
    """Whether ``after`` may follow ``before`` (null: the start)."""
    ok = F.lit(False)
    for state, following in transitions.items():
        if following:
            ok = F.when(F.coalesce(before, F.lit("")) == state, after.isin(*following)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def verify(events: DataFrame, transitions: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """One row a key with counts of what breaks its chain, and ``valid`` where nothing does.

    events; gaps: sequences above 1 without one before, where the sequence starts at 1; repeats: further rows that are equal to another one; forks: further different rows with one
    sequence; tampered: rows whose recomputed hash isn't theirs; unlinked: rows whose previous_hash is that of no event before them (the first has ''); misstated: the same for
    previous_state; illegal: rows whose state may not follow previous_state. Rows are counted in each of these once.

    An event meets the one before by a join on (key, sequence), so a key with a third of all events is spread like any other. Rows with a null key or sequence are left out.
    """
    columns = ["key", "sequence", "previous_state", "state", "payload", "previous_hash", "event_hash"]
    rows = events.where("key is not null and sequence is not null").groupBy(*columns).agg(F.count("*").alias("n"))
    digest = event_digest(F.col("key"), F.col("sequence"), F.col("previous_state"), F.col("state"), F.col("payload"), F.col("previous_hash"))
    rows = rows.withColumn("tampered", ~digest.eqNullSafe(F.col("event_hash"))).select("key", "sequence", "previous_state", "state", "previous_hash", "event_hash", "tampered", "n")
    at = rows.groupBy("key", "sequence").agg(
        F.collect_list(F.struct("previous_state", "state", "previous_hash", "event_hash", "tampered", "n")).alias("rows"),  # the variants of one sequence
    )
    before = at.select("key", (F.col("sequence") + 1).alias("sequence"), F.col("rows.event_hash").alias("hashes"), F.col("rows.state").alias("states"))
    met = at.join(before, ["key", "sequence"], "left")
    first = F.col("sequence") == 1
    hashes = F.when(first, F.array(F.lit(""))).otherwise(F.coalesce("hashes", F.array().cast("array<string>")))
    one = met.select("key", "sequence", "rows", hashes.alias("hashes"), "states", (~first & F.col("hashes").isNull()).alias("gap"))
    count = lambda test: F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + F.when(test(r), r["n"]).otherwise(0))
    stated = lambda r: F.when(first, r["previous_state"].isNull()).otherwise(F.coalesce(F.exists("states", lambda s: s.eqNullSafe(r["previous_state"])), F.lit(False)))
    told = one.select(
        "key", count(lambda r: F.lit(True)).alias("events"), F.col("gap").cast("long").alias("gaps"), F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + r["n"] - 1).alias("repeats"), (F.size("rows") - 1).cast("long").alias("forks"),
        count(lambda r: r["tampered"]).alias("tampered"), count(lambda r: ~F.exists("hashes", lambda h: h.eqNullSafe(r["previous_hash"]))).alias("unlinked"),
        count(lambda r: ~stated(r)).alias("misstated"), count(lambda r: ~allowed(r["previous_state"], r["state"], transitions)).alias("illegal"),
    )
    names = ["events", "gaps", "repeats", "forks", "tampered", "unlinked", "misstated", "illegal"]
    sums = told.groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
    bad = sum((F.col(c) for c in names[1:]), F.lit(0))
    return sums.select("key", *names, (bad == 0).alias("valid"))


def fold(events: DataFrame, transitions: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Events (key, sequence, state) with ``accepted`` and ``now``, the key's state behind each: an event whose state may not follow is refused and changes nothing.

    What a run of events does is a map from each state to another, and maps of consecutive runs compose. So blocks of BLOCK sequence numbers are
    mapped side by side, a key's block maps are chained (a BLOCK-th of its events), and each block is folded from its own start: a key of any size is
    spread over tasks. Events with one sequence go by state. Rows with a null key, sequence or state are left out.
    """
    names = list(transitions)
    table = {s: frozenset(f) for s, f in transitions.items()}
    kept = events.where("key is not null and sequence is not null and state is not null").select(F.col("key").cast("long").alias("key"), F.col("sequence").cast("long").alias("sequence"), "state")
    rows = stored(kept.withColumn("block", F.floor(F.col("sequence") / BLOCK).cast("long")))

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        now = names
        for state in pdf.sort_values(["sequence", "state"])["state"]:
            now = [state if state in table[s] and state in table else s for s in now]
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "after": [now]})

    maps = rows.groupBy("key", "block").applyInPandas(mapped, "key long, block long, after array<string>")

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        now, starts = "", []
        for after in pdf["after"]:
            starts.append(now)
            now = after[names.index(now)]
        return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "start": starts})

    starts = stored(maps).groupBy("key").applyInPandas(chained, "key long, block long, start string")

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence", "state"])
        now, accepted, states = pdf["start"].iloc[0], [], []
        for state in pdf["state"]:
            ok = state in table[now] and state in table
            now = state if ok else now
            accepted.append(ok)
            states.append(now or None)
        return pd.DataFrame({"key": pdf["key"], "sequence": pdf["sequence"], "state": pdf["state"], "accepted": accepted, "now": states})

    return rows.join(starts, ["key", "block"]).groupBy("key", "block").applyInPandas(folded, "key long, sequence long, state string, accepted boolean, now string")
