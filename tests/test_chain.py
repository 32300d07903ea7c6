"""Hash chains and folds against plain Python."""

import random

import pytest

from tidemark.operators import chain

STEPS = chain.CASE_TRANSITIONS
EVENTS = "key long, sequence long, state string, payload string, now string, n int"


def walk(rnd, n):
    """A legal path through the states, then whatever."""
    now, out = "", []
    while len(out) < n and STEPS[now]:
        now = rnd.choice(STEPS[now])
        out.append(now)
    return out


def sealed(spark, rows):
    return chain.seal(spark.createDataFrame([(k, i + 1, s, f"p{i} é\"", "x", 1) for k, states in rows.items() for i, s in enumerate(states)], EVENTS)).collect()


SEALED = "key long, sequence long, previous_state string, state string, payload string, previous_hash string, event_hash string"


def test_each_fault_is_told(spark):
    rnd = random.Random(2)
    rows = {}
    while len(rows) < 10:
        path = walk(rnd, 9)
        if len(path) >= 6:
            rows[len(rows)] = path
    at = {(r.key, r.sequence): r.asDict() for r in sealed(spark, rows)}
    out = [dict(r) for r in at.values()]

    def only(k, n):
        return next(r for r in out if r["key"] == k and r["sequence"] == n)

    out.remove(only(1, 3))  # gap
    out.append(dict(only(2, 3)))  # repeat
    only(3, 2)["payload"] = "changed"  # tampered
    only(4, 4)["previous_hash"] = "0" * 64  # unlinked, and its hash is no longer its own
    only(5, 3)["previous_state"] = "INGESTED"  # misstated, tampered, illegal or not
    fork = dict(only(6, 3), payload="other", event_hash="f" * 64)
    out.append(fork)
    out.append(dict(only(7, 1), key=None))
    got = {r.key: r.asDict() for r in chain.verify(spark.createDataFrame([tuple(r.values()) for r in out], SEALED).repartition(5), STEPS).collect()}
    bad = {k: {c: v for c, v in r.items() if c not in ("key", "events", "valid") and v} for k, r in got.items()}
    assert bad[0] == bad[7] == bad[8] == bad[9] == {} and got[0]["valid"] and not got[1]["valid"]
    assert bad[1] == {"gaps": 1, "unlinked": 1, "misstated": 1}
    assert bad[2] == {"repeats": 1} and got[2]["events"] == len(rows[2]) + 1
    assert bad[3] == {"tampered": 1}
    assert bad[4] == {"tampered": 1, "unlinked": 1}
    assert bad[5]["tampered"] == 1 and (bad[5].get("misstated") == 1 or at[(5, 2)]["state"] == "INGESTED")
    assert bad[6] == {"forks": 1, "tampered": 1}
    assert len(got) == 10


def test_truncated_and_reordered(spark):
    rows = {1: ["INGESTED", "PREDICTED", "EXPLAINING"], 2: ["PREDICTED"], 3: ["INGESTED", "ARCHIVED"]}
    out = [r for r in sealed(spark, rows) if (r.key, r.sequence) != (1, 1)]
    got = {r.key: r for r in chain.verify(spark.createDataFrame(out, SEALED), STEPS).collect()}
    assert got[1].gaps == 1 and got[1].unlinked == 1  # the head is missing
    assert got[2].illegal == 1 and got[3].illegal == 1 and got[2].tampered == 0
    assert chain.verify(spark.createDataFrame([], SEALED), STEPS).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_fold_equals_a_loop(spark, block):
    rnd = random.Random(block)
    rows = [(k, i * rnd.choice([1, 1, 2]) + 1, rnd.choice([*list(STEPS)[1:], "INGESTED", "FAILED", "unknown"]), "p", "n", 1) for k in range(12) for i in range(rnd.choice([1, 7, 60]))]
    want = []
    for k in range(12):
        now = ""
        for _, n, s, *_ in sorted(r for r in rows if r[0] == k):
            ok = s in STEPS[now]
            now = s if ok else now
            want.append((k, n, s, ok, now or None))
    kept, chain.BLOCK = chain.BLOCK, block
    try:
        got = [tuple(r) for r in chain.fold(spark.createDataFrame([*rows, (None, 1, "INGESTED", "", "", 1), (1, None, "INGESTED", "", "", 1), (1, 1, None, "", "", 1)], EVENTS).repartition(4), STEPS).collect()]
    finally:
        chain.BLOCK = kept
    assert sorted(got, key=repr) == sorted(want, key=repr)
