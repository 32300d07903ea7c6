"""Platform counters against a plain replay of the log, as a table and as a stream."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_tables import streamed
from tidemark.operators import counters
from tidemark.streaming import counters as stream
from tidemark.streaming import jobs

SCHEMA = "actor long, object long, action string, at timestamp, event_id long, quantity long, slot string, n int"
START = dt.datetime(2024, 1, 1)


def log(rnd, n):
    names = [*counters.SWITCHES, *counters.ADDS, "unknown"]
    return [(rnd.randrange(4), rnd.randrange(3), rnd.choice(names), START + dt.timedelta(minutes=rnd.randrange(300)), k, rnd.choice([None, 1, 4]), "s", 1) for k in range(n)]


def replay(rows):
    held, out = {}, collections.Counter()
    for actor, obj, action, _, _, quantity, *_ in sorted(rows, key=lambda r: (r[3], r[4])):
        if action in counters.SWITCHES:
            slot, state, sets = counters.SWITCHES[action]
            if sets:
                held[actor, obj, slot] = state
            elif held.get((actor, obj, slot)) == state:
                held[actor, obj, slot] = None
        elif action in counters.ADDS:
            entity, counter = counters.ADDS[action]
            out[entity, obj, counter] += (1 if quantity is None else quantity) if action == "purchase_product" else 1
    for (actor, obj, slot), state in held.items():
        for whose, entity, counter in counters.RAISES.get((slot, state), ()):
            out[entity, actor if whose == "actor" else obj, counter] += 1
    return {k: v for k, v in out.items() if v}


def told(df):
    return {(r.entity, r.id, r.counter): r.n for r in df.collect()}


def test_batch_equals_replay(spark):
    for seed in range(4):
        rows = log(random.Random(seed), 400)
        odd = [(None, 1, "like_post", START, 9001, 1, "s", 1), (1, None, "create_comment", START, 9002, 1, "s", 1), (1, 1, None, START, 9003, 1, "s", 1)]
        df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
        assert told(counters.platform_counters(df)) == replay(rows)
        switches = df.where(F.col("action").isin(*counters.SWITCHES))
        assert told(counters.platform_counters(switches.union(switches))) == replay([r for r in rows if r[2] in counters.SWITCHES])
    assert counters.platform_counters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_in_any_order_equals_batch(spark, tmp_path):
    rnd = random.Random(11)
    rows = log(rnd, 240)
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    try:
        got = streamed(spark, tmp_path, [rows[:80], rows[80:160], rows[160:]], SCHEMA, stream.counter_changes, "counter_changes_out", "append")
        assert told(counters.totals(got)) == replay(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_state_ends_with_its_time(spark, tmp_path):
    day = dt.timedelta(days=1)
    at = lambda k, action, actor: (actor, 7, action, START + k * day, k, 1, "s", 1)
    parts = [[at(0, "like_post", 1)], [at(1, "like_post", 1)], [at(30, "like_post", 2)], [at(60, "like_post", 3)], [at(61, "unlike_post", 1), at(61, "unlike_post", 3)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    try:
        job = lambda df: stream.counter_changes(df, "1 day", 10 * day)
        got = streamed(spark, tmp_path, parts, SCHEMA, job, "counter_keep_out", "append")
        # the second like changes nothing; the like of account 1 is settled when it is taken back, that of account 3 isn't
        assert sorted(r.n for r in got.collect()) == [-1, 1, 1, 1]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_root_counters(spark, tmp_path):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "post_id long, root long")
    rows = [(1, "like"), (2, "like"), (3, "like"), (3, "repost"), (9, "like")]
    got = streamed(spark, tmp_path, [rows[:2], rows[2:]], "post_id long, action string", lambda df: jobs.root_counters(df, roots), "roots_out", "complete")
    assert {(r.post_id, r.action): r.n for r in got.collect()} == {(1, "like"): 2, (2, "like"): 2, (3, "like"): 1, (3, "repost"): 1, (2, "repost"): 1}
