"""Mixed recommendation scores, swaps, feeds and threads on small rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import feeds, simjoin


def test_mixed_scores_in_blocks(spark):
    rnd = np.random.default_rng(1)
    u, p, like, hate = rnd.normal(size=(9, 4)), rnd.normal(size=(60, 4)), rnd.normal(size=(9, 4)), rnd.normal(size=(9, 4))
    queries = spark.createDataFrame([(i, u[i].tolist(), like[i].tolist() if i else None, hate[i].tolist()) for i in range(9)], "id long, u array<double>, liked array<double>, disliked array<double>")
    items = spark.createDataFrame([(i, p[i].tolist(), float(i % 5), i % 9) for i in range(60)], "id long, u array<double>, weight double, owner long")
    block, simjoin.BLOCK = simjoin.BLOCK, 7
    try:
        ready = feeds.with_spread(queries, items)
        got = {(r.query, r["item"]) for r in feeds.best(ready, items, feeds.trace_score, 5).collect()}
        recent = {(r.query, r["item"]) for r in feeds.best(ready, items, feeds.recency_score, 5).collect()}
    finally:
        simjoin.BLOCK = block
    like[0] = 0
    base = np.where(np.arange(9)[:, None] == np.arange(60) % 9, np.nan, u @ p.T)
    spread = np.nanmax(base, 1) - np.nanmin(base, 1)
    for found, s in ((got, base + (like @ p.T - hate @ p.T) * spread[:, None] / 2), (recent, base * (np.arange(60) % 5 + like @ p.T))):
        assert found == {(i, int(k)) for i in range(9) for k in np.argsort(-np.where(np.isnan(s[i]), -np.inf, s[i]))[:5]}


def test_mean_of_unit_vectors(spark):
    rows = [(1, [3.0, 4.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None)]
    got = {r.k: r.m for r in feeds.mean_unit(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", "m").collect()}
    assert np.allclose(got[1], [0.3, 0.9]) and got[2] == [0.0, 0.0] and 3 not in got


def test_a_tenth_is_swapped(spark):
    rnd = random.Random(2)
    recs = [(q, i) for q in range(30) for i in rnd.sample(range(400), 25 if q else 9)]
    found = feeds.swapped(spark.createDataFrame(recs, "query long, item long"), spark.range(400).toDF("item")).collect()
    for q in range(30):
        old, new = {i for k, i in recs if k == q}, [r["item"] for r in found if r.query == q]
        assert len(new) == len(set(new)) == len(old) and len(set(new) - old) == (2 if q else 0) == sum(r.swapped for r in found if r.query == q)


def test_threads(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, content string")
    comments = spark.createDataFrame([(1, k, k in (4, 9), f"c{k}") for k in range(12)] + [(3, 50, False, "x")], "post_id long, comment_id long, is_warning boolean, text string")
    got = {r.post_id: r for r in feeds.threads(posts, comments).collect()}
    assert len(got) == 2 and got[2].comments == [] and got[1].content == "a"
    assert len(got[1].comments) == 5 and got[1].comments[0].comment_id == 4 and len({c.comment_id for c in got[1].comments}) == 5
    again = feeds.threads(posts, comments.repartition(5)).where(F.col("post_id") == 1).first()
    assert again.comments == got[1].comments
