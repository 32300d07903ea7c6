"""Cascades in time, directed clustering, draws, quotas and sums over pairs against plain Python."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cascade, graph, sampling, simjoin
from tidemark.plans.graphs import measures_of_pairs


def distances(nodes, neighbours, source):
    far, todo = {source: 0}, [source]
    for x in todo:
        for y in neighbours(x):
            if y in nodes and y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    return far


def brute_times(nodes, edges):
    out = {}
    for c in {c for c, *_ in nodes}:
        own = {n: t for k, n, t, _ in nodes if k == c}
        (root,) = [n for k, n, _, r in nodes if k == c and r]
        down, both = collections.defaultdict(set), collections.defaultdict(set)
        for k, a, b in edges:
            if k == c and a in own and b in own and a != b:
                down[a].add(b)
                both[a].add(b)
                both[b].add(a)
        for at in sorted(set(own.values())):
            if own[root] > at:
                continue
            seen = {n for n, t in own.items() if t <= at}
            far = distances(seen, lambda x: down[x], root)
            sizes = collections.Counter(far.values())
            total = sum(sum(distances(far, lambda x: both[x], s).values()) for s in far)
            n = len(far)
            out[c, at] = (n, max(far.values()), max((v for k, v in sizes.items() if k), default=0), total / (n * (n - 1)) if n > 1 else None)
    return out


def test_cascades_with_cycles(spark):
    rnd = random.Random(6)
    nodes = [(c, n, rnd.randint(0, 6), n == 0) for c in range(6) for n in range(rnd.choice([1, 4, 14]))]
    edges = [(c, rnd.randrange(14), rnd.randrange(14)) for c in range(6) for _ in range(24)]
    odd = [(0, None, 1, False), (None, 1, 1, False), (0, 0, 99, False)]
    df = spark.createDataFrame(nodes + odd, "cascade long, node long, time long, is_root boolean")
    got = cascade.over_time(df, spark.createDataFrame(edges + edges[:5] + [(0, None, 1)], "cascade long, src long, dst long"))
    want = brute_times(nodes, edges)
    found = {(r.cascade, r["at"]): (r["size"], r.depth, r.breadth, r.virality) for r in got.collect()}
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k][:3] == v[:3] and (found[k][3] == pytest.approx(v[3]) if v[3] is not None else found[k][3] is None)


def test_directed_clustering(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(160)]
    a = np.zeros((25, 25))
    for x, y in edges:
        a[x, y] = x != y
    w = a + a.T
    cubes, d, r = np.diag(w @ w @ w), w.sum(1), (a @ a).diagonal()
    got = {x.node: x for x in graph.directed_clustering(spark.createDataFrame(edges + edges[:9], "src long, dst long")).collect()}
    for k in range(25):
        if w[k].any():
            could = 2 * (d[k] * (d[k] - 1) - 2 * r[k])
            assert got[k].triangles == cubes[k] and got[k].reciprocal == r[k] and got[k].coefficient == pytest.approx(cubes[k] / could if could else 0)
    assert len(got) == (w.any(1)).sum()


def test_negative_pairs(spark):
    rnd = random.Random(1)
    edges = sorted({(min(a, 59), b) for a, b in ((int(60 * rnd.random() ** 3), rnd.randrange(60)) for _ in range(500))})
    df = spark.createDataFrame([*edges, (None, 1)], "src long, dst long")
    slices, sampling.SLICE = sampling.SLICE, 7
    try:
        pairs = [(r.a, r.b) for r in sampling.negative_pairs(df, 300).collect()]
        again = [(r.a, r.b) for r in sampling.negative_pairs(df.repartition(7), 300).collect()]
    finally:
        sampling.SLICE = slices
    known = {(min(e), max(e)) for e in edges}
    assert len(set(pairs)) == len(pairs) == 300 and not set(pairs) & known and all(a < b for a, b in pairs) and sorted(pairs) == sorted(again)
    with pytest.raises(ValueError):
        sampling.negative_pairs(df, 60 * 59 // 2)
    few = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert sorted(map(tuple, sampling.negative_pairs(few, 3).collect())) == [(0, 2), (0, 3), (1, 3)]
    assert sampling.negative_pairs(few, 0).count() == 0


def test_draws_follow_the_weights(spark):
    weights = {0: 1.0, 1: 4.0, 2: 0.0, 3: 10.0, 4: 25.0, 5: None}
    line, total = sampling.intervals(spark.createDataFrame(list(weights.items()), "node long, w double"), "node", "w")
    places = spark.range(20000).select(F.col("id").alias("draw"), sampling.uniform(F.lit(3), "id").alias("at"))
    seen = collections.Counter(r.key for r in sampling.drawn(places, line, total, 3).collect())
    assert total == 40.0 and sum(seen.values()) == 20000
    assert all(abs(seen[k] / 20000 - (w or 0) / 40) < 0.012 for k, w in weights.items())


def test_quotas_close(spark):
    rnd = random.Random(8)
    rows = [(k, g, rnd.choice([0, 1, 1, 3, 50, None])) for k in range(60) for g in range(rnd.randint(1, 7))]
    df = spark.createDataFrame(rows, "k int, g int, n int")
    for target in (0, 3, 10, 40, 1000):
        got = collections.defaultdict(dict)
        for r in sampling.apportion(df, ["k"], "g", "n", target).collect():
            got[r.k][r.g] = (r.n or 0, r.quota)
        for own in got.values():
            total, some = sum(n for n, _ in own.values()), sum(n > 0 for n, _ in own.values())
            assert sum(q for _, q in own.values()) == min(target, total)
            assert all(0 <= q <= n for n, q in own.values())
            if target >= some:
                assert all(q > 0 for n, q in own.values() if n)
            if target >= 2 * some and all(n == 0 or n * min(target, total) >= total for n, _ in own.values()):
                assert all(abs(q - n * min(target, total) / max(total, 1)) < 1 for n, q in own.values())
    one = sampling.apportion(df.groupBy("g").agg(F.sum("n").alias("n")), [], "g", "n", 25)
    assert one.agg(F.sum("quota")).first()[0] == 25


def test_sums_over_pairs_of_blocks(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(90, 5))
    rows = [(i, "big" if i < 70 else None if i < 72 else f"g{i % 3}", v[i].tolist(), v[i, :2].tolist()) for i in range(90)]
    df = spark.createDataFrame([*rows, (None, "big", v[0].tolist(), v[0, :2].tolist())], "vec_id long, label string, known array<double>, told array<double>")
    block, simjoin.BLOCK = simjoin.BLOCK, 16
    try:
        got = {r.label: r for r in measures_of_pairs(df, "label", "vec_id", "known", "told").collect()}
    finally:
        simjoin.BLOCK = block
    for label in {r[1] for r in rows}:
        own = [(np.array(a), np.array(b)) for _, g, a, b in rows if g == label]
        off = [abs(np.linalg.norm(b - d) - np.linalg.norm(a - c)) / np.linalg.norm(a - c) for (a, b), (c, d) in itertools.combinations(own, 2)]
        assert got[label].pairs == len(off) and got[label].distortion == pytest.approx(np.mean(off))
