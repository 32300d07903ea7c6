"""Iterated graph measures against plain Python on small random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.operators.components import connected_components


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(3)
    return sorted({(rnd.randrange(12), rnd.randrange(12)) for _ in range(26)} - {(i, i) for i in range(12)}) + [(20, 21), (21, 22), (20, 22)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def around(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def test_components(spark, pairs):
    near, want = around(pairs), {}
    for s in sorted(near):
        if s not in want:
            queue = deque([s])
            while queue:
                x = queue.popleft()
                if x not in want:
                    want[x] = s
                    queue += near[x]
    assert {r.node: r.component for r in connected_components(frame(spark, pairs)).collect()} == want
    assert connected_components(frame(spark, []).limit(0)).count() == 0
    chain = [(i, i + 1) for i in range(40)]
    assert {r.component for r in connected_components(frame(spark, chain)).collect()} == {0}


def test_core_numbers(spark, pairs):
    near, core = around(pairs), {}
    left = {k: set(v) for k, v in near.items()}
    k = 0
    while left:
        low = [n for n, v in left.items() if len(v) <= k]
        if not low:
            k += 1
            continue
        for n in low:
            core[n] = k
            for m in left.pop(n):
                left.get(m, set()).discard(n)
    assert {r.node: r.core for r in graph.core_numbers(frame(spark, pairs)).collect()} == core


def test_pagerank(spark, pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(100):
        lost = sum(r for n, r in rank.items() if not out[n])
        new = {n: (0.15 + 0.85 * lost) / len(nodes) for n in nodes}
        for n, r in rank.items():
            for m in out[n]:
                new[m] += 0.85 * r / len(out[n])
        rank = new
    got = {r.node: r.rank for r in graph.pagerank(frame(spark, pairs), tolerance=1e-10).collect()}
    assert got.keys() == rank.keys() and max(abs(got[n] - rank[n]) for n in nodes) < 1e-6


def test_betweenness(spark, pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    nodes = {x for p in pairs for x in p}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        d = defaultdict(float)
        for v in reversed(order):
            for w in out[v]:
                if dist[w] == dist[v] + 1:
                    d[v] += paths[v] / paths[w] * (1 + d[w])
            if v != s:
                score[v] += d[v]
    got = {r.node: r.score for r in graph.betweenness(frame(spark, pairs)).collect()}
    assert got.keys() == score.keys() and max(abs(got[n] - score[n]) for n in score) < 1e-9


def test_communities_find_two_cliques(spark):
    clique = lambda ns: [(a, b) for a in ns for b in ns if a < b]
    edges = clique(range(6)) + clique(range(10, 16)) + [(0, 10)]
    got = {r.node: r.community for r in graph.communities(frame(spark, edges)).collect()}
    assert len({got[n] for n in range(6)}) == 1 and len({got[n] for n in range(10, 16)}) == 1 and got[0] != got[10]


def test_roots_with_cycle_and_missing_parent(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, parent long")
    got = {r.id: (r.root, r.depth) for r in graph.resolve_roots(nodes, rounds=6).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (None, None), 6: (None, None)}


def test_betweenness_estimate_is_near_the_whole(spark):
    """From a quarter of the nodes, scaled, the ranking and the sum of scores are near those from all."""
    rnd = random.Random(12)
    edges = [(int(120 * rnd.random() ** 2), rnd.randrange(120)) for _ in range(700)]
    e = spark.createDataFrame(edges, "src long, dst long").distinct()
    nodes = e.selectExpr("explode(array(src, dst)) as node").distinct()
    whole = {r.node: r.score for r in graph.betweenness(e).collect()}
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(30)
    part = {r.node: r.score * nodes.count() / 30 for r in graph.betweenness(e, some).collect()}
    top = lambda s: set(sorted(s, key=lambda k: (-s[k], k))[:12])
    assert len(top(whole) & top(part)) >= 8
    assert abs(sum(part.values()) / sum(whole.values()) - 1) < 0.25
