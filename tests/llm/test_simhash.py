"""SimHash components against all pairs of fingerprints, and the keys against flipped bits."""

import itertools
import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, print string, component int, n int, key int"


def brute_print(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of ints; index of the first of each component."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_code_is_perfect():
    errors = simhash.error_table()
    assert len(set(errors.tolist())) == 2048 and max(x.bit_count() for x in errors.tolist()) == 3
    rnd = np.random.default_rng(0)
    words = rnd.integers(0, 1 << 23, 500)
    for flips in itertools.combinations(range(23), 2):
        clean = words ^ errors[simhash.remainder(words)]
        assert (simhash.codeword(clean ^ (1 << flips[0]) ^ (1 << flips[1]), errors) == clean >> 11).all()


def test_every_near_print_is_sought():
    rnd, errors = np.random.default_rng(1), simhash.error_table()
    flips = [c for n in range(4) for c in itertools.combinations(range(64), n)]
    for own in rnd.integers(-(1 << 63), 1 << 63, 3):
        near = np.array([int(own) & (1 << 64) - 1 ^ sum(1 << b for b in c) for c in flips], np.uint64).view(np.int64)
        _, sought = simhash.sought_keys(np.array([own]), errors)
        assert np.isin(simhash.own_keys(near, errors), sought).any(1).all()


def close_prints(rnd, n):
    """Chains and crowded groups of prints a few bits apart, and random ones."""
    out = []
    while len(out) < n:
        p = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 40])):
            out.append(p if rnd.random() < 0.9 else rnd.getrandbits(64))
            for _ in range(rnd.randint(0, 4)):
                p ^= 1 << rnd.randrange(64)
    return [x - (1 << 64) if x >> 63 else x for x in out[:n]]


def test_links_connect_what_brute_force_connects(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(63)
    crowd = [centre ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 3))) for _ in range(300)]
    prints = sorted({*close_prints(rnd, 700), *crowd, 0, -1, 1, 7})
    block, simhash.BLOCK = simhash.BLOCK, 16
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        edges = [(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "print long")).collect()]
    finally:
        simhash.BLOCK = block
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unsigned = {p: p & (1 << 64) - 1 for p in prints}
    assert all((unsigned[a] ^ unsigned[b]).bit_count() <= 3 and a < b for a, b in edges)
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = brute_components([unsigned[p] for p in prints])
    assert [prints.index(top(p)) for p in prints] == want


def test_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (None, "One two"), (4, "one  TWO"), (4, "one two"), (5, "word " * 70000), (6, "É a b c"), (3, "é a b c"), (None, "nothing like it at all"), (2, "alone here with four")]
    found = simhash.near_duplicates(spark.createDataFrame([(i, t, "p", 1, 2, 3) for i, t in rows], DOCS))
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    least = {c: min((i for (i, _), k in zip(rows, comp, strict=True) if k == c and i is not None), default=None) for c in comp}
    want = sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, comp, strict=True)), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert {r[2] for r in want if r[1] == "0" * 16} == {7}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(t) for _, t in docs]
    comp = brute_components(prints)
    want = {d: (f"{p:016x}", docs[c].doc_id) for (d, _), p, c in zip(docs, prints, comp, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op11_simhash"](spark, SF).collect()} == want
