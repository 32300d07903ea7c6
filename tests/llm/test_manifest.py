"""The Merkle manifest against a plain build of all trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, rank int, left int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def path(levels, i, leaf):
    """Siblings of node i, and what ``leaf`` in its place folds to."""
    seen = []
    for level in levels[:-1]:
        low = i // 16 * 16
        run = level[low : low + 16]
        seen += run[: i - low] + run[i - low + 1 :]
        leaf = sha("".join(run[: i - low] + [leaf] + run[i - low + 1 :]))
        i //= 16
    return "".join(seen), leaf


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        own = []
        for doc_id, text, lang, source, n in trees[s]:
            leaf = brute_leaf([doc_id, source, lang, n, text])
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            own.append((doc_id is not None, doc_id or 0, leaf, brute_leaf([doc_id, source, lang, n, lower]) if hit else leaf, doc_id))
        own.sort(key=lambda x: x[:3])
        built[s] = own, brute_levels([x[2] for x in own])
    tops = brute_levels([built[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, levels = built[s]
        for i, (_, _, leaf, other, doc_id) in enumerate(own):
            low, sub = path(levels, i, other)
            high, root = path(tops, k, sub)
            out.append((doc_id, leaf, levels[-1][0], tops[-1][0], low + high, root, root == tops[-1][0]))
    return out


def manifested(docs):
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.translate("text", capitals, capitals.lower())}, lambda d: F.crc32(d.cast("string").cast("binary")) % 5 == 0)


def some(rnd, n, sources):
    return [(rnd.choice([None, i, i, i, i // 3]), rnd.choice([None, "", "Ab C", "é Ü Z\n", f"T{i}"]), rnd.choice([None, "en"]), rnd.choice(sources), rnd.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(600, [None, "", "-", "a", "B", "é", "\U0001f600", "￿"] + ["hot"] * 12), (70, [f"s{i}" for i in range(400)]), (5, ["one"]), (1, ["one"]), (40, ["one"]), (0, ["one"])])
def test_equals_plain_build(spark, n, sources):
    rows = some(random.Random(n), n, sources)
    rows += rows[:3]
    part, manifest.PART = manifest.PART, 64
    try:
        docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
        got = sorted((tuple(r) for r in manifested(docs).collect()), key=repr)
    finally:
        manifest.PART = part
    assert got == sorted(brute_manifest(rows), key=repr)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_query_equals_plain_build(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = sorted((*r[:4], sha(r[4]), *r[5:]) for r in brute_manifest(docs))
    got = sorted(tuple(r) for r in QUERIES["op13_merkle"](spark, SF).collect())
    assert got == want and 0 < sum(not r[-1] for r in got) < len(got)


def test_very_long_text(spark):
    rows = [(5, "Long " * 400000, "en", "s", 1), (6, "x", "en", "s", 1)]
    got = manifested(spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_manifest(rows))
