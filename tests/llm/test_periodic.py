"""Periodic runs against a walk along every diagonal."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import periodic
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, start int, length int, runs string, word string"


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - begin + q >= max(least, 2 * q):
                found.setdefault((begin, i - begin + q), q)
            i += i == begin
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def random_words(rnd):
    n, letters = rnd.randint(0, 90), rnd.choice(["a", "ab", "abc", "abcdefgh"])
    words = [rnd.choice(letters) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [12, 5, 8])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    for _ in range(400):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 4))]
        for words, (n, runs, kept) in zip(texts, periodic.found_in([" ".join(w).encode() for w in texts], least), strict=True):
            want = brute_runs(words, least)
            assert n == len(words) and sorted(map(tuple, runs.tolist())) == want
            assert kept.decode() == brute_kept(words, want)


def test_odd_rows(spark):
    one = "la " * 12
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, one), (4, one), (4, one), (5, one[:-3]), (6, "né é " * 12), (7, "word " * 60000), (8, "ab\x1fcd\x0bef " * 9)]
    found = periodic.find_runs(spark.createDataFrame([(i, t, 1, 2, "r", "w") for i, t in rows], DOCS))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr)
    want = [((i is None), i or 0, len(w := split(t)), brute_runs(w) if i != 7 else [(0, 60000, 1)], brute_kept(w, brute_runs(w)) if i != 7 else "word") for i, t in rows]
    assert got == sorted(want, key=repr)
    assert periodic.find_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_over_many_batches(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(random_words(rnd) * rnd.choice([1, 1, 200]))) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    together, periodic.TOGETHER = periodic.TOGETHER, 300
    try:
        got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        periodic.TOGETHER = together
    for i, t in rows:
        if len(t) < 600:
            want = brute_runs(split(t))
            assert got[i] == (want, brute_kept(split(t), want))
    assert len(got) == 300


def test_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    planted = 0
    for doc, text in docs:
        w, h = split(text), zlib.crc32(str(doc).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = brute_runs(w)
        best = max(((n, -s, -q) for s, n, q in runs), default=None)
        head = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
        assert got[doc] == (len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_kept(w, runs)))
    assert planted and len(got) == len(docs)
