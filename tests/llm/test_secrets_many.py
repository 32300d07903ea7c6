"""Texts that hold very many secrets, and candidates beside base spans."""

import random
import time

from pyspark.sql import functions as F

from tidemark.llm import secrets
from tests.llm.test_ops import docs


def test_hundred_thousand_matches_in_one_text(spark):
    lines = [f"token={i:06d}abc" if i % 2 else f"token=x{i:06d}; Zk3Qx9fT7LmW2pR8sVbN4{i:06d}" for i in range(100_000)]
    text = "\n".join(lines)
    began = time.time()
    (row,) = secrets.scan(docs(spark, [(1, text)])).select(F.size("spans").alias("n"), F.size(F.filter("spans", lambda s: s.kind == 0)).alias("base"), F.slice("spans", 1, 3).alias("first"), F.slice("spans", -1, 1).alias("last")).collect()
    assert row.base == 100_000 and row.n == 150_000
    assert time.time() - began < 90
    at = len(lines[0]) + 1
    assert [(s.kind, s.start, s.stop) for s in row.first] == [(0, 0, 13), (3, 15, len(lines[0])), (0, at, at + len(lines[1]))]
    assert row.last[0].stop == len(text)


def test_positions_and_touching_candidates(spark):
    rnd = random.Random(3)
    parts = ["token=abcdef1", "\U0001f600é ", "Zk3Qx9fT7LmW2pR8sVbN4", " ", "\n", "AKIA" + "Z9" * 9, "0f" * 13, "plain words here ", "token=", "/x/", "password: 'q1w2e3r4'"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.choice([1, 5, 40, 3000])))) for i in range(40)]
    rows += [rows[0], (None, rows[1][1])]
    for r in secrets.scan(docs(spark, rows)).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        base = [(s.start, s.stop) for s in r.spans if s.kind < 3]
        assert all(text[s.start : s.stop] == s.value for s in r.spans)
        assert [(s.start, s.kind) for s in r.spans] == sorted((s.start, s.kind) for s in r.spans)
        mine = [(s.start, s.stop) for s in r.spans if s.kind == 3]
        assert not any(a < d and c < b for a, b in mine for c, d in base)
        for kind in range(3):
            found = [s.start for s in r.spans if s.kind == kind]
            assert len(found) == len(set(found))
