"""Case folding, and the next document where ids are sparse."""

import random
import unicodedata

from pyspark.sql import functions as F

from tidemark.llm import fingerprint
from tests.llm.test_ops import docs


def test_case_folding(spark):
    same = [("STRASSE", "straße"), ("ΟΔΟΣ", "οδος"), ("ΟΔΟΣ", "οδοσ"), ("Ǆ", "ǆ"), ("É", "é"), ("ﬁne", "FINE"), ("A  B", "a b"), (None, "  ")]
    different = [("a", "á"), ("strase", "straße"), ("ab", "a b"), ("1", "¹")]
    texts = [t for pair in same + different for t in pair]
    got = {r.doc_id: r.fingerprint for r in fingerprint.duplicate_groups(docs(spark, list(enumerate(texts)))).collect()}
    for k in range(len(same)):
        assert got[2 * k] == got[2 * k + 1], same[k]
    for k in range(len(same), len(same) + len(different)):
        assert got[2 * k] != got[2 * k + 1]


def test_canonical_form(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aAßẞİIıéÉé \t ﬃΣςσ漢\U0001f600") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", fingerprint.canonical(F.col("text")).alias("c")).collect()
    for i, c in rows:
        want = " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", texts[i]).casefold()).split())
        assert c == want


def test_next_document_of_sparse_ids(spark):
    rnd = random.Random(2)
    ids = [rnd.getrandbits(63) - (1 << 62) for _ in range(400)] + list(range(3000, 3100))
    rows = [(i, f"text {i}") for i in ids]
    rnd.shuffle(rows)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next_text(docs(spark, rows)).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    one = fingerprint.with_next_text(docs(spark, [(7, "own")])).collect()
    assert [(r.text, r.next_text) for r in one] == [("own", "own")] and fingerprint.with_next_text(docs(spark, [])).count() == 0
