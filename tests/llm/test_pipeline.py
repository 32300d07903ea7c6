"""The pipeline's stages against brute force."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid
from tests.llm.test_ops import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, "s", 0), (900002, "123 456", "en", "s", 7)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs.unionByName(odd), SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
    cut = stages["lines"](spark, kept, SF)
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    rows = cut.collect()
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    one = stages["near_copies"](spark, docs, SF)
    groups = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {d for d, (_, c) in groups.items() if c == d}
    clean = stages["leaks"](spark, docs, SF)
    words = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if not any(i in words(r.text) for i in items)}


def test_language_decides_row_by_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "the cat sat on the mat", "en", "s", 22) for i in range(20)] + [(None, "the dog and the cat", "en", "s", 19), (None, "123 456", "en", "s", 7), (5, "!!", "en", "s", 2)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert len(kept) == 21 and {r.text for r in kept} == {"the cat sat on the mat", "the dog and the cat"} and sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 5 for r in kept) == 1
    unlabelled = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], schema)
    assert corpus_pipeline.language(spark, unlabelled, SF).count() == len(rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where(F.col("n_tokens") < 0).count() == 0 and 0 < out.count() <= 200
    assert np.all([len(r.ids_sha256) == 64 for r in out.collect()])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, text_hash long, row int, leaked_doc string, copied_doc string, shared_id int, `a.b` string, lines_removed string"
LONG = " ".join(f"word{i}" for i in range(4000))


def odd_docs(spark):
    """Null and shared ids, repeated rows, empty, null and very long texts, ties, and columns named as helpers are."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = [f"n{i}" for i in range(60)]
    texts = [
        (None, "the cat sat on the mat with another cat"), (None, "a dog ran over the road to the other side"), (None, None), (None, "leak " + item), (None, " ".join(near)),
        (7, "one text under the id that two texts share"), (7, "another text under this id, and quite unlike"), (7, "one text under the id that two texts share"), (7, "leak " + item + " end"),
        (8, " ".join([*near[:59], "other"])), (9, " ".join(near)), (10, LONG), (11, LONG), (12, ""), (12, ""), (13, "   \n "), (14, "unlike all else in here, a line of its own"),
    ]
    rows = [(i, t, "en", "s", len(t or ""), "d", 1, 2, "l", "c", 3, "ab", "r") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA), rows, item


def kept(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_near_copies_of_odd_rows(spark):
    df, rows, _ = odd_docs(spark)
    out = dict(corpus_pipeline.STAGES)["near_copies"](spark, df, SF)
    assert out.columns == df.columns
    texts = [(r[0], r[1]) for r in kept(out)]
    want = [(i, t) for i, t, *_ in rows if t is None or not t.split() or i == 14]
    want += [(None, rows[0][1]), (None, rows[1][1]), (None, rows[3][1]), (7, rows[5][1]), (7, rows[6][1]), (8, rows[9][1]), (10, LONG)]  # 8 < 9 and before a null id; the leaks of ids null and 7 are alike enough
    leaks = [x for x in texts if x[1] and x[1].startswith("leak")]
    assert len(leaks) == len({" ".join(x[1].split()) for x in leaks}) and 1 <= len(leaks) <= 2
    assert sorted([x for x in texts if x not in leaks], key=repr) == sorted([x for x in want if not (x[1] or "").startswith("leak")], key=repr)
    assert all(r[2:4] + r[5:] == rows[0][2:4] + rows[0][5:] for r in kept(out))


def test_leaks_of_odd_rows(spark):
    df, rows, item = odd_docs(spark)
    out = dict(corpus_pipeline.STAGES)["leaks"](spark, df, SF)
    assert out.columns == df.columns and kept(out) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)


def test_lines_of_odd_rows(spark):
    df, rows, _ = odd_docs(spark)
    out = dict(corpus_pipeline.STAGES)["lines"](spark, df, SF)
    got = kept(out)
    assert out.columns == df.columns and len(got) == len(rows) and all(r[4] == (len(r[1]) if r[1] is not None else None) for r in got)
    assert all(r[2:4] + r[5:] == rows[0][2:4] + rows[0][5:] for r in got)
    assert sum((r[1] or "").startswith("word0") for r in got) == 1 and sum((r[1] or "").startswith("one text") for r in got) == 2


def test_stages_on_no_rows(spark):
    df, _, _ = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.limit(0), SF)
        assert out.count() == 0 and (name == "encoding" or out.columns == df.columns)
    assert dict(corpus_pipeline.STAGES)["encoding"](spark, df, SF).count() == df.count()


def test_language_rejects_by_the_decoder(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = langid.train(base)
    rows = base.collect()
    x = np.stack([langid.features(r.text) for r in rows])
    _, share, lead = langid.decode(model, x)
    want = {r.doc_id for r, s, g in zip(rows, share, lead, strict=True) if s >= langid.WEAK or g >= langid.LEAD}
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (-1, "12 + 3", "en", "s", 6)], schema)
    assert {r.doc_id for r in langid.with_language(base.unionByName(odd), model).collect()} == want
    flat = {**model, "w": model["w"] * 0, "b": model["b"] * 0}  # a decoder that knows nothing is unsure of all
    assert langid.with_language(base, flat).count() == 0
