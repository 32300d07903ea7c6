"""The vector index against the exact joins."""

import numpy as np
import pytest

from tidemark.operators import simjoin, vectorindex

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, cell int, v string"


def clustered(spark, n, seed=1, dims=32):
    """n vectors in groups of about ten."""
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(n // 10, dims))
    m = centre[rnd.integers(0, len(centre), n)] + 0.35 * rnd.normal(size=(n, dims))
    return spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(m.tolist())], SCHEMA).repartition(8)


def pairs(df):
    return {(r.a, r.b): r.score for r in df.collect()}


def test_threshold_pairs_and_growth(spark):
    share = []
    for n in (1000, 4000):
        df = clustered(spark, n)
        index = vectorindex.fit(df, "vec_id", "embedding", above=0.7)
        exact, near = pairs(simjoin.cosine_pairs(df, "vec_id", "embedding", 0.7)), pairs(vectorindex.cosine_pairs(df, "vec_id", "embedding", 0.7, index))
        assert set(near) <= set(exact) and all(a < b for a, b in near)
        assert len(near) >= 0.95 * len(exact) > 0
        assert all(abs(near[p] - exact[p]) < 1e-5 for p in near)
        share.append(vectorindex.compared(df, "vec_id", "embedding", index) / (n * (n - 1) / 2))
    assert share[1] < 0.6 * share[0] < 0.6  # four times the vectors: well below sixteen times the pairs


def test_vectors_without_structure(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    index = vectorindex.fit(df, "vec_id", "embedding", above=0.4)
    exact, near = pairs(simjoin.cosine_pairs(df, "vec_id", "embedding", 0.4)), pairs(vectorindex.cosine_pairs(df, "vec_id", "embedding", 0.4, index))
    assert set(near) <= set(exact) and len(near) >= 0.95 * len(exact)


def test_neighbours(spark):
    df = clustered(spark, 3000)
    index = vectorindex.fit(df, "vec_id", "embedding", k=5)
    queries = df.where("vec_id % 20 = 0")
    exact = {(r.query, r.item) for r in simjoin.top_k(queries, df, "vec_id", "vec_id", "embedding", 5, skip_same=True).collect()}
    near = {(r.query, r.item) for r in vectorindex.top_k(queries, df, "vec_id", "vec_id", "embedding", 5, index, skip_same=True).collect()}
    assert len(near & exact) >= 0.95 * len(exact) and len(exact) == 5 * 150


def test_crowded_cell_is_cut_in_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0, i / 1000.0], 1, "x") for i in range(300)] + [(300, [0.0, 1.0, 0.0], 1, "x"), (301, [0.0, 0.0, 0.0], 1, "x"), (None, [1.0, 0.0, 0.0], 1, "x"), (302, None, 1, "x")], SCHEMA)
    block, vectorindex.BLOCK, exact_block, simjoin.BLOCK = vectorindex.BLOCK, 32, simjoin.BLOCK, 32
    try:
        index = vectorindex.fit(df, "vec_id", "embedding", above=0.999, cells=2)
        near, exact = pairs(vectorindex.cosine_pairs(df, "vec_id", "embedding", 0.999, index._replace(probes=2))), pairs(simjoin.cosine_pairs(df, "vec_id", "embedding", 0.999))
    finally:
        vectorindex.BLOCK, simjoin.BLOCK = block, exact_block
    assert set(near) == set(exact) and len(near) > 1000 and max(max(p) for p in near) < 300


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1, "x")], [(1, None, 1, "x")]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    index = vectorindex.fit(df, "vec_id", "embedding", above=0.5)
    assert vectorindex.cosine_pairs(df, "vec_id", "embedding", 0.5, index).count() == 0
    assert vectorindex.top_k(df, df, "vec_id", "vec_id", "embedding", 3, index).count() == sum(v is not None for _, v, *_ in rows)
