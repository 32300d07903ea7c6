"""Candidate mode of the similarity joins: vectors lie in the cells of their nearest centroids, and only vectors that share a cell are compared.

The exact joins of ``simjoin`` compare all pairs; here the number of cells grows with the root of the number of vectors, so the pairs
compared grow below its square. Each pair that comes out was checked by its cosine; some may be missed, and ``fit`` chooses the number of
cells a vector lies in so that the wanted share is found of the pairs of a query sample, which it knows exactly.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import simjoin
from tidemark.plans.shared import stored

#: Vectors that centroids are fitted on, about; picked by a hash of the id.
SAMPLE = 20_000
#: Query vectors of the sample whose true neighbours set the number of probes.
PROBED = 256
#: Most centroids; each task holds all of them.
MOST_CELLS = 16_384
#: Vectors of a cell that one task compares with as many others.
BLOCK = 2048


class Index(NamedTuple):
    centroids: np.ndarray  # unit vectors, one a cell
    probes: int  # cells that each vector lies in
    recall: float  # share of the sample's true pairs that meet in a cell


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def nearest(m: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each vector."""
    s = m @ centroids.T
    if probes >= s.shape[1]:
        return np.tile(np.arange(s.shape[1]), (len(m), 1))
    return np.argpartition(-s, probes - 1, axis=1)[:, :probes]


def fitted_centroids(sample: np.ndarray, cells: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors takes a random one."""
    rnd = np.random.default_rng(seed)
    centroids = sample[rnd.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        cell = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.bincount(cell, minlength=cells) == 0
        sums[empty] = sample[rnd.integers(0, len(sample), int(empty.sum()))]
        centroids = unit(sums)
    return centroids


def fit(df: DataFrame, key: str, vector: str, above: float | None = None, k: int | None = None, recall: float = 0.97, cells: int | None = None, seed: int = 7) -> Index:
    """Centroids from about SAMPLE vectors, and the fewest probes with which ``recall`` of the true pairs of PROBED query vectors meet in a cell:
    pairs with a cosine above ``above`` (the 50 nearest of each query at most), or of each query and its ``k`` nearest.

    Rows with a null id or vector are left out; without any vector, or any true pair, one probe is used.
    """
    have = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = have.count()
    cells = min(cells or max(1, round(2 * math.sqrt(n))), MOST_CELLS, max(1, n))
    one_of = max(1, n // max(SAMPLE, cells))
    drawn = have.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(one_of)) == 0).toPandas().sort_values("id") if n else pd.DataFrame({"id": [], "v": []})
    if not len(drawn):
        return Index(np.zeros((1, 1)), 1, 1.0)
    sample = unit(np.stack(drawn["v"].to_numpy()))
    centroids = fitted_centroids(sample, min(cells, len(sample)), seed)
    picked = np.random.default_rng(seed).choice(len(sample), min(PROBED, len(sample)), replace=False)
    asked = df.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(drawn["id"].to_numpy()[picked], sample[picked], strict=True)], "id long, v array<double>")
    true = simjoin.top_k(asked, have, "id", "id", "v", k or 50, skip_same=True)
    true = true.where(F.col("score") > above) if above is not None else true
    met = true.join(asked.select(F.col("id").alias("query"), F.col("v").alias("q")), "query").join(have.select(F.col("id").alias("item"), F.col("v").alias("i")), "item").select("q", "i").toPandas()
    if not len(met):
        return Index(centroids, 1, 1.0)
    ranks = [np.argsort(np.argsort(-unit(np.stack(met[c].to_numpy())) @ centroids.T, axis=1), axis=1) for c in "qi"]
    needed = np.sort(np.maximum(*ranks).min(1) + 1)
    probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
    return Index(centroids, probes, float((needed <= probes).mean()))


def placed(df: DataFrame, key: str, vector: str, index: Index) -> DataFrame:
    """cell, id, v: each vector once for each of its cells. Vectors of norm zero are like nothing and lie in no cell."""

    def run(batches):
        for pdf in batches:
            m = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            keep = np.flatnonzero(np.linalg.norm(m, axis=1) > 0) if len(pdf) else []
            if len(keep):
                m = unit(m[keep])
                cells = nearest(m, index.centroids, index.probes)
                at = np.repeat(np.arange(len(keep)), cells.shape[1])
                yield pd.DataFrame({"cell": cells.ravel().astype(np.int32), "id": pdf["id"].to_numpy()[keep][at], "v": list(m.astype(np.float32)[at])})

    have = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return have.mapInPandas(run, "cell int, id long, v array<float>")


def in_cells(left: DataFrame, right: DataFrame | None, keep) -> DataFrame:
    """query, item, score of what ``keep(scores, query ids, item ids)`` picks in each block of a cell; ``right`` None joins ``left`` with itself, each block pair once."""
    own = left if right is None else right
    blocks = lambda rows: rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    counts = blocks(left).withColumnRenamed("blocks", "lefts").join(blocks(own).withColumnRenamed("blocks", "rights"), "cell")
    counts = F.broadcast(counts)  # a row a cell, MOST_CELLS at most
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = left.join(counts, "cell").withColumn("l", part("lefts"))
    b = own.join(counts, "cell").withColumn("r", part("rights"))
    first, last = (F.col("l"), F.col("r")) if right is None else (F.lit(0), F.col("lefts") - 1)
    a = a.select("cell", "l", F.explode(F.sequence(first, F.col("rights") - 1)).alias("r"), F.lit(0).alias("side"), "id", "v")
    b = b.select("cell", F.explode(F.sequence(F.lit(0), last)).alias("l"), "r", F.lit(1).alias("side"), "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        q, i = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(q) or not len(i):
            return pd.DataFrame({"query": [], "item": [], "score": []}).astype({"query": "int64", "item": "int64"})
        s = np.stack(q["v"].to_numpy()).astype(np.float64) @ np.stack(i["v"].to_numpy()).astype(np.float64).T
        qi, ii = q["id"].to_numpy(), i["id"].to_numpy()
        x, y = keep(s, qi, ii, pdf["l"].iloc[0] == pdf["r"].iloc[0])
        return pd.DataFrame({"query": qi[x], "item": ii[y], "score": s[x, y]})

    met = a.unionByName(b.select(*a.columns)).groupBy("cell", "l", "r").applyInPandas(run, "query long, item long, score double")
    return met


def cosine_pairs(df: DataFrame, key: str, vector: str, above: float, index: Index) -> DataFrame:
    """a < b, score of the pairs of vectors that share a cell and have a cosine above the threshold."""

    def keep(s, q, i, same):
        x, y = np.nonzero((s > above) & (q[:, None] != i[None]))
        if same:  # both halves of a block with itself
            x, y = x[q[x] < i[y]], y[q[x] < i[y]]
        return x, y

    rows = stored(placed(df, key, vector, index))
    found = in_cells(rows, None, keep).select(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b"), "score")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def top_k(queries: DataFrame, items: DataFrame, qkey: str, ikey: str, vector: str, k: int, index: Index, skip_same: bool = False) -> DataFrame:
    """query, item, score of the k best items that share a cell with each query; each block sends its own k best. Ties go to the smaller item id."""

    def keep(s, q, i, same):
        s = np.round(s, 6)
        if skip_same:
            s = np.where(q[:, None] == i[None], -np.inf, s)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        x, y = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
        ok = np.isfinite(s[x, y])
        return x[ok], y[ok]

    found = in_cells(stored(placed(queries, qkey, vector, index)), stored(placed(items, ikey, vector, index)), keep)
    one = found.groupBy("query", "item").agg(F.max("score").alias("score"))
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "item"))
    return one.withColumn("n", n).where(F.col("n") <= k).drop("n")


def compared(df: DataFrame, key: str, vector: str, index: Index) -> int:
    """Pairs that the self-join compares, a pair that shares several cells counted in each."""
    m = placed(df, key, vector, index).groupBy("cell").agg(F.count("*").alias("m"))
    return m.agg(F.coalesce(F.sum(F.expr("m * (m - 1) / 2").cast("long")), F.lit(0))).first()[0]
