"""Recommendation scores that mix several similarities, random swaps, sampled feeds and threads."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import simjoin
from tidemark.operators.tables import cap_per_key


def unit(vector):
    """An array over its length; one of length zero stays."""
    v = F.col(vector).cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def mean_unit(rows: DataFrame, key: str, vector: str, out: str) -> DataFrame:
    """key, ``out``: mean of the unit vectors of each key's rows, in partial sums by place, so a key may have any number."""
    each = rows.select(key, F.posexplode(unit(vector)).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(out))


def mixed(queries: DataFrame, items: DataFrame, score: Callable[..., np.ndarray], per_block: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """What ``per_block(scores, query ids, item ids)`` makes of each two blocks of ``queries`` (id, u, liked, disliked, spread) and ``items`` (id, u, weight, owner).

    scores are ``score(base, like, dislike, weight, spread)``: matrices of the products of the queries' three vectors with the items', the items' weights and the queries'
    spreads. An item of the owner that a query has as its id scores minus infinity. A missing vector counts as zeros.
    """
    nq, ni = (max(1, -(-df.count() // simjoin.BLOCK)) for df in (queries, items))
    zero = F.transform("u", lambda x: F.lit(0.0))
    three = F.concat(F.col("u"), F.coalesce("liked", zero), F.coalesce("disliked", zero))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.where("id is not null and u is not null").select("id", three.alias("v"), F.coalesce(F.col("spread"), F.lit(0.0)).cast("double").alias("w"), F.col("id").alias("owner"), F.lit(0).alias("side"), block(nq).alias("l"), every(ni).alias("r"))
    right = items.where("id is not null and u is not null").select("id", F.col("u").alias("v"), F.col("weight").cast("double").alias("w"), "owner", F.lit(1).alias("side"), every(nq).alias("l"), block(ni).alias("r"))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, i = pdf[pdf.side == 0].sort_values("id"), pdf[pdf.side == 1].sort_values("id")
        if not len(q) or not len(i):
            return pd.DataFrame({n: [] for n in names}).astype({n: "int64" for n in names[:1]})
        p = np.stack(i["v"].to_numpy())
        parts = np.split(np.stack(q["v"].to_numpy()), 3, axis=1)
        s = score(*[part @ p.T for part in parts], i["w"].to_numpy()[None], q["w"].to_numpy()[:, None])
        s = np.where(q["owner"].to_numpy()[:, None] == i["owner"].to_numpy()[None], -np.inf, s)
        return per_block(s, q["id"].to_numpy(), i["id"].to_numpy())

    return left.unionByName(right).groupBy("l", "r").applyInPandas(run, schema)


def best(queries: DataFrame, items: DataFrame, score: Callable[..., np.ndarray], k: int) -> DataFrame:
    """query, item, score of the k best items of each query under ``score`` (see ``mixed``); ties, at nine digits, go to the smaller item."""

    def keep(s, q, i):
        s = np.round(np.where(np.isnan(s), -np.inf, s), 9)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        a, b = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
        ok = np.isfinite(s[a, b])
        return pd.DataFrame({"query": q[a[ok]], "item": i[b[ok]], "score": s[a[ok], b[ok]]})

    found = mixed(queries, items, score, keep, "query long, item long, score double")
    return cap_per_key(found, ["query"], [F.desc("score"), "item"], k)


def recency_score(base, like, dislike, weight, spread):
    """Similarity to the account times the post's weight plus its mean similarity to the posts that the account liked."""
    return base * (weight + like)


def trace_score(base, like, dislike, weight, spread):
    """Similarity to the account, moved by half of the spread of its similarities as far as liked posts are nearer than disliked ones."""
    return base + (like - dislike) * spread / 2


def with_spread(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``queries`` with ``spread``: the largest less the smallest similarity of each to an item of another owner."""

    def ends(s, q, i):
        ok = np.isfinite(s)
        return pd.DataFrame({"query": q, "low": np.where(ok, s, np.inf).min(1), "high": np.where(ok, s, -np.inf).max(1)})

    found = mixed(queries.withColumn("spread", F.lit(0.0)), items, lambda base, *rest: base, ends, "query long, low double, high double")
    spread = found.where("high >= low").groupBy(F.col("query").alias("of")).agg((F.max("high") - F.min("low")).alias("spread"))
    return queries.drop("spread").join(spread, F.col("id") == F.col("of"), "left").drop("of")


def swapped(recs: DataFrame, items: DataFrame, share: float = 0.1, seed: int = 7) -> DataFrame:
    """query, item, swapped: of each query's recommendations the ``share`` (rounded down), by a hash, is replaced by items picked by a hash from all ``items`` (item)."""
    own = Window.partitionBy("query")
    placed = recs.select("query", "item").withColumn("n", F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), "query", "item"), "item"))).withColumn("all", F.count("*").over(own))
    gone = placed.withColumn("swapped", F.col("n") <= F.floor(F.col("all") * share))
    most = 1 + int(share * (recs.groupBy("query").count().agg(F.max("count")).first()[0] or 0))
    asked = recs.select("query").distinct()
    drawn = simjoin.random_per_query(asked, items, "query", "item", 2 * most, seed).withColumnRenamed("item", "new").join(recs.select("query", F.col("item").alias("new")), ["query", "new"], "left_anti")
    drawn = drawn.withColumn("n", F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), F.lit("new"), "query", "new"), "new")))
    both = gone.join(drawn, ["query", "n"], "left")
    use = F.col("swapped") & F.col("new").isNotNull()
    return both.select("query", F.when(use, F.col("new")).otherwise(F.col("item")).alias("item"), use.alias("swapped"))


def draw_order(seed: int, *columns: str):
    """A hash that orders rows at random, the same in every engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def refreshed(recs: DataFrame, following: DataFrame, sampled: int, followed: int, seed: int = 7) -> DataFrame:
    """user_id, post_id: ``sampled`` of each account's recommendations (user_id, post_id) at random, and the ``followed`` most liked posts of those it follows (user_id, post_id,
    num_likes), equal ones at random; each post once."""
    one = cap_per_key(recs.withColumn("draw", draw_order(seed, "user_id", "post_id")), ["user_id"], ["draw", "post_id"], sampled)
    two = cap_per_key(following.withColumn("draw", draw_order(seed, "user_id", "post_id")), ["user_id"], [F.desc("num_likes"), "draw", "post_id"], followed)
    return one.select("user_id", "post_id").union(two.select("user_id", "post_id")).distinct()


def threads(posts: DataFrame, comments: DataFrame, shown: int = 5, seed: int = 7) -> DataFrame:
    """``posts`` (post_id and more) with ``comments``: up to ``shown`` of a post's comments (post_id, comment_id, is_warning and more) as a list of structs, a warning (the earliest) first,
    the rest at random. Posts without comments have an empty list."""
    rest = [c for c in comments.columns if c not in ("post_id", "is_warning")]
    first = F.row_number().over(Window.partitionBy("post_id", "is_warning").orderBy("comment_id"))
    ranked = comments.withColumn("first", F.when(F.col("is_warning") & (first == 1), 0).otherwise(1)).withColumn("draw", draw_order(seed, "post_id", "comment_id"))
    kept = cap_per_key(ranked, ["post_id"], ["first", "draw", "comment_id"], shown)
    lists = kept.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("first", "draw", F.struct(*rest).alias("comment")))).alias("of"))
    return posts.join(lists.select("post_id", F.transform("of", lambda x: x["comment"]).alias("comments")), "post_id", "left").withColumn("comments", F.coalesce("comments", F.slice(F.array(F.struct(*[F.lit(None).cast(dict(comments.dtypes)[c]).alias(c) for c in rest])), 1, 0)))
