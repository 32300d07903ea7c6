"""Queries over scaling, projection, classification and drift."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import learning as ml
from tidemark.operators import models
from tidemark.plans.registry import query
from tidemark.plans.shared import shared_dir, table
from tidemark.sources import social


def accounts(spark, d):
    """user_id, is_bad and numeric features of accounts that act."""
    t = social.trace(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.count_if(F.col("action") == "click").alias("clicks"))
    u = social.users(spark, d).select("user_id", "is_bad", "balance")
    return u.join(t, "user_id").select("user_id", "is_bad", "balance", F.col("n").cast("double").alias("n"), "v", F.col("clicks").cast("double").alias("clicks"))


COLUMNS = ["balance", "n", "v", "clicks"]


@query("standardize", "SELECT user_id, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS balance FROM users")
def standardize(spark, d):
    return ml.standardize(social.users(spark, d).select("user_id", "balance"), ["balance"])


@query("pca_variance")
def pca_variance(spark, d):
    projected, shares = ml.pca(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    return projected.select("vec_id", F.posexplode("projected").alias("component", "value")).withColumn("share", F.element_at(F.array(*map(F.lit, shares)), F.col("component") + 1))


@query("bot_classifier")
def bot_classifier(spark, d):
    data = ml.vectors(accounts(spark, d), COLUMNS)
    return ml.scored(ml.boosted(data, "is_bad"), data, "user_id")


@query("oof_scores")
def oof_scores(spark, d):
    return ml.out_of_fold(ml.vectors(accounts(spark, d), COLUMNS), "user_id", "is_bad", fit=lambda rows, label: ml.boosted(rows, label, 5))


@query("independent_score")
def independent_score(spark, d):
    """Measures, on accounts that a detector hasn't seen, of the detector as it comes back from the store."""
    path = f"{shared_dir(spark)}/detector-{uuid.uuid4().hex}"
    rows = accounts(spark, d)
    models.save(models.fit(rows.where("user_id % 2 = 0"), COLUMNS, "is_bad", iterations=5), path)
    return models.metric_row(models.load(path), rows.where("user_id % 2 = 1"), "is_bad")


@query("contributions")
def contributions(spark, d):
    return ml.contributions(accounts(spark, d), "user_id", "is_bad", COLUMNS)


@query("kmeans")
def kmeans(spark, d):
    return ml.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


@query("roles")
def roles(spark, d):
    small = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 6).alias("v"))
    return ml.mixture(small, "vec_id", "v")


CORAL = "SELECT sum(m) + sum(c) / 16.0 AS distance FROM (SELECT (avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus <> 'F')) ^ 2 + (avg(l_tax) FILTER (l_linestatus = 'F') - avg(l_tax) FILTER (l_linestatus <> 'F')) ^ 2 AS m, (var_samp(l_quantity) FILTER (l_linestatus = 'F') - var_samp(l_quantity) FILTER (l_linestatus <> 'F')) ^ 2 + (var_samp(l_tax) FILTER (l_linestatus = 'F') - var_samp(l_tax) FILTER (l_linestatus <> 'F')) ^ 2 + 2 * (covar_samp(l_quantity, l_tax) FILTER (l_linestatus = 'F') - covar_samp(l_quantity, l_tax) FILTER (l_linestatus <> 'F')) ^ 2 AS c FROM lineitem)"


@query("coral_drift", CORAL, views=False)
def coral_drift(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("domain"), "l_quantity", "l_tax")
    return ml.coral(rows, "domain", ["l_quantity", "l_tax"])


PER_CLASS = CORAL.replace("SELECT sum(m)", "SELECT l_returnflag, sum(m)", 1).replace("FROM (SELECT (avg", "FROM (SELECT l_returnflag, (avg", 1).replace("FROM lineitem)", "FROM lineitem GROUP BY 1) GROUP BY 1 HAVING distance IS NOT NULL")


@query("coral_by_class", PER_CLASS, views=False)
def coral_by_class(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("domain"), "l_quantity", "l_tax")
    return ml.coral(rows, "domain", ["l_quantity", "l_tax"], by="l_returnflag")
