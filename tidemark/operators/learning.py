"""Feature scaling, projections, classifiers and drift with Spark ML and aggregates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import stored


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, over their population deviation; a constant column gives 0."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    j = df.join(F.broadcast(s), F.lit(True))
    rest = [c for c in df.columns if c not in columns]
    return j.select(*rest, *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in columns])


def vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def centred(df: DataFrame, array_column: str) -> DataFrame:
    """features: the array column less its mean, as a vector."""
    e = df.select(F.posexplode(array_column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = e.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))
    return df.join(F.broadcast(mean), F.lit(True)).withColumn("features", array_to_vector(F.zip_with(F.col(array_column).cast("array<double>"), "mean", lambda x, m: x - m))).drop("mean")


def pca(df: DataFrame, array_column: str, k: int) -> tuple[DataFrame, list[float]]:
    """Projection on the first k components of centred data, each signed so that its largest loading is positive; and the
    shares of variance."""
    data = centred(df, array_column)
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(data)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    p = model.transform(data).withColumn("projected", F.zip_with(vector_to_array("projected"), F.array(*map(F.lit, signs)), lambda x, s: x * s))
    return p.drop("features"), [float(v) for v in model.explainedVariance.toArray()]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight: negatives over positives for label 1, else 1."""
    n = df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("ratio"))
    return df.join(F.broadcast(n), F.lit(True)).withColumn("weight", F.when(F.col(label) == 1, F.col("ratio")).otherwise(1.0)).drop("ratio")


def boosted(train: DataFrame, label: str, iterations: int = 10):
    return GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=iterations, maxDepth=4, seed=7).fit(class_weights(train, label))


def logistic(train: DataFrame, label: str):
    return LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=50).fit(class_weights(train, label))


def scored(model, df: DataFrame, key: str) -> DataFrame:
    return model.transform(df).select(key, vector_to_array("probability")[1].alias("p"))


#: Up to so many rows, each is scored by a model of all others.
LEAVE_ONE_OUT = 20


def out_of_fold(df: DataFrame, key: str, label: str, k: int = 5, fit=boosted) -> DataFrame:
    """key, fold, p: each row scored by the model (``fit(rows, label)``) that hasn't seen its fold; folds deal each class out by hash order.

    There are ``k`` folds, or as many as the smaller class has rows; with LEAVE_ONE_OUT rows or fewer each row is its own fold. A fold
    whose other rows have one class gets that class. A table of one class is refused.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row a class
    if len(counts) != 2:
        raise ValueError(f"out-of-fold scores need two classes, not {len(counts)}")
    n = sum(counts.values())
    alone = n <= LEAVE_ONE_OUT
    k = n if alone else max(2, min(k, *counts.values()))
    w = Window.orderBy(F.xxhash64(key), key) if alone else Window.partitionBy(label).orderBy(F.xxhash64(key), key)  # the former: a few rows
    folded = stored(df.withColumn("fold", F.pmod(F.row_number().over(w), F.lit(k))))
    parts = None
    for f in range(k):
        rest, own = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        left = [r[0] for r in rest.select(label).distinct().collect()]
        one = scored(fit(rest, label), own, key) if len(left) == 2 else own.select(key, F.lit(float(left[0])).alias("p"))
        one = one.withColumn("fold", F.lit(f))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def contributions(df: DataFrame, key: str, label: str, columns: list[str]) -> DataFrame:
    """key, feature, contribution, error: coefficient times distance from the mean under a logistic model; they add up to the row's logit less that of the
    mean. error is the difference, in the row's score, between the model's and that made of the contributions again."""
    data = vectors(df, columns)
    model = logistic(data, label)
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    weights = [float(c) for c in model.coefficients]
    base = float(model.intercept) + sum(w * means[c] for w, c in zip(weights, columns, strict=True))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.lit(means[c])) * F.lit(w)).alias("contribution")) for w, c in zip(weights, columns, strict=True)])
    told = model.transform(data).select(key, each.alias("each"), vector_to_array("probability")[1].alias("p"))
    logit = F.aggregate("each", F.lit(base), lambda s, x: s + x.contribution)
    return told.select(key, F.explode("each").alias("x"), F.abs(F.col("p") - 1 / (1 + F.exp(-logit))).alias("error")).select(key, "x.*", "error")


def kmeans(df: DataFrame, key: str, array_column: str, k: int) -> DataFrame:
    data = df.select(key, array_to_vector(F.col(array_column).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=7).fit(data).transform(data).select(key, F.col("prediction").alias("cluster"))


def mixture(df: DataFrame, key: str, array_column: str, most: int = 8) -> DataFrame:
    """key, cluster of the Gaussian mixture of 2 to ``most`` components (fewer where rows are few) with the least Bayesian information criterion."""
    import math

    data = stored(df.select(key, F.col(array_column).cast("array<double>").alias("v"))).select(key, array_to_vector("v").alias("features"))
    n, best = data.count(), None
    dims = len(data.first()["features"])
    for k in range(2, min(most, n) + 1):
        model = GaussianMixture(k=k, seed=7, maxIter=20).fit(data)
        free = k - 1 + k * dims + k * dims * (dims + 1) / 2
        bic = free * math.log(n) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = bic, model
    return best[1].transform(data).select(key, F.col("prediction").alias("cluster"))


def coral(df: DataFrame, domain: str, columns: list[str], by: str | None = None) -> DataFrame:
    """distance: squared gaps of means, and of covariances over 4 d^2, between the rows of domain 0 and 1; with ``by``, a row for each of its values that both domains have."""
    pairs = [(a, b) for a in columns for b in columns]
    keys = [by] if by else []
    one = df.groupBy(*keys, domain).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    gap = lambda c: F.pow(F.max(F.when(F.col(domain) == 1, F.col(c))) - F.max(F.when(F.col(domain) == 0, F.col(c))), 2)
    total = sum(gap(f"m_{c}") for c in columns) + sum(gap(f"c_{a}_{b}") for a, b in pairs) / (4.0 * len(columns) ** 2)
    found = one.groupBy(*keys).agg(total.alias("distance"))
    return found.where("distance is not null") if by else found
