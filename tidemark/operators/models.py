"""Fitted pipelines that travel: fitted on training rows alone, saved, loaded in another session, scored elsewhere."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluation
from tidemark.operators.learning import class_weights
#: Names of the columns that the stages make between one another.
WORK = "detector_"


def detector(columns: list[str], label: str, components: int | None = None, iterations: int = 20, depth: int = 5, step: float = 0.05, seed: int = 7) -> Pipeline:
    """Scales ``columns``, reduces the vector of the text column (if ``components`` is given) to so many principal components of centred data, and boosts trees
    on both, with four fifths of the rows and features for each tree. Training rows need a weight (see ``fit``)."""
    stages = [VectorAssembler(inputCols=columns, outputCol=WORK + "plain", handleInvalid="keep"), StandardScaler(withMean=True, withStd=True, inputCol=WORK + "plain", outputCol=WORK + "scaled")]
    parts = [WORK + "scaled"]
    if components:
        stages += [StandardScaler(withMean=True, withStd=False, inputCol=WORK + "text", outputCol=WORK + "centred"), PCA(k=components, inputCol=WORK + "centred", outputCol=WORK + "reduced")]
        parts.append(WORK + "reduced")
    stages.append(VectorAssembler(inputCols=parts, outputCol=WORK + "features", handleInvalid="keep"))
    trees = GBTClassifier(labelCol=label, featuresCol=WORK + "features", predictionCol=WORK + "prediction", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    stages.append(trees.setProbabilityCol(WORK + "probability").setRawPredictionCol(WORK + "raw"))
    return Pipeline(stages=stages)


def prepared(df: DataFrame, text: str | None) -> DataFrame:
    """``df`` with its array column ``text`` as a vector too."""
    return df.withColumn(WORK + "text", array_to_vector(F.col(text).cast("array<double>"))) if text else df


def fit(train: DataFrame, columns: list[str], label: str, text: str | None = None, components: int = 8, **settings) -> PipelineModel:
    """A detector from ``train`` alone: means, components and trees know no other row. Rows whose label or features are null are left out; label 1 weighs as much
    as label 0 in sum. A table with one class only is refused."""
    rows = train.where(F.col(label).isNotNull()).dropna(subset=[*columns, *([text] if text else [])])
    classes = rows.select(label).distinct().limit(3).collect()
    if len(classes) != 2:
        raise ValueError(f"a detector needs rows of two classes, not of {len(classes)}")
    ready = class_weights(prepared(rows, text), label)
    return detector(columns, label, components if text else None, **settings).fit(ready)


def score(model: PipelineModel, df: DataFrame, text: str | None = None) -> DataFrame:
    """The rows of ``df`` with ``p``, the score between 0 and 1."""
    scored = model.transform(prepared(df, text))
    return scored.select(*[F.col(c) for c in df.columns if c != "p"], vector_to_array(WORK + "probability")[1].alias("p"))


def save(model: PipelineModel, path: str) -> None:
    """Writes all stages, fitted values included, under ``path``, which any Spark store can be."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def metric_row(model: PipelineModel, independent: DataFrame, label: str, text: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row of classification measures of a loaded or fitted ``model`` on a table that it hasn't seen."""
    return evaluation.confusion(score(model, independent, text).select("p", F.col(label).alias("y")), threshold)
