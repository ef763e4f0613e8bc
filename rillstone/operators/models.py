"""Graders as ML pipelines: ridge, boosted trees, a three-class classifier, isotonic calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp


def ridge(train: DataFrame, features: list[str], label: str, weight: str | None = None, strength: float = 1.0) -> PipelineModel:
    extra = {"weightCol": weight} if weight else {}
    regression = LinearRegression(featuresCol="scaled", labelCol=label, regParam=strength / 100, elasticNetParam=0.0, **extra)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), regression]).fit(train)


def boosted(train: DataFrame, features: list[str], label: str, weight: str | None = None, seed: int = 42, rounds: int = 300) -> PipelineModel:
    """Boosted trees of 32 leaves at most."""
    extra = {"weightCol": weight} if weight else {}
    trees = GBTRegressor(featuresCol="raw", labelCol=label, maxIter=rounds, stepSize=0.05, maxDepth=5, minInstancesPerNode=5, subsamplingRate=0.8, seed=seed, **extra)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), trees]).fit(train)


def verdicts(train: DataFrame, features: list[str], label: str, weight: str | None = None, seed: int = 42) -> PipelineModel:
    """Hit, partial or miss per key point."""
    extra = {"weightCol": weight} if weight else {}
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(featuresCol="raw", labelCol="label_index", numTrees=40, maxDepth=6, seed=seed, **extra)
    return Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="raw"), forest]).fit(train)


def stacked(points: DataFrame, model: PipelineModel, by: str) -> DataFrame:
    """Per answer what the classifier says about its key points: shares of hits and partials, mean and
    least probability of a hit."""
    names = model.stages[0].labels
    scored = model.transform(points).withColumn("p", vector_to_array("probability"))
    p = lambda name: F.col("p")[names.index(name)] if name in names else F.lit(0.0)
    said = F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1)
    return scored.groupBy(by).agg(
        F.avg(F.when(said == "hit", 1.0).otherwise(0.0)).alias("frac_hit"), F.avg(F.when(said == "partial", 1.0).otherwise(0.0)).alias("frac_partial"),
        F.avg(p("hit")).alias("hit_mean"), F.min(p("hit")).alias("hit_min"),
    )


def isotonic(train: DataFrame, raw: str, label: str) -> tuple[list[float], list[float]]:
    """Knots of a monotone calibration with values in 1..10."""
    model = IsotonicRegression(featuresCol=raw, labelCol=label).fit(train)
    return [float(x) for x in model.boundaries.toArray()], [min(10.0, max(1.0, float(y))) for y in model.predictions.toArray()]


def clipped(predictions: DataFrame, column: str = "prediction") -> DataFrame:
    return predictions.withColumn(column, clamp(F.col(column), 1.0, 10.0))
