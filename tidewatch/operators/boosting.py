"""Boosting by re-weighted rows (AdaBoost): small trees, each fitted where the ones before were wrong."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scorers import model
from tidewatch.operators.trees import Tree, trees_of
from tidewatch.runtime import materialize

#: Rounds after which the weighted rows are written, which cuts the lineage.
ROUNDS_A_TABLE = 5


class AdaBoostModel(Model, HasFeaturesCol):
    """Weighted vote of the trees; ``alphas`` are their weights. The margin is the mean vote, between -1 and 1."""

    def __init__(self, trees: list[Tree], alphas: list[float], features: str = "features") -> None:
        super().__init__()
        self.trees, self.alphas = trees, alphas
        self._set(featuresCol=features)

    @property
    def trees_and_weights(self) -> tuple[list[Tree], list[float]]:
        """Trees that vote -1 or 1, and weights that make their sum the margin."""
        total = sum(self.alphas) or 1.0
        return self.trees, [a / total for a in self.alphas]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, weights = self.trees_and_weights

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                m = np.array(x.tolist(), float).reshape(len(x), -1)
                yield pd.Series(sum((w * t.values(m) for t, w in zip(trees, weights)), np.zeros(len(m))))

        rows = dataset.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol())))
        p = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        return rows.withColumn("probability", array_to_vector(F.array(1.0 - p, p))).withColumn("prediction", (F.col("_margin") > 0).cast("double")).drop("_margin")


class AdaBoost(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasSeed):
    """Discrete AdaBoost of two classes over library trees.

    Every round fits a tree to the weighted rows; with the weighted error e of its votes the tree's weight is
    ``stepSize * ln((1 - e) / e)``, and the weights of the rows it has wrong grow by the exponential of that. A round without
    an error ends the boosting with that tree, one that is no better than chance ends it before. Trees that
    the rounds have made are a few numbers; rows and weights stay in tables.
    """

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the trees", typeConverter=TypeConverters.toInt)

    def __init__(self, *, maxIter: int = 50, stepSize: float = 1.0, maxDepth: int = 1, seed: int = 42, labelCol: str = "label", featuresCol: str = "features") -> None:
        super().__init__()
        self._set(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=seed, labelCol=labelCol, featuresCol=featuresCol)

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        spark, features, label = dataset.sparkSession, self.getFeaturesCol(), self.getLabelCol()
        rows = materialize(dataset.select(features, F.col(label).cast("double").alias("y")).withColumn("w", F.lit(1.0)), "boosting")
        learner = DecisionTreeClassifier(maxDepth=self.getOrDefault(self.maxDepth), seed=self.getSeed(), labelCol="y", featuresCol=features, weightCol="w")
        trees, alphas = [], []
        for number in range(1, self.getMaxIter() + 1):
            fitted = learner.fit(rows)
            judged = fitted.transform(rows).select(features, "y", "w", (F.col("prediction") != F.col("y")).alias("_wrong"))
            wrong, total = judged.agg(F.sum(F.when(F.col("_wrong"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
            error = (wrong or 0.0) / total if total else 0.5
            if error >= 0.5:
                break
            tree = trees_of(fitted, spark)[0][0]
            tree.value = np.where(tree.value > 0.5, 1.0, -1.0)
            trees.append(tree)
            if error <= 0.0:
                alphas.append(1.0)
                break
            alphas.append(self.getStepSize() * math.log((1.0 - error) / error))
            # weights relative to their sum, so that they neither overflow nor vanish
            rows = judged.withColumn("w", F.col("w") * F.when(F.col("_wrong"), math.exp(alphas[-1])).otherwise(1.0) / F.lit(float(total))).drop("_wrong")
            if number % ROUNDS_A_TABLE == 0:
                rows = materialize(rows, "boosting")
        return AdaBoostModel(trees, alphas, features)


@model("ada_boost")
def ada_boost(rounds: int = 50, rate: float = 1.0, depth: int = 1, seed: int = 42) -> Estimator:
    return AdaBoost(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)
