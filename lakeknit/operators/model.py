"""Trained pair scoring: an ensemble of tree models, grouped folds, and thresholds from held-out folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.linkage import FEATURES

#: Shares of the three models, and the weight of a positive pair.
BLEND = (0.45, 0.35, 0.20)
POSITIVE = 0.20
HEAVY = 1000
VECTOR = FEATURES[:35]


def split(rows: DataFrame, share: int = 80) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; all pairs of a record fall on the same side."""
    part = F.pmod(F.xxhash64("s1_id", F.lit(42)), F.lit(100))
    return rows.filter(part < share), rows.filter(part >= share)


@dataclass
class Ensemble:
    """Three fitted pipelines; a pair's probability is their blend."""

    models: list[PipelineModel]

    @staticmethod
    def fit(rows: DataFrame, rounds: int = 20, depth: int = 5) -> Ensemble:
        """Learn from labelled pair features; a positive pair weighs POSITIVE, as precision counts more.

        A row with a number ``n`` stands for so many; the trees draw rows, so it is dealt to one row for each HEAVY of them.
        """
        from pyspark.ml import Pipeline

        one = F.when(F.col("label") == 1, POSITIVE).otherwise(1.0)
        if "n" in rows.columns:
            parts = F.ceil(F.col("n") / HEAVY)
            rows, one = rows.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), parts))), one * F.col("n") / parts
        weighted = rows.withColumn("weight", one)
        vector = VectorAssembler(inputCols=list(VECTOR), outputCol="vector", handleInvalid="keep")
        common = {"featuresCol": "vector", "labelCol": "label", "weightCol": "weight", "seed": 42}
        trees = [
            GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, **common),
            GBTClassifier(maxIter=rounds, maxDepth=max(2, depth - 1), stepSize=0.1, **common),
            RandomForestClassifier(numTrees=2 * rounds, maxDepth=depth, **common),
        ]
        return Ensemble([Pipeline(stages=[vector, t]).fit(weighted) for t in trees])

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prob``; one pass, column arithmetic on the models' probabilities."""
        out = rows
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"p{i}", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")
        return out.withColumn("prob", F.round(sum(b * F.col(f"p{i}") for i, b in enumerate(BLEND)), 6)).drop("p0", "p1", "p2")

    def save(self, folder: str) -> None:
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{folder}/{i}")

    @staticmethod
    def load(folder: str) -> Ensemble:
        return Ensemble([PipelineModel.load(f"{folder}/{i}") for i in range(3)])
