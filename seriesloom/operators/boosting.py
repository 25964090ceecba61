"""Boosted trees for any number of classes, on pyspark.ml's binary ones."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised


WEIGHT = "__weight"


def weighed(df: DataFrame, features: str, more: Sequence[str]) -> DataFrame:
    """A row for all that are equal in a vector of features and ``more``, with their number as WEIGHT; written, as fits read their rows many times."""
    found = df.groupBy(vector_to_array(features).alias("__f"), *more).agg(F.count("*").cast("double").alias(WEIGHT))
    vector = array_to_vector("__f").alias(features, metadata=df.schema[features].metadata)
    return materialised(found.select(vector, *more, WEIGHT))


class Boosted(Estimator):
    """One boosted model for each class against the rest, whose probabilities are normalised; two classes need one model.

    Rows that ``validation`` (a boolean column) marks stop a model early, once another tree lowers their error by less than
    ``tolerance``; without the column all ``trees`` are grown. Labels are whole numbers from 0; a class that no row has gets
    probability 0. Equal rows are grown on as one of their weight, which trees can't tell from the rows themselves."""

    def __init__(self, trees: int = 60, depth: int = 4, step: float = 0.2, validation: str | None = None, tolerance: float = 1e-4, seed: int = 7, features: str = "features", label: str = "label"):
        super().__init__()
        self.how = {"maxIter": trees, "maxDepth": depth, "stepSize": step, "seed": seed, "featuresCol": features, "validationTol": tolerance}
        self.validation, self.label = validation, label

    def copy(self, extra=None):
        return self

    def _fit(self, df: DataFrame) -> BoostedModel:
        df = weighed(df.where(F.col(self.label).isNotNull()), self.how["featuresCol"], [self.label, *([self.validation] if self.validation else [])])
        counts = {int(r.y): r.n for r in df.groupBy(F.col(self.label).cast("int").alias("y")).agg(F.sum(WEIGHT).alias("n")).collect()}
        if not counts:
            raise ValueError("no labelled rows")
        n = max(counts) + 1
        how = {**self.how, "validationIndicatorCol": self.validation} if self.validation else self.how
        models: list = []
        for k in range(n):
            if k not in counts or counts[k] == sum(counts.values()):
                models.append(float(k in counts))  # no row, or all
            elif n == 2 and k == 0:
                models.append(None)  # what the other class leaves
            else:
                one = df.withColumn("__one", (F.col(self.label) == k).cast("double"))
                models.append(GBTClassifier(labelCol="__one", weightCol=WEIGHT, **how).fit(one))
        return BoostedModel(models)


class BoostedModel(Model):
    """Adds ``probability``, a vector, and ``prediction``, the first class of the highest probability."""

    def __init__(self, models: list):
        super().__init__()
        self.models = models

    def copy(self, extra=None):
        return self

    @property
    def trees(self) -> list[int]:
        """Trees of each class's model."""
        return [m.getNumTrees if isinstance(m, GBTClassificationModel) else 0 for m in self.models]

    def _transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        out, each = df, []
        for k, m in enumerate(self.models):
            if isinstance(m, GBTClassificationModel):
                m = m.copy()
                m.setProbabilityCol(f"__p{k}").setRawPredictionCol(f"__r{k}").setPredictionCol(f"__l{k}")
                out = m.transform(out)
                each.append(vector_to_array(f"__p{k}")[1])
            else:
                each.append(None if m is None else F.lit(m))
        if each[0] is None:
            each[0] = 1 - each[1]
        total = sum(each[1:], each[0])
        p = F.array(*[F.when(total > 0, e / total).otherwise(1.0 / len(each)) for e in each])
        out = out.select(*[F.col(f"`{c}`") for c in names], p.alias("__p"))
        best = F.array_position("__p", F.array_max("__p")) - 1
        return out.withColumns({"probability": array_to_vector("__p"), "prediction": best.cast("double")}).drop("__p")

    def save(self, path: str) -> None:
        """A folder for each class's model, and one line that tells what they are."""
        told = []
        for k, m in enumerate(self.models):
            trained = isinstance(m, GBTClassificationModel)
            if trained:
                m.write().overwrite().save(f"{path}/{k}")
            told.append("model" if trained else m)
        SparkSession.active().createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/classes")

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        told = json.loads(SparkSession.active().read.text(f"{path}/classes").first()[0])
        return cls([GBTClassificationModel.load(f"{path}/{k}") if m == "model" else m for k, m in enumerate(told)])
