"""Training tables, boosted trees and stages that fail while they run."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from seriesloom.operators import learning, metrics, projections
from seriesloom.operators.boosting import Boosted, BoostedModel
from seriesloom.operators.training import TrainingColumns, TrainingColumnsModel, labelled, training_table

SCHEMA = "grp string, season string, day int, result string, a double, b int, `c.d` float, half double, rare double, odds double, note string"


def rows(n=60, shift=0.0):
    r = random.Random(n)
    out = []
    for i in range(n):
        out.append((
            "xyz"[i % 3], str(2020 + i % 4), i, r.choice(["H", "D", "A", None, "?"]), None if i % 5 == 0 else i + shift, None if i % 7 == 0 else i, float("nan") if i % 3 == 0 else float(i),
            None if i % 2 else 1.0 * i, None if i % 6 else 2.0, 1.5, "n",
        ))
    return out


def median(x):
    x = sorted(v for v in x if v is not None and not math.isnan(v))
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def test_training_table(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA)
    out, model = training_table(df, "result", {"H": 0, "D": 1, "A": 2}, {"grp": ["x", "y"], "season": ["2020", "2021", "2022"]}, ["day", "odds"], ["season", "day"])
    kept = sorted((g for g in given if g[0] in "xy" and g[1] != "2023" and g[3] in ("H", "D", "A")), key=lambda g: (g[1], g[2]))
    share = lambda i: sum(g[i] is None or math.isnan(g[i]) for g in kept) / len(kept)
    place = {"a": 4, "b": 5, "c.d": 6, "half": 7, "rare": 8}
    assert model.features == [c for c in sorted(place) if share(place[c]) <= 0.5] and "rare" not in model.features and "a" in model.features
    got = out.collect()
    assert [(r.season, r.day, r.target) for r in got] == [(g[1], g[2], "HDA".index(g[3])) for g in kept]
    for c in model.features:
        mid = median([g[place[c]] for g in kept])
        assert [r[c] for r in got] == [mid if g[place[c]] is None or math.isnan(g[place[c]]) else float(g[place[c]]) for g in kept]


def test_no_leak_from_rows_that_are_only_transformed(spark, tmp_path):
    train = spark.createDataFrame(rows(), SCHEMA)
    serve = spark.createDataFrame(rows(40, shift=1e6), SCHEMA)
    model = TrainingColumns(["day", "odds"]).fit(train)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = TrainingColumnsModel.load(f"{tmp_path}/m")
    assert again.features == model.features
    a, b = (sorted(map(str, m.transform(serve).collect())) for m in (model, again))
    assert a == b
    filled = again.transform(serve.drop("b")).where("a < 1000").select("a", "b").distinct().collect()
    assert [tuple(r) for r in filled] == [(median([g[4] for g in rows()]), median([g[5] for g in rows()]))]
    none = TrainingColumns().fit(train.limit(0))
    assert none.features == [] and none.transform(train).columns == train.columns


def test_labels(spark):
    df = spark.createDataFrame([("H",), (None,), ("x",), ("A",)], "r string")
    assert sorted(tuple(x) for x in labelled(df, "r", {"H": 0, "A": 2}).collect()) == [("A", 2), ("H", 0)]


def rings(spark, n=3000):
    """Three classes that no single cut tells apart, in the order of ``i``."""
    r = random.Random(5)
    out = []
    for i in range(n):
        x, y = r.uniform(-1, 1), r.uniform(-1, 1)
        k = 0 if x * y > 0.1 else 1 if x * x + y * y < 0.5 else 2
        out.append((i, x, y, float(r.randrange(3) if r.random() < 0.1 else k), i % 5 == 0))
    df = spark.createDataFrame(out, "i int, x double, y double, label double, held boolean")
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)


def test_boosted_trees_of_three_classes(spark, tmp_path):
    df = rings(spark).cache()
    train, test = df.where("i < 2400"), df.where("i >= 2400")
    loss = {}
    model = learning.create_model("boosted", validation="held", trees=40, tolerance=0.01).fit(train)
    for name, m in (("forest", learning.create_model("forest").fit(train)), ("boosted", model)):
        p = m.transform(test).select("label", vector_to_array("probability").alias("p"))
        assert p.where((F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9) | (F.size("p") != 3)).count() == 0
        loss[name] = p.agg(metrics.log_loss(projections.gathered(F.col("p"), F.col("label").cast("int")))).first()[0]
    assert loss["boosted"] < loss["forest"]
    assert all(0 < t < 40 for t in model.trees)  # stopped early
    model.save(f"{tmp_path}/m")
    told = lambda m: [tuple(r) for r in m.transform(test).orderBy("i").select("i", "probability", "prediction").collect()]
    assert told(BoostedModel.load(f"{tmp_path}/m")) == told(model)
    calibrated = learning.Platt().fit(learning.predict_proba(model, train.where("held").drop("features").join(train.select("i", "features"), "i")), "p", "label")
    assert calibrated.transform(F.col("p")) is not None


def test_equal_rows_are_grown_on_as_one(spark, monkeypatch):
    """Trees of rows and of their copies are those of the rows themselves, but each different row is read once."""
    from pyspark.ml.classification import GBTClassifier

    df = rings(spark, 300)
    many = df.where("label < 2").withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("x") > 0, 9).otherwise(3)))).drop("n").cache()
    plain = GBTClassifier(maxIter=3, maxDepth=4, stepSize=0.2, seed=7, validationIndicatorCol="held", validationTol=1e-4).fit(many)
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    model = Boosted(trees=3, validation="held").fit(many)
    assert seen == [many.select("features", "label", "held").distinct().count()] and seen[0] < many.count() / 3
    told = lambda m: [r.probability[1] for r in m.transform(df).orderBy("i").select("probability").collect()]
    assert max(abs(a - b) for a, b in zip(told(model), told(plain), strict=True)) < 1e-9


def test_two_one_and_no_classes(spark):
    df = rings(spark, 300)
    two = Boosted(trees=3).fit(df.where("label < 2"))
    assert two.trees[0] == 0 and two.transform(df).select(vector_to_array("probability").alias("p")).where("abs(p[0] + p[1] - 1) > 1e-9").count() == 0
    one = Boosted(trees=3).fit(df.where("label = 1"))
    assert {tuple(r.probability) for r in one.transform(df).select("probability").collect()} == {(0.0, 1.0)}
    with pytest.raises(ValueError):
        Boosted().fit(df.limit(0))


def test_a_stage_that_fails_in_a_task_leaves_the_last_good_frame(spark):
    df = spark.range(100)
    broken = lambda d: d.withColumn("y", F.when(F.col("id") == 57, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")))
    stages = [("x", lambda d: d.withColumn("x", F.col("id") + 1)), ("y", broken), ("z", lambda d: d.withColumn("z", F.col("x") * 2)), ("no", lambda d: d.select("absent"))]
    out, failed = projections.run_stages(df, stages, run=True)
    assert out.columns == ["id", "x", "z"] and out.agg(F.sum("z")).first()[0] == 10_100
    assert sorted(failed) == ["no", "y"]
