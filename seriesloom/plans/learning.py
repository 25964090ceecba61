"""Queries of folds, models and calibration. SQL can say the folds; models are tested by what they reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, metrics, projections
from ..session import materialised
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () // 4 AS size FROM orders)
  SELECT f.fold, CASE WHEN i // size = f.fold THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(o_orderkey) AS keys FROM r JOIN (SELECT unnest([1, 2, 3]) AS fold) f ON i // size <= f.fold GROUP BY ALL""")
def expanding_folds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return learning.expanding_folds(o, ["o_orderdate", "o_orderkey"], 3).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _scored(spark, sf):
    """Three class probabilities that are too sure of themselves, with the class, in a total order."""
    o = table(spark, sf, "orders")
    x, u = F.col("o_totalprice") / 500000, F.pmod(F.xxhash64("o_orderkey"), F.lit(10_000)) / 10_000
    p = F.array(x * 0.8 + 0.05, (1 - x) * 0.5 + 0.05, (1 - x) * 0.3 + x * 0.2 - 0.1 + 0.05)
    y = F.when(u < p[0], 0).when(u < p[0] + p[1], 1).otherwise(2)
    sure = learning.renormalised(F.transform(p, lambda v: F.pow(F.greatest(v, F.lit(0.01)), F.lit(2.5))))
    return o.select("o_orderkey", "o_orderdate", y.alias("y"), sure.alias("p"))


@query()
def calibration_methods(spark, sf):
    """Calibration error of each method on the last fifth of the rows, fitted on those before."""
    rows = learning.ranked(_scored(spark, sf), ["o_orderdate", "o_orderkey"])
    bar = rows.count() * 0.8
    train, test = rows.where(F.col("__i") < bar), rows.where(F.col("__i") >= bar)
    out = None
    for name, method in learning.METHODS.items():
        fitted = method().fit(train, "p", "y")
        told = metrics.classwise_ece(test.select(fitted.transform(F.col("p")).alias("p"), "y"), "p", "y").select(F.lit(name).alias("method"), "ece")
        out = told if out is None else out.unionByName(told)
    return out


@query()
def selected_calibration(spark, sf):
    """The method that does best over expanding folds."""
    best, means = learning.select_calibration(_scored(spark, sf), "p", "y", ["o_orderdate", "o_orderkey"], ("none", "platt", "temperature"))
    return spark.createDataFrame([(n, m, n == best) for n, m in sorted(means.items())], "method string, ece double, chosen boolean")


def _features(spark, sf):
    """Lines of two kinds that quantity and discount tell apart, with some noise; written once, as models read their rows many times."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"), F.count("*").alias("d"))
    noise = F.pmod(F.xxhash64("l_orderkey"), F.lit(1000)) / 1000 - 0.5
    return materialised(li.withColumn("label", (F.col("a") / 50 + F.col("b") * 4 + noise * 0.2 > 0.7).cast("int")))


@query()
def stacked_models(spark, sf):
    """Accuracy and log loss of stacked models on the last orders."""
    df = _features(spark, sf)
    bar = df.agg(F.percentile_approx("l_orderkey", F.lit(0.8))).first()[0]
    model = learning.Stacking(["logistic", "tree"], ["a", "b", "c"]).fit(df.where(F.col("l_orderkey") < bar), ["l_orderkey"])
    told = model.predict_proba(df.where(F.col("l_orderkey") >= bar))
    hit = (F.col("p")[1] > 0.5).cast("int") == F.col("label")
    return told.agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), metrics.log_loss(projections.gathered(F.col("p"), F.col("label"))).alias("log_loss"))


@query()
def daily_model(spark, sf):
    """A calibrated model of the day's history, with its probabilities."""
    df = _features(spark, sf)
    found = learning.train_daily(df, ["a", "b"], ["l_orderkey"], 2)
    if found is None:
        return df.select("l_orderkey", F.lit(None).cast("double").alias("p")).limit(0)
    model, calibration = found
    p = learning.predict_proba(model, df)
    return p.select("l_orderkey", calibration.transform(F.col("p"))[1].alias("p"))


@query()
def leak_signals(spark, sf):
    """A feature that copies the label stands out by importance and by correlation."""
    df = _features(spark, sf).withColumn("copy", F.col("label").cast("double"))
    names = ["a", "b", "c", "copy"]
    spikes = learning.importance_spikes(df, names, 2.0)
    corr = metrics.class_correlation(df, names, "label", [0, 1]).select("feature", F.col("correlation").alias("value"), (F.col("correlation") > 0.95).alias("flagged"))
    return projections.verdicts(spikes, corr, corr.where("false"))
