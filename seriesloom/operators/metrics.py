"""Evaluation metrics as grouped aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relations import joined_null_safe
from .selection import exact_quantiles

CLIP = 1e-15


def right_closed_bin(p: Column, n: int) -> Column:
    """Bins (k/n, (k+1)/n]; the first also holds 0."""
    return F.greatest(F.ceil(p * n) - 1, F.lit(0)).cast("int")


def left_closed_bin(p: Column, n: int) -> Column:
    """Bins [k/n, (k+1)/n); the last also holds 1."""
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


def reliability(df: DataFrame, p: Column, y: Column, by: Sequence[str] = (), n: int = 10, bins=left_closed_bin) -> DataFrame:
    """Per bin: rows, mean prediction, observed share."""
    return df.groupBy(*by, bins(p, n).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y.cast("double")).alias("observed"))


def ece(df: DataFrame, p: Column, y: Column, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Expected calibration error per group, over right-closed bins."""
    r = reliability(df, p, y, by, n, right_closed_bin)
    gap = F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed")))
    return r.groupBy(*by).agg((gap / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


#: Parts of one in the sums of ``rolling_ece``: fine enough for 1e-10 of an error, and room for 60 million rows of an entity.
UNITS = 2.0**36


def rolling_ece(p: Column, y: Column, w: WindowSpec, window: int, n: int = 10) -> Column:
    """ECE of the last ``window`` rows up to each row of an ordered window; null before there are as many.

    A bin's rows times its gap is the absolute sum of y - p over them, so each bin is one sum: that of all rows up to this one less
    that of those before the window, since a frame with two moving ends is summed anew at each row. What is summed are whole
    numbers of 1 / UNITS, whose differences are exact; a p below -1 is summed apart, and one that is NaN only counted, so that
    rows which have left the window leave no trace."""
    to, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -window)
    last = lambda how, x: F.coalesce(how(x).over(to), F.lit(0)) - F.coalesce(how(x).over(before), F.lit(0))
    at, off = right_closed_bin(p, n), y.cast("double") - p
    units = lambda b: F.when((at == b) & (p >= -1) & ~F.isnan(p), F.rint(off * UNITS).cast("long"))
    sums = [last(F.sum, units(b)) / UNITS for b in range(n)]
    sums[0] = sums[0] + last(F.sum, F.when(p < -1, off))
    total = F.when(last(F.count_if, F.isnan(off)) > 0, float("nan")).otherwise(sum(map(F.abs, sums[1:]), F.abs(sums[0])))
    return F.when(last(F.count, p) == window, total / window)


def classwise_ece(df: DataFrame, p: str, y: str, n: int = 15) -> DataFrame:
    """Mean over classes of the ECE of each class's probability in array ``p`` against ``y`` (from 0)."""
    each = df.select(F.posexplode(p).alias("k", "p"), F.col(y).alias("y"))
    return ece(each, F.col("p"), F.col("k") == F.col("y"), ["k"], n).agg(F.avg("ece").alias("ece"))


def multiclass_brier(p: Column, y: Column) -> Column:
    """Mean squared distance of probability arrays from the one-hot class."""
    return F.avg(F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == y).cast("double"), F.lit(2))), F.lit(0.0), lambda a, v: a + v))


def calibration_cube(df: DataFrame, p: str, y: str, by: Sequence[str], n: int = 10) -> DataFrame:
    """(by, ece over all classes, n rows, multiclass Brier) of each cell."""
    each = df.select(*by, F.posexplode(p).alias("k", "p"), F.col(y).alias("y"))
    cells = ece(each, F.col("p"), F.col("k") == F.col("y"), by, n).drop("n")
    return cells.join(df.groupBy(*by).agg(F.count("*").alias("n"), multiclass_brier(F.col(p), F.col(y)).alias("brier")), list(by))


def drift_report(reference: DataFrame, current: DataFrame, xs: Sequence[str], n: int = 10, eps: float = 1e-4, warn: float = 0.1, alert: float = 0.25) -> DataFrame:
    """(feature, psi, status) of many columns, in two passes over each side. A column without spread has 0 if nothing
    left its value and infinity otherwise; values outside the reference's range are dropped."""
    long = lambda df: df.select(*[F.col(x).cast("double").alias(x) for x in xs]).unpivot([], list(xs), "feature", "x").where("x is not null and not isnan(x)")
    a, b = long(reference), long(current)
    edges = F.broadcast(a.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # a row per column
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n), F.lit(n - 1)).cast("int")
    count = lambda df, name: df.join(edges, "feature").where("x >= lo and x <= hi and hi > lo").groupBy("feature", at.alias("bin")).agg(F.count("*").alias(name))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    c = grid.join(count(a, "a"), ["feature", "bin"], "left").join(count(b, "b"), ["feature", "bin"], "left").na.fill(0)
    w = W.partitionBy("feature")
    share = lambda x: F.greatest(F.coalesce(F.try_divide(F.col(x), F.sum(x).over(w)), F.lit(0.0)), F.lit(eps))
    c = c.withColumn("pa", share("a")).withColumn("pb", share("b"))
    out = c.groupBy("feature").agg(F.sum((F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))).alias("psi"))
    moved = b.join(edges, "feature").groupBy("feature").agg(F.bool_or((F.col("hi") == F.col("lo")) & (F.col("x") != F.col("lo"))).alias("moved"))
    value = F.when(F.coalesce("moved", F.lit(False)), float("inf")).otherwise(F.col("psi"))
    out = out.join(moved, "feature", "left").select("feature", value.alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") > alert, "alert").when(F.col("psi") > warn, "warning").otherwise("ok"))


def log_loss(p_actual: Column) -> Column:
    return F.avg(-F.ln(F.greatest(F.least(p_actual, F.lit(1 - CLIP)), F.lit(CLIP))))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), F.lit(2)))


def psi(reference: DataFrame, current: DataFrame, x: str, n: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over n equal bins from the reference's least to its most."""
    lo, hi = F.min(x).alias("lo"), F.max(x).alias("hi")
    edges = F.broadcast(reference.agg(lo, hi))  # one row
    at = F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * n), F.lit(n - 1)).cast("int")
    shares = lambda df, name: df.crossJoin(edges).where(f"{x} >= lo and {x} <= hi and hi > lo").groupBy(at.alias("bin")).agg(F.count("*").alias(name))
    every = reference.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    b = every.join(shares(reference, "a"), "bin", "left").join(shares(current, "b"), "bin", "left").na.fill(0)
    total = b.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda c, t: F.greatest(F.try_divide(F.col(c), F.col(t)), F.lit(eps))
    b = b.crossJoin(F.broadcast(total)).withColumn("pa", share("a", "ta")).withColumn("pb", share("b", "tb"))
    return b.agg(F.sum((F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))).alias("psi"))


def betting_summary(df: DataFrame, stake: Column, gain: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows, staked, return on stakes, hit rate, Sharpe ratio (0 where gains don't vary)."""
    sharpe = F.when(F.coalesce(F.stddev_samp(gain), F.lit(0.0)) > 0, F.avg(gain) / F.stddev_samp(gain)).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(stake).alias("staked"), F.try_divide(F.sum(gain), F.sum(stake)).alias("roi"),
        F.avg((gain > 0).cast("double")).alias("hit_rate"), sharpe.alias("sharpe"),
    )


def edge_summary(df: DataFrame, x: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, deviation, positive share and 95 % interval of finite values; the median by selection."""
    df = df.select(*by, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("__v"))
    v = F.col("__v")
    half = 1.96 * F.stddev_samp(v) / F.sqrt(F.count(v))
    told = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.avg((v > 0).cast("double")).alias("positive"), (F.avg(v) - half).alias("low"), (F.avg(v) + half).alias("high"),
    )
    medians = exact_quantiles(df, ["__v"], by).withColumnRenamed("__v", "median")
    columns = [*by, "n", "mean", "median", "sd", "positive", "low", "high"]
    return joined_null_safe(told, medians, by).select(*columns)


def class_correlation(df: DataFrame, xs: Sequence[str], y: str, classes: Sequence) -> DataFrame:
    """Largest absolute correlation of each x with a class, all in one aggregation."""
    one = df.agg(*[F.greatest(*[F.coalesce(F.abs(F.corr(F.col(x), (F.col(y) == c).cast("double"))), F.lit(0.0)) for c in classes]).alias(x) for x in xs])
    return one.unpivot([], list(xs), "feature", "correlation")
