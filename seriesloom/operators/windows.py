"""Leakage-safe window features over entity histories.

A history is a table with partition columns and an order that is total (end it with a
unique key). "Prior" frames end before the current row, so no row sees its own value. All
are built-in windows; several over one history share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START = W.unboundedPreceding


def history(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*by).orderBy(*order)


def rolling_full(x: Column, w: WindowSpec, n: int, how=F.avg) -> Column:
    """``how`` of the n values before this row; null unless all n are there and not null."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) == n, how(x).over(frame))


def rolling_any(x: Column, w: WindowSpec, n: int, how=F.avg) -> Column:
    """``how`` of those of the n values before this row that are not null."""
    return how(x).over(w.rowsBetween(-n, -1))


def rolling_here(x: Column, w: WindowSpec, n: int, how=F.avg) -> Column:
    """``how`` of the last n values, this row's included; null unless all are there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, how(x).over(frame))


def expanding(x: Column, w: WindowSpec, how=F.avg) -> Column:
    """``how`` of all values before this row."""
    return how(x).over(w.rowsBetween(START, -1))


def filled(x: Column, w: WindowSpec) -> Column:
    """The last value up to this row that is not null."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(START, 0))


def difference_form(df: DataFrame, x: str, w: WindowSpec, n: int, name: str) -> DataFrame:
    """Rolling mean of the n steps before the last one."""
    return df.withColumn("__step", F.col(x) - F.lag(x).over(w)).withColumn(name, rolling_full(F.col("__step"), w, n)).drop("__step")


def lag_difference(x: Column, w: WindowSpec, n: int) -> Column:
    return F.lag(x, 1).over(w) - F.lag(x, n).over(w)


def streaks(df: DataFrame, flag: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds run (length of the run of true rows that ends here), streak (before this row;
    null on a first row) and streak0 (the same with 0 there). A null flag breaks a run."""
    w = history(by, order)
    df = df.withColumn("__f", F.coalesce(flag.cast("int"), F.lit(0)))
    df = df.withColumn("__b", F.sum(1 - F.col("__f")).over(w.rowsBetween(START, 0)))
    df = df.withColumn("run", F.sum("__f").over(history([*by, "__b"], order).rowsBetween(START, 0)))
    df = df.withColumn("streak", F.lag("run").over(w))
    return df.withColumn("streak0", F.coalesce("streak", F.lit(0).cast("long"))).drop("__f", "__b")


def run_summary(df: DataFrame, flag: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per entity: longest run of true and of false rows, and the signed run at its end."""
    on = streaks(df, flag, by, order).withColumnRenamed("run", "__on").drop("streak", "streak0")
    both = streaks(on, ~flag, by, order)
    last = F.max_by(F.when(F.col("__on") > 0, F.col("__on")).otherwise(-F.col("run")), F.struct(*order))
    return both.groupBy(*by).agg(F.max("__on").alias("longest_true"), F.max("run").alias("longest_false"), last.alias("tail"))


def range_count(by: Sequence[str], day: Column, days: int) -> Column:
    """Rows of the entity in the ``days`` days before this row's day."""
    return F.count("*").over(W.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-days, -1))


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean; null stays null."""
    rank = F.rank().over(W.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count("*").over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), rank + (ties - 1) / 2)


def percentile_rank(x: Column, by: Sequence[str]) -> Column:
    return average_rank(x, by) / F.count(x).over(W.partitionBy(*by))


def rank_score(x: Column, by: Sequence[str]) -> Column:
    """Average rank less one over n - 1; 1.0 for a single value."""
    n = F.count(x).over(W.partitionBy(*by))
    return F.when(n == 1, 1.0).otherwise(F.try_divide(average_rank(x, by) - 1, n - 1))


def same_share(x: Column, w: WindowSpec, n: int) -> Column:
    """Share of the n values before that equal this one; null without n rows before."""
    same = sum((F.coalesce((F.lag(x, k).over(w) == x).cast("int"), F.lit(0)) for k in range(1, n + 1)), F.lit(0))
    return F.when((F.row_number().over(w) > n) & x.isNotNull(), same / n)


def running_product(rate: Column, w: WindowSpec, start: float = 1.0) -> Column:
    """start times the product of (1 + rate) up to this row; rates above -1."""
    return start * F.exp(F.sum(F.log1p(rate)).over(w.rowsBetween(START, 0)))


def drawdowns(df: DataFrame, gain: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds equity, peak and drawdown (from the peak so far, as a share of it)."""
    frame = history(by, order).rowsBetween(START, 0)
    df = df.withColumn("equity", F.sum(gain).over(frame)).withColumn("peak", F.max("equity").over(frame))
    return df.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")))


def leader_before(df: DataFrame, entity: Sequence[str], member: str, x: str, order: Sequence[str]) -> DataFrame:
    """Each row's total of x of its member before it, and the entity's row with the most
    (the first on ties)."""
    df = df.withColumn("before", F.sum(x).over(history([*entity, member], order).rowsBetween(START, -1)))
    first = W.partitionBy(*entity).orderBy(F.desc_nulls_last("before"), *order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
