"""Joins, reshapes and table updates that analytics on histories need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def two_sided_log(df: DataFrame, keys: Sequence[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """Two rows of one shape for each row: ``home`` and ``away`` map shared names to columns."""
    side = lambda name, cols: F.struct(F.lit(name).alias("side"), *[F.col(c).alias(n) for n, c in cols.items()])
    return df.select(*keys, F.explode(F.array(side("home", home), side("away", {n: away[n] for n in home}))).alias("s")).select(*keys, "s.*")


def sides(log: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """A row per key of a two-sided log, with home_* and away_* of the named columns, by one aggregation."""
    return log.groupBy(key).agg(*[F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{s}_{n}") for s in ("home", "away") for n in names])


def side_join(df: DataFrame, log: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Log columns back beside each row as home_* and away_*."""
    return df.join(sides(log, key, names), key, "left")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """Each left row with the right row of the latest time before its own (or at it, if not
    strict). Union and window: one shuffle by key, no range join. Left columns win on a clash;
    right times must be unique inside a key."""
    a = left.select(*by, F.col(at).alias("__t"), F.lit(0 if strict else 1).alias("__s"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"), F.lit(None).alias("__r"))
    b = right.select(*by, F.col(right_at).alias("__t"), F.lit(1 if strict else 0).alias("__s"), F.lit(None).alias("__l"), F.struct(*[F.col(f"`{c}`") for c in values]).alias("__r"))
    frame = W.partitionBy(*by).orderBy("__t", "__s").rowsBetween(W.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn("__m", F.last("__r", ignorenulls=True).over(frame)).where("__l is not null")
    return u.select("__l.*", *[F.col(f"__m.`{c}`").alias(c) for c in values if c not in left.columns])


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_day: str, right_day: str, within: int, left_key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left rows with the right row of the nearest day no more than ``within`` days away.

    Days become equi-join keys (each right row is entered under each day it may serve), so
    a key with a long history is no range join. Ties go by ``order``."""
    served = F.explode(F.sequence(F.lit(-within), F.lit(within)))
    r = right.withColumn("__o", served).withColumn("__d", F.date_add(F.to_date(right_day), F.col("__o")))
    hit = left.withColumn("__d", F.to_date(left_day)).join(r, [*by, "__d"])
    best = W.partitionBy(*left_key).orderBy(F.abs("__o"), *order)
    hit = hit.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    more = [c for c in right.columns if c not in left.columns]
    return left.join(hit.select(*left_key, *more), list(left_key), "left")


def probed_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_day: str, right_day: str, within: int, left_key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left rows with the right row of their own day, else of the day before, the day after, two days before, and so on; of right
    rows that share key and day the last by ``order``."""
    last = W.partitionBy(*by, F.to_date(right_day)).orderBy(*[F.desc(c) for c in order])
    one = right.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    # a right row is entered under its day plus an offset: above 0 it lies before the left row
    return nearest_join(left, one, by, left_day, right_day, within, left_key, [F.desc("__o")])


def joined_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which null keys equal each other; without keys, with the one row of ``right``."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    r = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(r, same, "left").drop(*[f"__on_{c}" for c in on])


def best_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Inner join on ``on`` with the first right row of each by ``order``, whose columns are the
    right side's: that side is reduced before the join, so nothing multiplies."""
    first = W.partitionBy(*on).orderBy(*order)
    one = right.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return left.join(one, list(on))


def overwrite_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which right columns replace left ones of the same name."""
    return left.drop(*[c for c in right.columns if c not in on]).join(right, list(on), "left")


def last_of_each(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the last row by ``order``, or by all columns where none is given."""
    by = [F.desc(c) for c in (order or [c for c in df.columns if c not in key])]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*(by or [F.lit(0)])))).where("__n = 1").drop("__n")


def latest(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row of both that is last by ``order``, and of equal ones the new one. Without
    an order new rows win. One order over both: a late batch of older rows changes nothing."""
    first = [F.desc(c) for c in order]
    rest = [F.desc(c) for c in new.columns if c not in key and c not in order]
    both = old.withColumn("__part", F.lit(0)).unionByName(new.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(*first, F.desc("__part"), *rest)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__part")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], mode: str = "replace", order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` over rows of ``old``. replace: a new row counts as a whole, columns it
    lacks become null; merge: columns that ``new`` lacks keep their old values. Of new rows that repeat a
    key the last by ``order`` counts (by all columns where none is given)."""
    new = last_of_each(new, key, order)
    if mode == "replace":
        return old.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)
    n = new.select(*key, F.struct(*[c for c in new.columns if c not in key]).alias("__n"))
    both = old.join(n, list(key), "full")
    here = F.col("__n").isNotNull()
    return both.select(*[F.col(c) if c in key or c not in new.columns else F.when(here, F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def keep_last(parts: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All parts under each other, of each key only the row of the last part (and order)."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    last = W.partitionBy(*key).orderBy(F.desc("__part"), *[F.desc(c) for c in order])
    return every.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__part")


def calendar(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Every day from start to end, with the rows of df left-joined."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias(day))
    return days.join(df, day, "left")


def repaired_keys(left: DataFrame, right: DataFrame, by: Sequence[str], day: str, key: str) -> DataFrame:
    """Left rows with column ``repaired``: the key of the right row of the same entity on the
    same day, else a day off, else of the entity's only right row, else the left key."""
    only = right.groupBy(*by).agg(F.count("*").alias("__c"), F.min(key).alias("__only"))
    near = nearest_join(left, right.select(*by, F.col(day).alias("__rd"), F.col(key).alias("__rk")), by, day, "__rd", 1, [key], ["__rd", "__rk"])
    out = near.join(only, list(by), "left")
    return out.withColumn("repaired", F.coalesce("__rk", F.when(F.col("__c") == 1, F.col("__only")), F.col(key))).drop("__rd", "__rk", "__c", "__only")
