"""Exact quantiles of groups of any size, by selection instead of one buffer of all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialised

#: Values of one group that one buffer may hold; parts into which a pass cuts a larger group.
HELD, PARTS = 100_000, 64


def exact_quantiles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), q: float = 0.5) -> DataFrame:
    """(by..., columns...): the q-quantile of each column in each group, interpolated as ``percentile`` does.

    Groups of at most ``HELD`` values are aggregated at once. A larger one is cut at about ``PARTS`` approximate quantiles (a sketch
    of bounded size): a value that is one of them is a part of its own, so that frequent values settle at once, and between two of them lie about
    an equal share of all. Counts of the parts tell, exactly, which of them holds the wanted rank; only that one is cut again, until it holds few
    values, or the two neighbouring ranks fall into two parts. Counts are pre-aggregated, so no task meets a group's rows;
    a pass reads only these columns, and two or three passes do for any number of rows. Nulls and NaN count for nothing; a group
    without values has a null; ``by`` may hold nulls."""
    by = list(by)
    names = {c: f"__c{i}" for i, c in enumerate(columns)}
    flat = df.select(*[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(by)], F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c, n in names.items()])).alias("v"))
    group = [f"__g{i}" for i in range(len(by))]
    flat = flat.select(*group, "v.*")
    fine = F.when(~F.isnan("x"), F.col("x"))
    sizes = materialised(flat.groupBy(*group, "c").agg(F.count(fine).alias("n"), F.min(fine).alias("lo"), F.max(fine).alias("hi")))
    large = sizes.where(F.col("n") > HELD)
    if large.isEmpty():
        found = flat.groupBy(*group, "c").agg(F.percentile(fine, F.lit(q)).alias("x"))
    else:
        same = lambda d, e: _all([d[g].eqNullSafe(e[g]) for g in [*group, "c"]])
        small = flat.join(large, same(flat, large), "left_anti").groupBy(*group, "c").agg(F.percentile(fine, F.lit(q)).alias("x"))
        values = flat.where(fine.isNotNull())
        found = small.unionByName(_select(values, large, group, q))
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("c") == n, F.col("x"))).alias(n) for n in names.values()])
    return wide.select(*[F.col(g).alias(c) for g, c in zip(group, by, strict=True)], *[F.col(n).alias(c) for c, n in names.items()])


def _all(tests: list):
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _select(values: DataFrame, large: DataFrame, group: list[str], q: float) -> DataFrame:
    keys = [*group, "c"]
    same = lambda d, e: _all([d[g].eqNullSafe(e[g]) for g in keys])
    at = (F.col("n") - 1) * q
    # the ranks (from 0) between which the quantile lies; ``below`` values are less than the range
    open_ = large.withColumns({"r": F.floor(at), "s": F.ceil(at), "f": at - F.floor(at), "below": F.lit(0).cast("long"), "m": F.col("n")})
    done = None
    while True:
        settled, few, cut = _split(open_)
        done = settled if done is None else done.unionByName(settled)
        picked = few.select(*keys, "lo", "hi", "below", "r", "s", "f")
        v, p = values.alias("v"), picked.alias("p")
        inside = v.join(p, _all([F.col(f"v.{g}").eqNullSafe(F.col(f"p.{g}")) for g in keys]) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        held = inside.groupBy(*[F.col(f"p.{g}").alias(g) for g in keys]).agg(F.sort_array(F.collect_list("x")).alias("a"), *[F.first(f"p.{c}").alias(c) for c in ("below", "r", "s", "f")])
        get = lambda rank: F.get("a", (F.col(rank) - F.col("below")).cast("int"))
        done = materialised(done.unionByName(held.select(*keys, _between(get("r"), get("s")).alias("x"))))
        cut = materialised(cut)
        if cut.isEmpty():
            return done
        ranges = values.alias("v").join(cut.alias("p"), _all([F.col(f"v.{g}").eqNullSafe(F.col(f"p.{g}")) for g in keys]) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).select(*[f"v.{g}" for g in keys], "x")
        at_ = F.percentile_approx("x", F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)]), 20 * PARTS)
        cuts = materialised(ranges.groupBy(*keys).agg(at_.alias("cuts")))
        near = ranges.alias("v").join(cuts.alias("p"), _all([F.col(f"v.{g}").eqNullSafe(F.col(f"p.{g}")) for g in keys])).select(*[f"v.{g}" for g in keys], "x", "cuts")
        part = 2 * F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.array_contains("cuts", F.col("x")).cast("int")
        counts = near.groupBy(*keys, part.alias("b")).agg(F.count("*").alias("m"), F.min("x").alias("low"), F.max("x").alias("high"))
        by_part = W.partitionBy(*keys).orderBy("b")
        counts = counts.withColumn("upto", F.sum("m").over(by_part))
        counts, p = counts.alias("d"), cut.select(*keys, "n", "r", "s", "f", "below").alias("p")
        told = counts.join(p, _all([F.col(f"d.{g}").eqNullSafe(F.col(f"p.{g}")) for g in keys]))
        first = F.col("p.below") + F.col("d.upto") - F.col("d.m")
        holds = lambda rank: (F.col(rank) >= first) & (F.col(rank) < first + F.col("d.m"))
        told = told.where(holds("r") | holds("s")).groupBy(*[F.col(f"d.{g}").alias(g) for g in keys]).agg(
            *[F.first(f"p.{c}").alias(c) for c in ("n", "r", "s", "f")], F.min(first).alias("below"), F.count("*").alias("parts"),
            F.min_by("d.m", "d.b").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("high", "d.b").alias("lo_end"), F.max_by("low", "d.b").alias("hi_end"),
        )
        # ranks in two parts are the end of one and the beginning of the other
        two = told.where("parts = 2").select(*keys, _between(F.col("lo_end"), F.col("hi_end")).alias("x"))
        done = done.unionByName(two)
        open_ = told.where("parts = 1").select(*keys, "n", "m", "r", "s", "f", "below", F.col("low").alias("lo"), F.col("high").alias("hi"))


def _between(a, b):
    return F.when(a == b, a).otherwise(a * (1 - F.col("f")) + b * F.col("f"))


def _split(open_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges that hold one value, that are few enough to be held, and that are to be cut."""
    keys = [c for c in open_.columns if c == "c" or c.startswith("__g")]
    one = F.col("lo") == F.col("hi")
    return open_.where(one).select(*keys, F.col("lo").alias("x")), open_.where(~one & (F.col("m") <= HELD)), open_.where(~one & (F.col("m") > HELD))
