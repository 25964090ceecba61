"""Operators with sequential state, folds and samples."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialised
from .learning import ranked
from .relations import joined_null_safe


#: Matches that one task replays after the other.
BLOCK = 2048
PLACES = ("position", "points", "gd", "played", "to_fourth", "to_fourth_last")


def standings(df: DataFrame, season: str, order: Sequence[str]) -> DataFrame:
    """(id, n_teams, home_* and away_*: position, points, gd, played, to_fourth, to_fourth_last)
    before each match of (id, season, home, away, home_score, away_score).

    Teams seen so far, the match's own included, rank by points, goal difference, goals, then the
    order in which they first played (home before away). Gaps are to the points of the fourth, and
    of the fourth from the end; 0 with fewer than four teams. Null scores count for nothing.

    Matches are numbered in their order and cut into blocks of ``BLOCK``. A block begins with the totals of every team of its
    season so far, which are running sums of sums by block and team, and is then replayed on a sorted index of the teams, in which
    a match moves two entries and finds their places by bisection. Blocks don't wait for each other; a task holds one block
    and a season's teams, and there is a row for each team and block, not for each team and match."""
    match = df.select("id", F.col(season).alias("s"), F.struct(*order).alias("t"), "home", "away", F.col("home_score").cast("double").alias("hs"), F.col("away_score").cast("double").alias("gs"))
    # the range sort reads its rows twice
    match = ranked(materialised(match), ["s", "t"]).select("id", "s", (F.col("__i") / BLOCK).cast("long").alias("b"), F.col("__i").alias("i"), "home", "away", "hs", "gs")
    side = lambda team, gf, ga, n: F.struct(F.col(team).alias("team"), F.col(gf).alias("gf"), F.col(ga).alias("ga"), (2 * F.col("i") + n).alias("first"))
    log = match.select("s", "b", F.explode(F.array(side("home", "hs", "gs", 0), side("away", "gs", "hs", 1))).alias("x")).select("s", "b", "x.*")
    counts = F.col("gf").isNotNull() & F.col("ga").isNotNull()
    total = lambda x: F.sum(F.when(counts, x).otherwise(0)).cast("double")
    won = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    sums = log.groupBy("s", "b", "team").agg(total(won).alias("p"), total(F.col("gf") - F.col("ga")).alias("d"), total(F.col("gf")).alias("g"), total(F.lit(1)).alias("c"), F.min("first").alias("first"))
    by_team = W.partitionBy("s", "team").orderBy("b")
    sums = sums.select("s", "b", "team", *[F.sum(c).over(by_team).alias(c) for c in "pdgc"], F.min("first").over(by_team).alias("first"), F.lead("b").over(by_team).alias("next"))
    ends = match.groupBy("s").agg(F.max("b").alias("end"))
    sums = joined_null_safe(sums, ends, ["s"]).withColumn("next", F.coalesce("next", "end")).where("next > b")
    starts = sums.select("s", F.explode(F.sequence(F.col("b") + 1, F.col("next"))).alias("b"), "team", *"pdgc", "first")
    names = [f"{who}_{c}" for who in ("home", "away") for c in PLACES]

    def replay(matches: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        keys: dict = {t: (-p, -d, -g, first, c) for t, p, d, g, c, first in before[["team", "p", "d", "g", "c", "first"]].itertuples(index=False)}
        table = sorted(keys.values())
        out = []
        for i, home, away, hs, gs in matches.sort_values("i")[["i", "home", "away", "hs", "gs"]].itertuples(index=False):
            for n, team in enumerate((home, away)):
                if team not in keys:
                    keys[team] = (0.0, 0.0, 0.0, 2 * i + n, 0.0)
                    insort(table, keys[team])
            row: list = [len(table)]
            for team in (home, away):
                own = keys[team]
                gaps = (table[3][0] - own[0], table[-4][0] - own[0]) if len(table) >= 4 else (0.0, 0.0)
                row += [bisect_left(table, own) + 1.0, -own[0], -own[1], own[4], *gaps]
            out.append(row)
            if hs == hs and gs == gs:  # neither is missing
                for team, gf, ga in ((home, hs, gs), (away, gs, hs)):
                    p, d, g, first, c = keys[team]
                    del table[bisect_left(table, keys[team])]
                    keys[team] = (p - (3 if gf > ga else 1 if gf == ga else 0), d - (gf - ga), g - gf, first, c + 1)
                    insort(table, keys[team])
        told = pd.DataFrame(out, columns=["n_teams", *names])
        told.insert(0, "id", matches.sort_values("i")["id"].to_numpy())
        return told

    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_teams long, " + ", ".join(f"{n} double" for n in names)
    starts = starts.withColumnsRenamed({"s": "of_season", "b": "of_block"})
    return match.groupBy("s", "b").cogroup(starts.groupBy("of_season", "of_block")).applyInPandas(replay, schema)


def team_caps(df: DataFrame, batch: Sequence[str], order: Sequence[str], home: str, away: str, stake: str, cap: float) -> DataFrame:
    """df with ``capped``: in order, each row takes what is left of both teams' caps in its batch.

    What is left depends on every earlier row of the batch, which windows can't express. Rows stream through
    sorted partitions; only the batch's caps are held, however many rows it has."""
    schema = df.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    begins = F.row_number().over(W.partitionBy(*batch).orderBy(*order)) == 1
    rows = df.withColumn("__begins", begins).sortWithinPartitions(*batch, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict = {}
        for rows in batches:
            out = []
            for begins, h, a, x in zip(rows["__begins"], rows[home], rows[away], rows[stake], strict=True):
                if begins:
                    used = {}
                x = max(0.0, min(x, cap - used.get(h, 0.0), cap - used.get(a, 0.0)))
                for t in {h, a}:
                    used[t] = used.get(t, 0.0) + x
                out.append(x)
            yield rows.drop(columns="__begins").assign(capped=out)

    return rows.mapInPandas(run, f"{schema}, capped double")


def walk_forward(df: DataFrame, season: str, order: Sequence[str], train: int, share: float = 0.8) -> DataFrame:
    """Rows of every fold: ``train`` seasons and the next as test; the last part of the
    training rows is for calibration. The fold table has a row per season, so its rank
    needs no key. The place of a row is known from counts by the first order column; only
    the rows that share the value where the cut falls are numbered."""
    seasons = df.select(season).distinct().withColumn("__r", F.dense_rank().over(W.orderBy(season)))
    folds = seasons.where(F.col("__r") > train).select(F.col("__r").alias("fold"))
    near = F.sequence(F.col("fold") - train, F.col("fold"))
    folds = seasons.join(folds.select("fold", F.explode(near).alias("__r")), "__r").withColumn("__test", F.col("__r") == F.col("fold")).drop("__r")
    folds = materialised(folds)  # a row for each season and fold, used at each step
    first = order[0]
    counts = df.groupBy(season, first).agg(F.count("*").alias("__c")).join(F.broadcast(folds), season).where("not __test")
    counts = counts.groupBy("fold", first).agg(F.sum("__c").alias("__c"))
    by = W.partitionBy("fold")
    counts = counts.withColumn("__upto", F.sum("__c").over(by.orderBy(first))).withColumn("__bar", F.sum("__c").over(by) * share)
    kind = F.when(F.col("__upto") <= F.col("__bar"), "train").when(F.col("__upto") - F.col("__c") >= F.col("__bar"), "calibration")
    rows = df.join(F.broadcast(folds), season)
    test = rows.where("__test").withColumn("part", F.lit("test")).drop("__test")
    told = rows.where("not __test").drop("__test").join(counts.select("fold", first, kind.alias("part"), "__upto", "__c", "__bar"), ["fold", first])
    i = F.col("__upto") - F.col("__c") + F.row_number().over(W.partitionBy("fold", first).orderBy(*order))
    cut = told.where("part is null").withColumn("part", F.when(i > F.col("__bar"), "calibration").otherwise("train"))
    return test.unionByName(told.where("part is not null").unionByName(cut).drop("__upto", "__c", "__bar")).select(*df.columns, "fold", "part")


def stratified(df: DataFrame, y: str, key: str, share: float, seed: int) -> DataFrame:
    """ceil(share * n) rows of each class, those of the smallest seeded hashes of the key.

    Hashes are counted by their first 16 bits; only rows in the class's last bucket are numbered."""
    h: Column = F.xxhash64(F.lit(seed), key)
    df = df.withColumn("__h", h).withColumn("__b", F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 48))
    counts = df.groupBy(y, "__b").agg(F.count("*").alias("__c"))
    by = W.partitionBy(y)
    counts = counts.withColumn("__upto", F.sum("__c").over(by.orderBy("__b"))).withColumn("__want", F.ceil(F.sum("__c").over(by) * share))
    counts = counts.where(F.col("__upto") - F.col("__c") < F.col("__want"))
    told = df.alias("d").join(F.broadcast(counts).alias("c"), F.col(f"d.{y}").eqNullSafe(F.col(f"c.{y}")) & (F.col("d.__b") == F.col("c.__b"))).select("d.*", "__c", "__upto", "__want")
    last = told.where("__upto > __want").withColumn("__i", F.row_number().over(W.partitionBy(y).orderBy("__h", key)))
    last = last.where(F.col("__i") <= F.col("__want") - F.col("__upto") + F.col("__c")).drop("__i")
    return told.where("__upto <= __want").unionByName(last).drop("__h", "__b", "__c", "__upto", "__want")
