"""Stakes of a portfolio of bets under limits of exposure."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import kelly
from ..session import materialised
from .relations import joined_null_safe


def _scaled(df: DataFrame, by: Sequence[str], cap: float, label: str) -> DataFrame:
    """Groups whose stakes exceed the cap are scaled down to it; rows with a null in ``by[-1]`` stay."""
    totals = df.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(F.sum("stake").alias("__t")).where(F.col("__t") > cap)
    df = joined_null_safe(df, totals, by)
    over = F.col("__t").isNotNull()
    return df.withColumns({"stake": F.when(over, F.col("stake") * cap / F.col("__t")).otherwise(F.col("stake")), "bound": F.when(over, label).otherwise(F.col("bound"))}).drop("__t")


#: Open bets of a batch that one task may settle.
FEW = 100_000


def _in_order(key: Sequence[str], cap: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Settles the open teams of a batch, each after those it waits for."""

    def run(bets: pd.DataFrame) -> pd.DataFrame:
        mine: dict = defaultdict(list)
        waits, after, scale = Counter(), defaultdict(list), {}
        for team, other, f, by in bets[["team", "other", "f", "by"]].itertuples(index=False):
            bet = [f, by]
            mine[team].append(bet)
            if by != by:  # missing: the other team comes first
                waits[team] += 1
                after[other].append((team, bet))
        free = [t for t in mine if not waits[t]]
        while free:
            team = free.pop()
            total = sum(f * by for f, by in mine[team])
            scale[team] = cap / total if total > cap else 1.0
            for later, bet in after[team]:
                bet[1] = scale[team]
                waits[later] -= 1
                if not waits[later]:
                    free.append(later)
        out = pd.DataFrame({"team": pd.Series(list(scale), dtype=bets["team"].dtype), "scale": list(scale.values())})
        for i, c in enumerate(key):
            out.insert(i, c, bets[c].iloc[0])
        return out

    return run


def team_limits(df: DataFrame, batch: Sequence[str], order: Sequence[str], home: str, away: str, cap: float, label: str = "team") -> DataFrame:
    """df with ``stake`` scaled, team after team, and ``bound`` the label where a team's limit binds.

    In each batch teams come in the order of their first bet (home before away); a team whose bets' stakes sum to more than the
    cap, after what earlier teams have taken off them, scales all its bets down to it. A bet of a team with itself counts once; a null team has no limit.

    Stakes only shrink, so a team within the cap at first never binds. Of the others each depends on the earlier ones that it
    shares a bet with, and on nothing else: teams form a graph, and all that have no unsettled earlier neighbour are settled together, in waves
    of one grouped sum and one join. Parts of the graph that aren't connected, and batches, never wait for each other, and a wave reads only
    the bets of teams that are still open. A batch in which at most ``FEW`` such bets are left is settled by one task, batches side by side."""
    key = [f"__b{i}" for i in range(len(batch))]
    row = df.select(*[F.col(c).alias(k) for c, k in zip(batch, key, strict=True)], F.struct(*order).alias("t"), F.col(home).alias("h"), F.col(away).alias("a"), F.col("stake").alias("f"))
    side = lambda team, other, n: F.struct(F.col(team).alias("team"), F.col(other).alias("other"), F.lit(n).alias("n"))
    pair = F.when(F.col("h") == F.col("a"), F.array(side("h", "a", 0))).otherwise(F.array(side("h", "a", 0), side("a", "h", 1)))
    log = row.select(*key, "t", "f", F.explode(pair).alias("x")).select(*key, "t", "f", "x.*").where("team is not null")
    log = materialised(log)
    tight = materialised(log.groupBy(*key, "team").agg(F.sum("f").alias("total"), F.min(F.struct("t", "n")).alias("first")).where(F.col("total") > cap).drop("total"))
    if tight.isEmpty():
        return df
    bets = joined_null_safe(log.select(*key, "team", "other", "f"), tight, [*key, "team"]).where("first is not null")
    bets = joined_null_safe(bets, tight.select(*key, F.col("team").alias("other"), F.col("first").alias("of_other")), [*key, "other"])
    waits = F.col("of_other").isNotNull() & (F.col("of_other") < F.col("first"))
    bets = materialised(bets.select(*key, "team", F.when(waits, F.col("other")).alias("other"), "f", F.when(waits, None).otherwise(F.lit(1.0)).alias("by")))
    scales = None
    while True:
        sizes = bets.groupBy(*key).agg(F.count("*").alias("left")).where(F.col("left") > FEW)
        large = joined_null_safe(bets, sizes, key).where("left is not null").drop("left")
        small = joined_null_safe(bets, sizes, key).where("left is null").drop("left")
        kinds = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in [*key, "team"])
        done = materialised(small.groupBy(*key).applyInPandas(_in_order(key, cap), f"{kinds}, scale double"))
        scales = done if scales is None else scales.unionByName(done)
        bets = materialised(large)
        if bets.isEmpty():
            break
        now = bets.groupBy(*key, "team").agg(F.sum(F.col("f") * F.col("by")).alias("total"), F.bool_and(F.col("by").isNotNull()).alias("free")).where("free")
        now = materialised(now.select(*key, "team", F.when(F.col("total") > cap, cap / F.col("total")).otherwise(1.0).alias("scale")))
        scales = scales.unionByName(now)
        rest = joined_null_safe(bets, now.withColumnRenamed("scale", "own"), [*key, "team"]).where("own is null").drop("own")
        rest = joined_null_safe(rest, now.select(*key, F.col("team").alias("other"), "scale"), [*key, "other"])
        bets = materialised(rest.select(*key, "team", "other", "f", F.coalesce("by", "scale").alias("by")))
    scales = scales.where("scale < 1")
    out = df
    for team, name in ((home, "__h"), (away, "__a")):
        out = joined_null_safe(out, scales.select(*[F.col(k).alias(c) for c, k in zip(batch, key, strict=True)], F.col("team").alias(team), F.col("scale").alias(name)), [*batch, team])
    once = F.when(F.col(home) == F.col(away), F.lit(1.0)).otherwise(F.coalesce("__a", F.lit(1.0)))
    bound = F.when(F.coalesce("__h", "__a").isNotNull(), label).otherwise(F.col("bound"))
    return out.withColumns({"stake": F.col("stake") * F.coalesce("__h", F.lit(1.0)) * once, "bound": bound}).drop("__h", "__a")


def portfolio_stakes(
    df: DataFrame, batch: Sequence[str], order: Sequence[str], p: str, odds: str, home: str, away: str, round_: str, league: str,
    fraction: float = 0.25, per_match: float = 0.03, per_round: float = 0.15, per_league: float = 0.20, per_team: float = 0.06, hook: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """df with edge, raw_kelly, adjusted_kelly, stake (a share of the bankroll) and bound, the last limit that was met.

    The Kelly fraction, changed by ``hook`` where it is positive, times ``fraction``, is cut at the limit of a match; then
    rounds and leagues of the batch that exceed theirs are scaled down (a null round or league has none), then teams, one after the other."""
    raw = kelly(F.col(p), F.col(odds))
    start = (F.when(raw > 0, hook(raw)).otherwise(raw) if hook else raw) * fraction
    out = df.withColumns({"edge": F.col(p) - 1 / F.col(odds), "raw_kelly": raw, "adjusted_kelly": raw * fraction, "stake": F.least(start, F.lit(per_match)), "bound": F.when(start > per_match, "match")})
    out = _scaled(out, [*batch, round_], per_round, "round")
    out = _scaled(out, [*batch, league], per_league, "league")
    return team_limits(materialised(out), batch, order, home, away, per_team)
